"""WARC archives with an index first.

Writing: each task appends one gzip member per record to archive files of its own in a shared folder and returns the index:
file, offset, length, url, page id, digest and type of every record. The index is written as a table before anything reads
it, so a lost executor repeats neither archive nor index; a repeated task writes new files, and only files that the index
names are ever read.

Reading: index rows, any selection of them, are dealt out by stretches of a file and sorted by file and offset; neighbouring byte ranges are
coalesced into one read, and records are cut from it by the index. Executors open archives through pyarrow, so the folder's scheme
must be one of its: file, hdfs, s3 (s3a is taken for it), gs, abfs.

Of pages with equal payloads of at least `min_bytes` the one with the smallest page id is a response; the others are revisit
records that name it, carry its digest and, in their HTTP header, the payload's length. Pages that repeat both page id and
payload have the type of the first. Null page ids come after all others. Null html is an empty payload, a null url is left out.
An empty table gives an empty index. The smallest id by digest is a partial aggregate; it goes back to the pages by
(digest, salt), so that a payload of a third of all pages is spread over SALTS tasks.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
import zlib
from collections.abc import Iterator
from urllib.parse import quote, unquote

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankpulse.llm.common import cut, shared_dir

SALTS = 32
#: A task begins a new archive after so many bytes; neighbouring ranges are read at once up to this many, across gaps up to this.
ROLL_BYTES = 256 << 20
READ_BYTES = 8 << 20
GAP_BYTES = 64 << 10
#: Bytes of an archive that one task reads, about.
SPLIT_BYTES = 8 << 20
DATE = "1970-01-01T00:00:00Z"
ID = "urn:rankpulse:page:"
INDEX = "file string, offset long, length long, page_id long, url string, payload_digest string, record_type string, refers_to long"
RECORD = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, intact boolean"


def _lines(*pairs: tuple[str, object]) -> bytes:
    return b"".join(f"{k}: {v}\r\n".encode() for k, v in pairs if v is not None)


def _record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One record: WARC header, HTTP header and, for responses, the payload."""
    http = b"HTTP/1.1 200 OK\r\n" + _lines(("Content-Type", "text/html; charset=utf-8"), ("Content-Length", len(payload))) + b"\r\n"
    block = http if revisit else http + payload
    head = b"WARC/1.1\r\n" + _lines(
        ("WARC-Type", "revisit" if revisit else "response"),
        ("WARC-Record-ID", f"<{ID}{'' if page_id is None else page_id}>"),
        ("WARC-Date", DATE),
        ("WARC-Target-URI", None if url is None else quote(url, safe="!#$&'()*+,/:;=?@[]~%")),
        ("WARC-Payload-Digest", f"sha1:{digest}"),
        ("WARC-Profile", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest" if revisit else None),
        ("WARC-Refers-To", f"<{ID}{'' if refers_to is None else refers_to}>" if revisit else None),
        ("Content-Type", "application/http; msgtype=response"),
        ("Content-Length", len(block)),
    )
    return head + b"\r\n" + block + b"\r\n\r\n"


def _parse(record: bytes) -> dict:
    """What a record says, with its payload (None for a revisit)."""
    head, _, rest = record.partition(b"\r\n\r\n")
    fields = dict(x.split(": ", 1) for x in head.decode().split("\r\n")[1:])
    block = rest[: int(fields["Content-Length"])]
    http, _, payload = block.partition(b"\r\n\r\n")
    sizes = dict(x.split(": ", 1) for x in http.decode().split("\r\n")[1:])
    number = lambda name: int(x) if (x := fields.get(name, "")[len(ID) + 1 : -1]) else None
    revisit = fields["WARC-Type"] == "revisit"
    return {
        "page_id": number("WARC-Record-ID"),
        "url": unquote(fields["WARC-Target-URI"]) if "WARC-Target-URI" in fields else None,
        "payload_bytes": int(sizes["Content-Length"]),
        "payload_digest": fields["WARC-Payload-Digest"].removeprefix("sha1:"),
        "record_type": fields["WARC-Type"],
        "refers_to": number("WARC-Refers-To"),
        "payload": None if revisit else payload,
    }


def _digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def _member(data: bytes) -> bytes:
    """A gzip member without a time, so that equal records are equal bytes."""
    z = zlib.compressobj(3, zlib.DEFLATED, 31)
    return z.compress(data) + z.flush()


def _int(x: object) -> int | None:
    return None if pd.isna(x) else int(x)


def _open(uri: str):
    """File system and path of an URI whose scheme pyarrow knows: file, hdfs, s3, gs, abfs and their like; s3a and s3n are s3."""
    from pyarrow import fs

    scheme, _, rest = uri.partition("://")
    return fs.FileSystem.from_uri(f"{'s3' if scheme in ('s3a', 's3n') else scheme}://{rest}")


def _writer(folder: str):
    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        store, root = _open(folder)
        out, at, name = None, 0, ""
        try:
            for batch in batches:
                rows = []
                for page_id, url, html, refers_to, revisit in zip(batch["page_id"], batch["url"], batch["html"], batch["refers_to"], batch["revisit"], strict=True):
                    if out is None or at >= ROLL_BYTES:
                        if out is not None:
                            out.close()
                        name = f"{uuid.uuid4().hex}.warc.gz"
                        out = store.open_output_stream(f"{root}/{name}", compression=None)
                        info = b"software: rankpulse\r\n"
                        head = b"WARC/1.1\r\n" + _lines(("WARC-Type", "warcinfo"), ("WARC-Record-ID", f"<urn:uuid:{uuid.uuid4()}>"), ("WARC-Date", DATE), ("Content-Type", "application/warc-fields"), ("Content-Length", len(info)))
                        out.write(first := _member(head + b"\r\n" + info + b"\r\n\r\n"))
                        at = len(first)
                    payload, page_id, refers_to = html.encode(), _int(page_id), _int(refers_to)
                    url = url if isinstance(url, str) else None
                    data = _member(_record(page_id, url, payload, digest := _digest(payload), refers_to, bool(revisit)))
                    out.write(data)
                    rows.append((f"{folder}/{name}", at, len(data), page_id, url, digest, "revisit" if revisit else "response", refers_to))
                    at += len(data)
                columns = [x.split()[0] for x in INDEX.split(", ")]
                yield pd.DataFrame(rows, columns=columns).astype({"page_id": "Int64", "refers_to": "Int64"})
        finally:
            if out is not None:
                out.close()

    return write


def write(pages: DataFrame, folder: str | None = None, min_bytes: int = 0) -> DataFrame:
    """Archives of all pages in the folder (an URI that driver and executors share), and their index as a table."""
    spark = pages.sparkSession
    folder = folder or shared_dir(spark)
    folder = folder if "://" in folder else f"file://{folder}"
    jvm = spark._jvm.org.apache.hadoop.fs
    jvm.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(jvm.Path(folder))
    html = F.coalesce(F.col("html"), F.lit(""))
    df = pages.select(F.col("page_id").cast("long"), "url", html.alias("html"), F.sha2(html, 256).alias("_same"))
    same = df.filter(F.octet_length("html") >= min_bytes).groupBy("_same").agg(F.min("page_id").alias("_first"), F.count(F.lit(1)).alias("_n"))
    same = same.filter("_n > 1").select("_same", "_first", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("_salt"), F.lit(True).alias("_many"))
    df = df.withColumn("_salt", F.pmod(F.xxhash64("page_id", "url"), F.lit(SALTS)).cast("int")).join(same, ["_same", "_salt"], "left")
    revisit = F.coalesce(F.col("_many") & ~F.col("page_id").eqNullSafe(F.col("_first")), F.lit(False))
    df = df.select("page_id", "url", "html", F.when(revisit, F.col("_first")).alias("refers_to"), revisit.alias("revisit"))
    return cut(df.mapInPandas(_writer(folder), INDEX))


def _reader(with_payload: bool):
    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        opened, source = "", None
        for batch in batches:
            rows, run = [], []

            def flush(run: list) -> None:
                nonlocal opened, source
                if not run:
                    return
                if run[0][0] != opened:
                    if source is not None:
                        source.close()
                    store, path = _open(run[0][0])
                    opened, source = run[0][0], store.open_input_file(path)
                begin = run[0][1]
                data = source.read_at(run[-1][1] + run[-1][2] - begin, begin)
                for _, offset, length in run:
                    x = _parse(zlib.decompress(data[offset - begin : offset - begin + length], 31))
                    payload = x.pop("payload")
                    x["intact"] = payload is None or (_digest(payload) == x["payload_digest"] and len(payload) == x["payload_bytes"])
                    rows.append(x | ({"payload": payload} if with_payload else {}))

            for file, offset, length in zip(batch["file"], batch["offset"], batch["length"], strict=True):
                if run and (file != run[-1][0] or offset - run[-1][1] - run[-1][2] > GAP_BYTES or offset + length - run[0][1] > READ_BYTES):
                    flush(run)
                    run = []
                run.append((file, offset, length))
            flush(run)
            columns = [x.split()[0] for x in RECORD.split(", ")] + ["payload"] * with_payload
            yield pd.DataFrame(rows, columns=columns).astype({"page_id": "Int64", "refers_to": "Int64"})

    return read


def read(index: DataFrame, with_payload: bool = True) -> DataFrame:
    """The records that the index rows name, read back from their archives; intact says if a payload has its digest and length."""
    total = index.agg(F.sum("length")).first()[0] or 0
    # a task gets stretches of about SPLIT_BYTES; the number is given, or small index rows would be merged into one task that reads all archives
    n = max(2 * -(-total // SPLIT_BYTES), index.sparkSession.sparkContext.defaultParallelism)
    ranges = index.select("file", "offset", "length").repartition(n, "file", F.floor(F.col("offset") / SPLIT_BYTES)).sortWithinPartitions("file", "offset")
    return ranges.mapInPandas(_reader(with_payload), RECORD + (", payload binary" if with_payload else ""))
