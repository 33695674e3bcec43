"""Numbered versions of the star schema in hash buckets: a version writes the buckets that it changes, and a manifest that names the files of all.

A bucket is a folder of Parquet files, never changed once a manifest names it. The manifest of a version is written after its buckets, under a name that appears whole
or not at all, so it is the commit: what a failed attempt left isn't named anywhere and is removed when the version is written again. Readers take
the newest manifest and see one version, whatever is written meanwhile.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from rankpulse.schema import SCHEMAS, Tables

BUCKETS = 32
#: What a table's rows are dealt out by: what belongs to an item is in one bucket of each table.
BY = {"novels": "novel_uid", "novel_titles": "novel_uid", "tags": "tag_norm", "novel_tag_map": "novel_uid", "rank_lists": "rank_list_id", "rank_snapshots": "snapshot_id", "rank_entries": "novel_uid", "first_n_chapters": "novel_uid"}

Manifest = dict[str, dict[str, dict]]


def _path(spark: SparkSession, path: str):
    return spark._jvm.org.apache.hadoop.fs.Path(path)


def _store(spark: SparkSession, path: str):
    return _path(spark, path).getFileSystem(spark._jsc.hadoopConfiguration())


def numbers(spark: SparkSession, folder: str) -> list[int]:
    """Numbers of the complete versions in a folder, in order."""
    found = _store(spark, folder).globStatus(_path(spark, f"{folder}/manifest/*.json")) or []
    return sorted(int(x.getPath().getName().removesuffix(".json")) for x in found)


def manifest(spark: SparkSession, folder: str, number: int) -> Manifest:
    """table -> bucket -> folder of its files, below the versions' folder, and how many rows of which checksum they have."""
    rows = spark.read.text(f"{folder}/manifest/{number}.json", wholetext=True).collect()
    return json.loads(rows[0][0])


def read(spark: SparkSession, folder: str, number: int) -> Tables:
    """The tables of a version, with their schemas given, not inferred."""
    named = manifest(spark, folder, number)
    out = {}
    for name, ddl in SCHEMAS.items():
        paths = sorted(f"{folder}/{b['path']}" for b in named.get(name, {}).values())
        out[name] = spark.read.schema(ddl).parquet(*paths) if paths else spark.createDataFrame([], ddl)
    return out


def bucket_of(name: str) -> Column:
    return F.pmod(F.xxhash64(BY[name]), F.lit(BUCKETS)).cast("int")


def sums(name: str, df: DataFrame) -> dict[str, dict]:
    """Rows and checksum of each bucket of a table; equal rows in any order have equal ones."""
    found = df.groupBy(bucket_of(name).alias("bucket")).agg(F.count(F.lit(1)).alias("rows"), F.sum(F.xxhash64(*df.columns).cast("decimal(38,0)")).cast("string").alias("checksum"))
    return {str(r["bucket"]): {"rows": r["rows"], "checksum": r["checksum"]} for r in found.collect()}


def write(spark: SparkSession, folder: str, number: int, tables: Tables, before: int | None) -> list[str]:
    """Writes tables as a version after the version `before` (or none): the buckets that differ from its own, then the manifest. Gives the folders written."""
    former = manifest(spark, folder, before) if before is not None else {}
    store, named, written = _store(spark, folder), {}, []
    for name in SCHEMAS:
        df = tables[name].select(*[f.split()[0] for f in SCHEMAS[name].split(", ")])
        now, old = sums(name, df), former.get(name, {})
        same = {b: old[b] for b, x in now.items() if b in old and x == {k: old[b][k] for k in x}}
        changed = sorted(set(now) - set(same), key=int)
        at = f"data/{name}/v={number}"
        store.delete(_path(spark, f"{folder}/{at}"), True)
        if changed:
            rows = df.withColumn("bucket", bucket_of(name)).filter(F.col("bucket").isin([int(b) for b in changed]))
            rows.repartition("bucket").write.partitionBy("bucket").parquet(f"{folder}/{at}")
        named[name] = same | {b: now[b] | {"path": f"{at}/bucket={b}"} for b in changed}
        written += [f"{at}/bucket={b}" for b in changed]
    commit(spark, folder, number, named)
    return written


def commit(spark: SparkSession, folder: str, number: int, named: Manifest) -> None:
    """Writes a manifest under another name and renames it."""
    store, at, end = _store(spark, folder), _path(spark, f"{folder}/manifest/_{number}.part"), _path(spark, f"{folder}/manifest/{number}.json")
    out = store.create(at, True)
    out.write(bytearray(json.dumps(named, sort_keys=True).encode()))
    out.close()
    store.delete(end, False)
    if not store.rename(at, end):
        raise OSError(f"version {number} can't be committed")
