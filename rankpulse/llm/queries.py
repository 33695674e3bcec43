"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from rankpulse.llm import alignment, divergence, jaccard, langid, licenses, line_dedup, mixing, packing, quality_model, quality_rules, simhash, toxicity, warc
from rankpulse.llm.common import cut, table


def byte_bpe() -> str:
    """Path of the vocabulary that op1 packs with."""
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def pieces() -> str:
    """Path of the vocabulary that op12 aligns with the other."""
    import public_tokenizers

    return str(public_tokenizers.path("piece_bpe_32k.model"))


def op1_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents, packed into sequences of 1024 tokens."""
    pieces = packing.tokenise(table(spark, sf_dir, "documents"), byte_bpe())
    return packing.pack(pieces).drop("row")


def op2_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of all documents linked by similarity of their five-word shingles."""
    return jaccard.link(table(spark, sf_dir, "documents"))


def op3_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Licence phrases and notices of all documents."""
    return licenses.scan(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")


def op4_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Curriculum over all documents, range-sorted by the position at which each first appears: what the mix takes of it."""
    planned = mixing.plan(cut(mixing.measure(table(spark, sf_dir, "documents"))))
    mixed = planned.select("doc_id", "size", "source_size", F.round("target", 3).alias("target"), "taken", F.round("position", 6).alias("position"))
    return mixed.orderBy(F.col("position").asc_nulls_last(), "doc_id")


def op5_quality_model(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positive-unlabelled quality scores of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = quality_model.classify(docs, table(spark, sf_dir, "labels").select("doc_id", "quality"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op6_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents without the runs of lines that stood before."""
    return line_dedup.dedup(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints of all documents and of their edited texts."""
    return simhash.compare(table(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counterfactually regularised toxicity scores of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = toxicity.classify(docs, table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return scored.select("doc_id", "held_out", "score", "predicted")


def op9_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All pages written as WARC records and read back from the archives."""
    index = warc.write(table(spark, sf_dir, "pages"))
    return warc.read(index, with_payload=False).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact")


def op10_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weak supervision over all documents."""
    judged = quality_rules.judge(table(spark, sf_dir, "documents"), keep=["doc_id"])
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", F.round("posterior", 6).alias("posterior"))


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of each language are from each other, and the terms that set each apart."""
    return divergence.audit(table(spark, sf_dir, "documents").select("text", "lang", "source"))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in two tokenizations, aligned where both end a token."""
    return alignment.align(table(spark, sf_dir, "documents").select("doc_id", "text"), byte_bpe(), pieces())


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of all documents by naive Bayes."""
    predicted = langid.classify(table(spark, sf_dir, "documents").select("doc_id", "text", "lang"))
    return predicted.select("doc_id", "held_out", "lang_pred", "score")


QUERIES = {
    "op1_best_fit_packing": op1_best_fit_packing,
    "op2_jaccard_join": op2_jaccard_join,
    "op3_license_scan": op3_license_scan,
    "op4_mix_sources": op4_mix_sources,
    "op5_quality_model": op5_quality_model,
    "op6_line_dedup": op6_line_dedup,
    "op7_simhash": op7_simhash,
    "op8_toxicity": op8_toxicity,
    "op9_warc": op9_warc,
    "op10_quality_rules": op10_quality_rules,
    "op11_source_divergence": op11_source_divergence,
    "op12_tokenizer_alignment": op12_tokenizer_alignment,
    "op13_language_id": op13_language_id,
}

_OP4_SQL = r"""
with d as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
    md5(coalesce(cast(doc_id as varchar), '') || ':' || md5(coalesce(text, ''))) as h
  from documents
), s as (
  select source, cast(sum(size) as bigint) as source_size, (row_number() over (order by source nulls last) - 1) % 3 as kind from d group by source
), w as (
  select *, kind + 1.0::double as weight, 3.0::double * source_size as cap from s
), o as (
  select *, sum(source_size) over () - coalesce(sum(cap) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0) as remaining,
    sum(weight) over () - coalesce(sum(weight) over (order by cap / weight, source nulls last rows between unbounded preceding and 1 preceding), 0) as weights
  from w
), t as (
  select *, case when cap <= remaining / weights * weight then cap
    else weight * (arg_min(remaining / weights, cap / weight) filter (where cap > remaining / weights * weight) over ()) end as target from o
), r as (
  select d.*, t.source_size, t.target, t.kind, cast(round(t.target) as bigint) as goal,
    cast(coalesce(sum(size) over (partition by d.source order by h, doc_id nulls last, size rows between unbounded preceding and 1 preceding), 0) as bigint) as start
  from d join t on d.source is not distinct from t.source
), k as (
  select *, case when source_size > 0 then goal // source_size else 0 end as epochs from r
), x as (
  select *, epochs * size + greatest(least(goal - epochs * source_size - start, size), 0) as taken, start / nullif(target, 0) as part from k
)
select doc_id, size, source_size, round(target, 3) as target, cast(taken as bigint) as taken,
  round(case when taken > 0 then case kind when 0 then part when 1 then (sqrt(1 + 8 * part) - 1) / 2
    else case when part <= 0.5 then sqrt(0.5625 + 2 * part) - 0.75 else 0.5 + 1.25 - sqrt(1.5625 - 2 * (part - 0.5)) end end end, 6) as position
from x
"""

_OP9_SQL = r"""
with p as (
  select page_id, cast(strlen(coalesce(html, '')) as bigint) as payload_bytes, sha1(coalesce(html, '')) as hex,
    min(page_id) over (partition by sha1(coalesce(html, ''))) as first
  from pages
), b as (
  select *, list_transform(range(0, 8), lambda i: cast('0x' || substr(hex, cast(1 + 5 * i as bigint), 5) as bigint)) as parts from p
)
select page_id, payload_bytes,
  array_to_string(list_transform(range(0, 32), lambda j:
    substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(1 + ((parts[1 + j // 4] >> cast(15 - 5 * (j % 4) as bigint)) & 31) as bigint), 1)), '') as payload_digest,
  case when page_id = first then 'response' else 'revisit' end as record_type,
  case when page_id <> first then first end as refers_to, true as intact
from b
"""

_OP11_SQL = r"""
with d as (
  select row_number() over () as row, coalesce(lang, '') as lang, coalesce(source, '') as source,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as words
  from documents
), w as (
  select row, lang, source, unnest(words) as term from d
), k as (
  select lang, term from w group by lang, term having count(distinct row) >= 3
), c as (
  select w.lang, w.source, w.term, count(*) as n from w join k using (lang, term) group by 1, 2, 3
), v as (
  select lang, count(*)::hugeint as v from k group by lang
), g as (
  select a.lang, a.source, coalesce(b.n, 0)::hugeint as n, coalesce(v.v, 0) as v
  from (select distinct lang, source from d) a left join (select lang, source, sum(n) as n from c group by 1, 2) b using (lang, source) left join v using (lang)
), p as (
  select g.lang, g.source, k.term, coalesce(c.n, 0) as count, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 1)) // (g.n + g.v) as p
  from g join k using (lang) left join c on c.lang = g.lang and c.source = g.source and c.term = k.term
), q as (
  select lang, term, 1 + (1000000000::hugeint * (sum(c.n) + 1)) // (any_value(t.n) + any_value(t.v)) as q
  from c join (select lang, sum(n) as n, max(v) as v from g group by lang) t using (lang) group by lang, term
), s as (
  select x.lang, x.source, y.source as item, sum((x.p - y.p) * (x.p - y.p) // y.p) as value
  from p x join p y on x.lang = y.lang and x.term = y.term and x.source <> y.source group by 1, 2, 3
), r as (
  select a.lang, a.source, 'pair' as part, b.source as item, coalesce(s.value, 0)::bigint as value
  from g a join g b on a.lang = b.lang and a.source <> b.source left join s on s.lang = a.lang and s.source = a.source and s.item = b.source
  union all
  select p.lang, p.source, 'term', p.term, ((p.p - q.q) * (p.p - q.q) // q.q)::bigint from p join q using (lang, term) where p.count > 0 and p.p > q.q
), o as (
  select *, cast(row_number() over (partition by lang, source, part order by value desc, item) as integer) as rank from r
)
select lang, source, part, item, value, rank from o where part = 'pair' or rank <= 200
"""

ORACLES: dict[str, str] = {
    "op9_warc": _OP9_SQL,
    "op4_mix_sources": _OP4_SQL,
    "op11_source_divergence": _OP11_SQL,
}
