"""Stages of the pipeline on small tables."""

import collections

import pytest

import corpus_pipeline


def test_one_document_of_each_group(spark):
    """Also where ids repeat or are null: the smallest id of a group, and one row of it."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(1, a), (1, a), (1, a + " end"), (2, a), (None, a), (None, b), (None, b), (3, c), (3, "other words that stand alone here"), (4, c), (5, ""), (5, ""), (None, None)]
    docs = spark.createDataFrame([(*r, "s") for r in rows], "doc_id long, text string, source string")
    got = collections.Counter((r.doc_id, r.text) for r in corpus_pipeline.near_duplicates(spark, docs, "").collect())
    first = [x for x in got if x[0] == 1]
    assert len(first) == 1 and first[0][1] in (a, a + " end")
    assert got == collections.Counter([first[0], (None, b), (3, c), (3, "other words that stand alone here"), (5, ""), (5, ""), (None, None)])


NAMES = "doc_id long, text string, lang string, source string, n_chars long, component string, _d long, size string"


def odd(spark):
    words = " ".join(f"w{i}" for i in range(60))
    rows = [(1, None), (2, ""), (None, "one text"), (None, None), (3, words), (4, words), (4, words), (5, " \n\n "), (6, "long " * 30000), (7, f"{words}\n" * 3)]
    return spark.createDataFrame([(i, t, None, None if i is None else "s", None, "c", 1, None) for i, t in rows], NAMES)


@pytest.mark.parametrize("name", ["lines", "near_duplicates", "mix"])
def test_stage_on_odd_rows(spark, sf, name):
    stage = dict(corpus_pipeline.STAGES)[name]
    docs = odd(spark)
    got = stage(spark, docs, sf)
    assert got.columns == docs.columns
    rows = got.collect()
    assert {r["doc_id"] for r in rows} <= {None, 1, 2, 3, 4, 5, 6, 7}
    assert all((r["component"], r["_d"], r["size"]) == ("c", 1, None) for r in rows)
    if name == "lines":  # one line of sixty words, and later the same: what stood before goes, what has no words stays
        assert sum(r["text"] is None for r in rows) == 2
        assert sum((r["text"] or "").count("w59") for r in rows) < 6
    if name == "near_duplicates":  # 3 and 4 are equal, 7 holds their shingles and little else; rows without words stay
        ids = sorted((r["doc_id"] is None, r["doc_id"] or 0) for r in rows)
        assert ids == [(False, 1), (False, 2), (False, 3), (False, 5), (False, 6), (True, 0), (True, 0)]
    assert stage(spark, spark.createDataFrame([], NAMES), sf).collect() == []


def test_pack_on_odd_rows(spark, sf):
    got = corpus_pipeline.pack(spark, odd(spark), sf).collect()
    assert sum(r["piece"] == 0 for r in got) == 10  # a null or empty text has its end mark
    assert all(0 < r["length"] <= 1024 for r in got)
    assert corpus_pipeline.pack(spark, spark.createDataFrame([], NAMES), sf).collect() == []


def test_quality_on_odd_rows(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").unionByName(odd(spark).filter("doc_id is null"), allowMissingColumns=True)
    got = corpus_pipeline.quality(spark, docs, sf)
    assert got.columns == docs.columns
    labels = {r["doc_id"]: r["quality"] for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    kept = {r["doc_id"] for r in got.collect()}
    good = [i for i, q in labels.items() if q == 1]
    assert sum(i in kept for i in good) >= 0.8 * len(good)
