"""Toxicity classifier with counterfactual regularisation.

A logistic model of the presence of words and of beginnings of words (languages that join words have many forms of one).
Which of them count is learnt: those whose share among toxic labelled documents is far above that among the others.
Identity terms and their beginnings are always in the vocabulary. Each labelled document that names a group has a counterfactual text, in which every
identity term is swapped for the next of its list before terms are made of it; the fit penalises the squared change of the score's logit, so that the
terms themselves can't raise a score and neutral mentions aren't marked.

The fit uses at most about SAMPLE labelled documents, drawn by a hash of the id; scoring is one pass over all rows without
a shuffle. Null and empty texts have no words and the score of a text without any. Null ids and repeated rows pass through;
of an id that labels have with both values the higher counts; without labels of both kinds every score is 0; an empty table gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from rankpulse.llm.common import cut, text_of
from rankpulse.llm.quality_model import draw, fold

SAMPLE = 12_000
VOCABULARY = 1500
MIN_DOCUMENTS = 4
MIN_Z = 4.0
COUNTERFACTUAL = 1.0
RIDGE = 2e-4

#: Identity terms by list; a term is swapped for the next of its list.
IDENTITIES = (
    ("women", "men", "girls", "boys"),
    ("woman", "man", "girl", "boy"),
    ("female", "male", "nonbinary", "transgender"),
    ("gay", "straight", "lesbian", "bisexual"),
    ("muslim", "christian", "jewish", "hindu", "buddhist", "atheist"),
    ("muslims", "christians", "jews", "hindus", "buddhists", "atheists"),
    ("black", "white", "asian", "latino"),
    ("african", "european", "american", "mexican", "chinese", "indian"),
    ("immigrants", "natives", "refugees", "citizens"),
    ("disabled", "blind", "deaf", "old", "young"),
    ("frauen", "männer", "mädchen", "jungen"),
    ("femmes", "hommes", "filles", "garçons"),
    ("mujeres", "hombres", "chicas", "chicos"),
)
SWAP = {term: terms[(i + 1) % len(terms)] for terms in IDENTITIES for i, term in enumerate(terms)}

WORDS = re.compile(r"[^\W_]+")


def terms_of(text: str) -> set[str]:
    """Distinct words in lower case, and the beginnings of the longer ones, each marked by its length."""
    words = set(WORDS.findall(text.lower()))
    found = {w + "=" for w in words}
    for k in (5, 6, 7):
        found.update([w[:k] for w in words if len(w) > k])
    return found


def counterfactual(text: str) -> str:
    """The text in lower case with each identity word swapped, so that its beginnings go with it."""
    return WORDS.sub(lambda m: SWAP.get(m.group(), m.group()), text.lower())


def _explode(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """A row for each term of a document, and each of its counterfactual, some hundred thousand at a time."""
    names = ("doc_id", "toxic", "term", "own", "swapped")
    columns: tuple[list, ...] = tuple([] for _ in names)
    for batch in batches:
        for doc_id, toxic, text in zip(batch["doc_id"], batch["toxic"], batch["text"], strict=True):
            own, swapped = terms_of(text), terms_of(counterfactual(text))
            terms = sorted(own | swapped)
            for column, values in zip(columns, ([doc_id] * len(terms), [toxic] * len(terms), terms, [t in own for t in terms], [t in swapped for t in terms]), strict=True):
                column.extend(values)
            if len(columns[0]) > 200_000:
                yield pd.DataFrame(dict(zip(names, columns, strict=True)))
                columns = tuple([] for _ in names)
    if columns[0]:
        yield pd.DataFrame(dict(zip(names, columns, strict=True)))


def vocabulary(terms: DataFrame, n_toxic: int, n_clean: int) -> list[str]:
    """The terms whose share among toxic documents exceeds that among clean ones most surely, and all identity terms."""
    counts = terms.groupBy("term").agg(F.sum("toxic").alias("t"), F.sum(1 - F.col("toxic")).alias("c"))
    counts = counts.filter(F.col("t") + F.col("c") >= MIN_DOCUMENTS)
    share = (F.col("t") + F.col("c") + 1) / (n_toxic + n_clean + 2)
    z = (F.col("t") / n_toxic - F.col("c") / n_clean) / F.sqrt(share * (1 - share) * (1 / n_toxic + 1 / n_clean))
    top = counts.withColumn("z", z).filter(F.col("z") >= MIN_Z).orderBy(F.desc("z"), "term").limit(VOCABULARY)
    found = [r["term"] for r in top.select("term").collect()]
    return found + sorted(terms_of(" ".join(SWAP)) - set(found))


def _train(rows: list[np.ndarray], swapped: list[np.ndarray], y: np.ndarray, width: int, steps: int = 500) -> tuple[np.ndarray, float]:
    """Adam on the mean logistic loss + ridge + the squared logit change of counterfactuals."""
    flat, owner = np.concatenate(rows), np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    other, other_owner = np.concatenate(swapped), np.repeat(np.arange(len(rows)), [len(r) for r in swapped])
    w, b = np.zeros(width), np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6))
    m, v = np.zeros(width + 1), np.zeros(width + 1)
    n = len(rows)
    for t in range(1, steps + 1):
        z = np.bincount(owner, w[flat], n)
        change = z - np.bincount(other_owner, w[other], n)
        slope = (1 / (1 + np.exp(-np.clip(z + b, -30, 30))) - y) / n
        pull = 2 * COUNTERFACTUAL * change / n
        g = np.bincount(flat, (slope + pull)[owner], width) - np.bincount(other, pull[other_owner], width) + RIDGE * w
        g = np.r_[g, slope.sum()]
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        step = 0.05 * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.999**t)) + 1e-8)
        w, b = w - step[:-1], b - step[-1]
    return w, float(b)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict | None:
    """Term weights and bias from labelled documents; labels has doc_id and toxic. None unless there are both kinds."""
    known = labels.filter(F.col("toxic").isin(0, 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    # about SAMPLE rows at most, so they go to the texts
    chosen = draw(known, sample, known.count())
    texts = docs.select("doc_id", text_of().alias("text")).join(F.broadcast(chosen), "doc_id").filter(F.col("doc_id").isNotNull())
    terms = cut(texts.select("doc_id", "toxic", "text").mapInPandas(_explode, "doc_id long, toxic int, term string, own boolean, swapped boolean"))
    size = {r["toxic"]: r["n"] for r in terms.groupBy("toxic").agg(F.count_distinct("doc_id").alias("n")).collect()}
    if not size.get(0) or not size.get(1):
        return None
    names = vocabulary(terms.filter("own"), size[1], size[0])
    place = {t: i for i, t in enumerate(names)}
    kept = terms.join(docs.sparkSession.createDataFrame([(t,) for t in names], "term string"), "term", "left_semi")
    both = [F.sort_array(F.collect_set(F.when(F.col(c), F.col("term")))).alias(c) for c in ("own", "swapped")]
    per_doc = terms.groupBy("doc_id").agg(F.max("toxic").alias("toxic")).join(kept.groupBy("doc_id").agg(*both), "doc_id", "left")
    rows, swapped, y = [], [], []
    for r in sorted(per_doc.collect(), key=lambda r: r["doc_id"]):  # a bounded sample
        rows.append(np.array(sorted(place[t] for t in r["own"] or ()), dtype=int))
        swapped.append(np.array(sorted(place[t] for t in r["swapped"] or ()), dtype=int))
        y.append(r["toxic"])
    w, b = _train(rows, swapped, np.array(y, dtype=float), len(names))
    return {"weights": {t: float(w[i]) for t, i in place.items() if abs(w[i]) > 1e-9}, "bias": b}


def score(docs: DataFrame, model: dict | None, text: str = "text") -> DataFrame:
    """Adds score: the probability of being toxic."""
    if model is None:
        return docs.withColumn("score", F.lit(0.0))
    weights, bias = model["weights"], model["bias"]

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        known = weights.keys()
        for texts in batches:
            z = np.array([sum(map(weights.__getitem__, sorted(terms_of(t) & known))) for t in texts], dtype=float) + bias
            yield pd.Series(1 / (1 + np.exp(-np.clip(z, -30, 30))))

    return docs.withColumn("score", run(text_of(text)))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """Adds held_out, score and predicted. Learns from labels whose crc32 of the id modulo 5 is not 0."""
    model = fit(docs, labels.filter(fold("doc_id", 5) != 0))
    return score(docs, model).withColumns({"held_out": fold("doc_id", 5) == 0, "predicted": (F.col("score") >= threshold).cast("int")})
