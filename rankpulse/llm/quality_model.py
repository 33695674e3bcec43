"""Quality classifier by positive-unlabelled learning.

Trusted positives are labelled documents of label 1; unlabelled text is any documents, whose labels, if any, aren't read.
The share of positives in unlabelled text is estimated by best-bin estimation: at the score threshold where few but
positives are left, the share of unlabelled rows above it against the share of positives above it, with a margin for
small counts. The scores for it come from two models, each fitted on half of the rows and asked about the other half: positives that
a model has seen score higher than those among the unlabelled, which makes positives look rarer than they are. A small network is then fitted to the non-negative unbiased risk: prior * loss on positives as positive, plus
the loss of unlabelled as negative less prior * loss of positives as negative, which is kept from falling below zero.

Inputs of a score are measures of the text alone (shares of symbols, capitals, repeated lines and words, and so on).
They are computed in the JVM; Python sees only those numbers. The fit uses at most about SAMPLE rows of each kind, drawn by a hash of
id and text, repeated rows as one; scoring is one pass over all rows without a shuffle.

An id that labels have with both values is trusted. Null and empty texts have all measures 0 and a score like any other. Null ids and repeated rows pass through, other columns too, but score,
held_out and predicted are replaced; without positives or without unlabelled rows every score is 0.5; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankpulse.llm.quality_rules import measure

SAMPLE = 12_000
THRESHOLD = 0.7
HIDDEN = 12
STEPS = 600
SEED = 7

#: Shares of a text, from its measures; what divides is at least 1.
FEATURES = {
    "length": "log(1 + n_words) / 10",
    "short": "case when n_words < 5 then 1.0 else 0.0 end",
    "word_length": "word_chars / greatest(n_words, 1) / 10",
    "symbols": "least(n_symbols / greatest(n_words, 1), 2)",
    "dup_lines": "n_dup_lines / greatest(n_lines, 1)",
    "repeat_words": "n_repeat_words / greatest(n_words, 1)",
    "capitals": "n_upper / greatest(word_chars, 1)",
    "distinct_words": "n_distinct / greatest(n_words, 1)",
    "stops": "least(n_stops / greatest(n_words, 1), 1)",
    "exclamations": "least(n_exclaims / greatest(n_words, 1), 2)",
    "line_words": "log(1 + n_words / greatest(n_lines, 1)) / 10",
}


def features(docs: DataFrame, text: str = "text") -> DataFrame:
    """_doc, a struct of the columns of docs, which keeps their names apart, and _x, an array of the features."""
    packed = docs.select(F.struct(*docs.columns).alias("_doc"), F.col(text).alias("_text"))
    return measure(packed, "_text").select("_doc", F.array(*[F.expr(e).cast("double") for e in FEATURES.values()]).alias("_x"))


def fold(doc_id: str, parts: int) -> Column:
    """crc32 of the id as text, modulo parts; null as the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), F.lit(parts))


def draw(df: DataFrame, rows: int, of: int) -> DataFrame:
    """About `rows` of the table's `of` rows, by a hash of doc_id."""
    if of <= rows:
        return df
    return df.filter(F.pmod(F.xxhash64(F.lit("draw"), "doc_id"), F.lit(1 << 30)) < int(rows / of * (1 << 30)))


def thin(df: DataFrame, rows: int) -> DataFrame:
    """About `rows` rows of a table (doc_id, text), or all if it has no more, drawn by a hash of both, so however they are dealt out; of repeated rows one."""
    of = df.count()
    return df if of <= rows else df.filter(F.pmod(F.xxhash64(F.lit(SEED), "doc_id", "text"), F.lit(1 << 30)) < int(rows / of * (1 << 30))).dropDuplicates(["doc_id", "text"])


def _matrix(df: DataFrame) -> np.ndarray:
    """The features of a bounded sample, in an order of their own."""
    rows = np.array([r["_x"] for r in df.select("_x").collect()], dtype=float).reshape(-1, len(FEATURES))
    return rows[np.lexsort(rows.T)] if len(rows) else rows


def _forward(w: dict, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    hidden = np.tanh(((x - w["mean"]) / w["sd"]) @ w["a"] + w["b"])
    return hidden, hidden @ w["c"] + w["d"]


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _fit(positive: np.ndarray, unlabelled: np.ndarray, prior: float | None, steps: int = STEPS) -> dict:
    """Adam on the non-negative risk; with prior None on positive against unlabelled."""
    rng = np.random.default_rng(SEED)
    both = np.vstack([positive, unlabelled])
    w = {
        "mean": both.mean(0),
        "sd": both.std(0) + 1e-3,
        "a": rng.normal(0, 0.4, (both.shape[1], HIDDEN)),
        "b": np.zeros(HIDDEN),
        "c": rng.normal(0, 0.4, HIDDEN),
        "d": np.zeros(1),
    }
    m, v = ({k: np.zeros_like(w[k]) for k in "abcd"} for _ in range(2))
    n, k = len(positive), len(unlabelled)
    for t in range(1, steps + 1):
        hidden, z = _forward(w, both)
        p = _sigmoid(z)
        if prior is None:
            slope = np.r_[(p[:n] - 1) / n, p[n:] / k]
        else:
            # logistic loss: softplus(-z) as positive, softplus(z) as negative
            negative = np.logaddexp(0, z[n:]).mean() - prior * np.logaddexp(0, z[:n]).mean()
            as_negative = np.r_[-prior * p[:n] / n, p[n:] / k]
            as_positive = np.r_[prior * (p[:n] - 1) / n, np.zeros(k)]
            slope = as_positive + as_negative if negative >= 0 else -as_negative
        back = np.outer(slope, w["c"]) * (1 - hidden**2)
        x = (both - w["mean"]) / w["sd"]
        grads = {"a": x.T @ back + 1e-4 * w["a"], "b": back.sum(0), "c": hidden.T @ slope + 1e-4 * w["c"], "d": slope.sum(keepdims=True)}
        for name, g in grads.items():
            m[name] = 0.9 * m[name] + 0.1 * g
            v[name] = 0.999 * v[name] + 0.001 * g * g
            w[name] = w[name] - 0.02 * (m[name] / (1 - 0.9**t)) / (np.sqrt(v[name] / (1 - 0.999**t)) + 1e-8)
    return w


def estimate_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """Share of positives among unlabelled scores (best-bin estimation)."""
    cuts = np.quantile(positive, np.linspace(0.02, 0.7, 35))
    above_p = np.array([(positive >= c).mean() for c in cuts])
    above_u = np.array([(unlabelled >= c).mean() for c in cuts])
    margin = np.sqrt(np.log(40) / (2 * len(positive))) + np.sqrt(np.log(40) / (2 * len(unlabelled)))
    best = int(np.argmin((above_u + margin) / above_p))
    return float(np.clip(above_u[best] / above_p[best], 0.05, 0.98))


def cross_prior(positive: np.ndarray, unlabelled: np.ndarray) -> float:
    """The estimate by models that haven't seen the rows they score: the mean of two, each fitted on every second row."""
    found = []
    for k in (0, 1):
        seen, other = (slice(k, None, 2), slice(1 - k, None, 2)) if min(len(positive), len(unlabelled)) > 1 else (slice(None), slice(None))
        w = _fit(positive[seen], unlabelled[seen], None, STEPS // 2)
        found.append(estimate_prior(_forward(w, positive[other])[1], _forward(w, unlabelled[other])[1]))
    return sum(found) / len(found)


def fit(docs: DataFrame, positives: DataFrame, sample: int = SAMPLE) -> dict | None:
    """The model; docs are unlabelled (doc_id, text), positives have the doc_id of trusted documents among them. None without rows of both."""
    ids = positives.select("doc_id").dropDuplicates()
    ids = draw(ids, sample, ids.count())
    # the drawn ids are few and go to the texts: only drawn rows are measured
    positive = _matrix(features(thin(docs.join(F.broadcast(ids), "doc_id", "left_semi").select("doc_id", "text"), sample)))
    if not len(positive):
        return None
    unlabelled = _matrix(features(thin(docs.select("doc_id", "text"), sample)))
    prior = cross_prior(positive, unlabelled)
    return _fit(positive, unlabelled, prior) | {"prior": prior}


def score(docs: DataFrame, model: dict | None, text: str = "text") -> DataFrame:
    """Adds score: the probability of being good."""
    docs = docs.drop("score")
    if model is None:
        return docs.withColumn("score", F.lit(0.5))

    @F.pandas_udf("double")
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for x in batches:
            yield pd.Series(_sigmoid(_forward(model, np.stack(x.to_numpy()))[1]) if len(x) else [], dtype=float)

    # It isn't, but a filter on the score must stay above: pushed below, the optimizer would put the measures' arrays inside each other and compute them anew for each element.
    run = run.asNondeterministic()
    return features(docs, text).withColumn("_x", run("_x")).select("_doc.*", F.col("_x").alias("score"))


def trusted(labels: DataFrame) -> DataFrame:
    """The positives that may be learnt from: crc32 of the id modulo 4 is not 2."""
    return labels.filter((F.col("quality") == 1) & (fold("doc_id", 4) != 2))


def classify(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """Adds held_out, score and predicted. Fits on documents outside the held-out fold."""
    model = fit(docs.filter(fold("doc_id", 4) != 2), trusted(labels))
    scored = score(docs, model)
    return scored.withColumns({"held_out": fold("doc_id", 4) == 2, "predicted": (F.col("score") >= threshold).cast("int")})
