"""Quality rules as weak supervision.

Each rule votes keep (1), reject (-1) or abstains (0). Expectation-maximisation over the counts of vote patterns
estimates how often each rule gives each vote on good and on bad documents; the posterior probability of "good"
decides, instead of a demand that a document passes every rule.

Text work is one pass in the JVM whose few numbers a row are kept as a table; the iterations run on the vote patterns,
of which there are at most 3 to the number of rules, however many documents there are.

Null text counts as no words. Null ids, repeated rows and other columns pass through; an empty table gives no rows.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from rankpulse.llm.common import SPACE, cut, letters_removed, text_of, words_of

SYMBOLS = "#*$%&|<>"
MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50

#: Rule: (measure, votes keep if, rejects if), each bound as (operator, value). Between the bounds a rule abstains.
RULES = {
    "word_length": ("word_chars / n_words", "between 3 and 10", "not between 2 and 15"),
    "symbols": ("n_symbols / n_words", "< 0.02", "> 0.1"),
    "dup_lines": ("n_dup_lines / greatest(n_lines, 1)", "<= 0.1", "> 0.3"),
    "repeat_words": ("n_repeat_words / n_words", "<= 0.2", "> 0.4"),
    "capitals": ("n_upper / greatest(word_chars, 1)", "< 0.12", "> 0.3"),
    "distinct_words": ("n_distinct / n_words", "> 0.2", "< 0.12"),
    "sentences": ("n_stops / n_words", "between 0.01 and 0.5", "not between 0.001 and 0.9"),
    "exclamations": ("n_exclaims / n_words", "< 0.05", "> 0.2"),
}

MEASURES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_upper", "n_distinct", "n_stops", "n_exclaims")


#: Up to so many repeated windows are looked up one by one; beyond, windows are sorted with their places. Same result.
FEW = 32


def measure(docs: DataFrame, text: str = "text") -> DataFrame:
    """Adds the measures that the rules read."""
    t = text_of(text)
    lines = F.filter(F.split(t, "\n", -1), lambda x: F.btrim(x, F.lit(SPACE)) != "")
    df = docs.withColumns({"_words": words_of(t), "_lines": lines})
    df = df.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.translate(t, SPACE, "")).cast("long"),
            "n_symbols": letters_removed(t, SYMBOLS),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_upper": F.regexp_count(t, F.lit(r"\p{Lu}")).cast("long"),
            "n_stops": letters_removed(t, ".?!:;"),
            "n_exclaims": letters_removed(t, "!"),
            "_hashes": F.transform("_words", lambda w: F.xxhash64(w)),
        }
    ).drop("_words", "_lines")
    h = F.col("_hashes")
    df = df.withColumn("_grams", F.transform(F.slice(h, 1, F.greatest(F.size(h) - 2, F.lit(0))), lambda x, i: F.xxhash64(x, F.get(h, i + 1), F.get(h, i + 2))))
    df = df.withColumn("n_distinct", F.size(F.array_distinct(h)).cast("long")).drop("_hashes")
    df = df.withColumn("_sorted", F.sort_array("_grams"))
    s = F.col("_sorted")
    df = df.withColumn("_repeated", F.array_distinct(F.filter(s, lambda x, i: x == F.get(s, i - 1)))).drop("_sorted")
    g, r = F.col("_grams"), F.col("_repeated")
    # Documents with many repeated windows sort them with their places, in columns of their own so that nothing is computed per element.
    many = F.size(r) > FEW
    df = df.withColumn("_placed", F.when(many, F.sort_array(F.transform(g, lambda x, i: F.struct(x.alias("g"), i.alias("i"))))))
    p = F.col("_placed")
    places = F.sort_array(F.transform(F.filter(p, lambda x, i: (x.g == F.get(p, i - 1).g) | (x.g == F.get(p, i + 1).g)), lambda x: x.i))
    few = F.array_compact(F.transform(g, lambda x, i: F.when(F.array_contains(r, x), i)))
    df = df.withColumn("_at", F.when(many, places).when(F.size(r) > 0, few)).drop("_placed", "_grams", "_repeated")
    at = F.col("_at")
    steps = F.transform(at, lambda x, i: F.least(F.lit(3), F.coalesce(F.get(at, i + 1) - x, F.lit(3))).cast("long"))
    return df.withColumn("n_repeat_words", F.coalesce(F.aggregate(steps, F.lit(0).cast("long"), lambda a, x: a + x), F.lit(0).cast("long"))).drop("_at")


def vote(measured: DataFrame) -> DataFrame:
    """Adds a column `vote_<rule>` of -1, 0 or 1 for each rule; documents without words get no votes (0)."""
    return measured.withColumns(
        {
            f"vote_{name}": F.expr(f"case when n_words = 0 then 0 when {value} {keep} then 1 when {value} {reject} then -1 else 0 end").cast("int")
            for name, (value, keep, reject) in RULES.items()
        }
    )


#: Of good documents a rule rejects at most this share. Without this constraint on the M-step "good" drifts: on tables where, say, a tenth of the
#: documents repeat lines, the likelihood is highest with those in the good class and the rule held to be wrong about them.
MOST_FALSE = 0.01


def _start() -> dict:
    """One class of good documents, and for each rule a kind of bad ones that it sees and the others mostly don't."""
    bad = 0.2 / len(RULES)
    good = {name: {-1: 0.005, 0: 0.045, 1: 0.95} for name in RULES}
    kinds = [{name: {-1: 0.9, 0: 0.05, 1: 0.05} if name == seen else {-1: 0.1, 0: 0.1, 1: 0.8} for name in RULES} for seen in RULES]
    return {"priors": [0.8, *[bad] * len(RULES)], "votes": [good, *kinds]}


def posterior(model: dict) -> Column:
    """Probability that a document is good, given its votes."""
    likely = [F.lit(0.0)]
    for prior, votes in zip(model["priors"], model["votes"], strict=True):
        total = F.lit(math.log(prior))
        for name in RULES:
            v = F.col(f"vote_{name}")
            total = total + F.when(v == 1, math.log(votes[name][1])).when(v == -1, math.log(votes[name][-1])).otherwise(math.log(votes[name][0]))
        likely.append(F.exp(total))
    return likely[1] / sum(likely[2:], likely[1])


def _expected(patterns: list[tuple[tuple[int, ...], int]], model: dict) -> list[list[list[float]]]:
    """By class and rule, how many rows vote -1, 0 and 1, each row shared out over the classes by its posterior."""
    logs = [(math.log(p), [[math.log(votes[name][v]) for v in (-1, 0, 1)] for name in RULES]) for p, votes in zip(model["priors"], model["votes"], strict=True)]
    sums = [[[0.0] * 3 for _ in RULES] for _ in logs]
    for votes, n in patterns:
        likely = [math.exp(prior + sum(x[v + 1] for x, v in zip(shares, votes, strict=True))) for prior, shares in logs]
        total = sum(likely)
        for of_class, x in zip(sums, likely, strict=True):
            for of_rule, v in zip(of_class, votes, strict=True):
                of_rule[v + 1] += n * x / total
    return sums


def _constrained(share: dict) -> dict:
    """The votes of a rule on good documents, with what it rejects beyond MOST_FALSE counted as kept."""
    over = max(0.0, share[-1] - MOST_FALSE)
    return share | {-1: share[-1] - over, 1: share[1] + over}


def fit(voted: DataFrame, iterations: int = 40, tolerance: float = 1e-6) -> dict:
    """Expectation-maximisation over the vote patterns of all rows: class priors and, by class and rule, the share of each vote.

    Spark counts the patterns, of which there are at most 3 to the number of rules; the iterations run over these counts on the driver.
    Bad documents are of several kinds, which different rules see, so each rule starts a kind of its own: with one bad class
    the most frequent kind takes it over and the rest count as good. The start names the classes; with no rows it is returned.
    """
    rows = voted.groupBy(*[f"vote_{name}" for name in RULES]).agg(F.count(F.lit(1)).alias("n")).collect()
    patterns = sorted((tuple(r)[:-1], r["n"]) for r in rows)
    model = _start()
    for _ in range(iterations if patterns else 0):
        sums = _expected(patterns, model)
        size = [sum(of_class[0]) for of_class in sums]
        votes = [{name: {v: (x[v + 1] + 0.1) / (n + 0.3) for v in (-1, 0, 1)} for name, x in zip(RULES, of_class, strict=True)} for n, of_class in zip(size, sums, strict=True)]
        votes[0] = {name: _constrained(share) for name, share in votes[0].items()}
        priors = [(n + 0.1) / (sum(size) + 0.1 * len(size)) for n in size]
        change, model = max(abs(x - y) for x, y in zip(priors, model["priors"], strict=True)), {"priors": priors, "votes": votes}
        if change < tolerance:
            break
    return model


def judge(docs: DataFrame, text: str = "text", keep: list[str] | None = None, threshold: float = 0.5) -> DataFrame:
    """The columns `keep` (all but the text by default) with measures, votes, posterior, base_failed and kept."""
    keep = [c for c in docs.columns if c != text] if keep is None else keep
    names = {c: f"_in_{i}" for i, c in enumerate(keep)}
    df = measure(docs.select(F.col(text).alias("_text"), *[F.col(c).alias(n) for c, n in names.items()]), "_text")
    voted = cut(vote(df.select(*names.values(), *MEASURES)))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    out = voted.withColumn("posterior", posterior(fit(voted))).withColumn("base_failed", failed)
    out = out.withColumn("kept", ~F.col("base_failed") & (F.col("posterior") >= threshold))
    made = [*MEASURES, *[f"vote_{r}" for r in RULES], "posterior", "base_failed", "kept"]
    return out.select(*[F.col(n).alias(c) for c, n in names.items() if c not in made], *made)
