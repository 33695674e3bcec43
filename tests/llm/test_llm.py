"""The dealt operators on small tables: edge cases, and brute-force versions of what SQL can't express."""

import collections
import hashlib
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from rankpulse.llm import graph, jaccard, licenses, line_dedup, mixing, packing, quality_model, quality_rules, queries, simhash, toxicity, warc

LINE = " ".join(f"word{i}" for i in range(60))
TEXTS = [
    (1, f"alpha beta gamma.\n{LINE}\nlast line here", "en", "a"),
    (2, f"{LINE}\nother ending", "en", "a"),
    (3, f"{LINE}\nother ending", "en", "b"),
    (4, None, "de", None),
    (5, "", None, "b"),
    (6, " \n\t ", "en", "b"),
    (7, "The The The The " * 40, "en", "c"),
    (8, "Released under the MIT License.\nGeneral Public License", "en", "c"),
    (9, "ein einziges" * 1 + " wort é ü 字 " * 30, "de", "c"),
    (10, "x" * 50_000, "en", "c"),
    (None, "a text without an id", "en", "c"),
    (2, f"{LINE}\nother ending", "en", "a"),
    (11, "you are an idiot and a clown " * 3, "en", "c"),
]
SCHEMA = "doc_id long, text string, lang string, source string"


@pytest.fixture(scope="module")
def docs(spark):
    df = spark.createDataFrame(TEXTS, SCHEMA)
    extra = {c: F.lit(1) for c in ("score", "size", "n_words", "key", "position", "kept", "_extra", "word", "n_lines", "labels", "toxic_label")}
    return df.withColumns(extra)


@pytest.fixture(scope="module")
def nothing(docs):
    return docs.limit(0)


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


# 1 packing


def test_packing(spark, docs, nothing):
    from tokenizers import Tokenizer

    path = queries.byte_bpe()
    tokenizer = Tokenizer.from_file(path)
    pieces = packing.tokenise(docs, path)
    rows = packing.pack(pieces).collect()
    want = collections.Counter()
    for doc_id, text, *_ in TEXTS:
        ids = tokenizer.encode(text or "", add_special_tokens=False).ids + [2]
        cuts = [0, *range((len(ids) - 1) % 1024 + 1, len(ids) + 1, 1024)]
        for i, (a, b) in enumerate(zip(cuts, cuts[1:])):
            want[doc_id, i, a, b - a, zlib.crc32(np.array(ids[a:b], dtype="<u4").tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in rows) == want
    bins = collections.defaultdict(list)
    for r in rows:
        bins[r.sequence_id].append((r.offset, r.length))
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 1024
    assert len(bins) <= -(-sum(r.length for r in rows) // 1024) + 1
    assert packing.pack(packing.tokenise(nothing, path)).count() == 0
    sequences = packing.sequences(spark, docs, path).collect()
    assert sum(len(s.ids) for s in sequences) == sum(r.length for r in rows)


def test_token_words():
    from tokenizers import Tokenizer

    path = queries.byte_bpe()
    tokenizer = Tokenizer.from_file(path)
    texts = ["", " ", "  a", "a  b", "a \nb", "\na", "a\n", " a", "a b ", "a\n\nb c", "x<|endoftext|>y z <|endoftext|> q", "é à b", "1 2 3's don't", "a \tb c", "　x y", "a᠎ b", "naïve 字 字字 !!! ?!"]
    got = [np.frombuffer(b, dtype="<u4").tolist() for b in packing.Tokens(path).encode(texts)]
    assert got == [tokenizer.encode(t, add_special_tokens=False).ids for t in texts]


def test_best_fit_rounds(spark, monkeypatch):
    """Many partitions and tiny blocks: rounds bring the bins near the bound (blocks of 50 leave a few per cent); bins that can't be paired stay, and the rounds end."""
    monkeypatch.setattr(packing, "BLOCK", 50)
    rng = np.random.default_rng(1)
    for lengths, extra in ((rng.integers(1, 1024, 600), 30), (np.full(300, 600), 0)):
        rows = [(i, i, 0, 0, int(x), 0) for i, x in enumerate(lengths)]
        got = packing.pack(spark.createDataFrame(rows, packing.PIECES).repartition(9)).collect()
        used = collections.Counter()
        for r in got:
            used[r.sequence_id] += r.length
        assert len(got) == len(rows) and max(used.values()) <= 1024
        bound = len(lengths) if not extra else -(-int(sum(lengths)) // 1024)
        assert len(used) <= bound + extra


# 2 Jaccard join


def brute_components(rows):
    sets = {}
    for i, t in rows:
        w = words(re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets[i] = {tuple(w[k : k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a in sets:
        for b in sets:
            both = len(sets[a] & sets[b])
            if a < b and sets[a] and sets[b] and 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(s), find(i)) for i, s in sets.items()}


def near_copies():
    rng = np.random.default_rng(5)
    rows = []
    for group in range(6):
        base = [f"w{x}" for x in rng.integers(0, 3000, int(rng.integers(6, 260)))]
        for _ in range(int(rng.integers(1, 14))):
            w = list(base)
            for _ in range(int(rng.integers(0, max(2, len(w) // 25)))):
                w[int(rng.integers(len(w)))] = f"e{rng.integers(10**6)}"
            rows.append((len(rows), " ".join(w)))
    boiler = " ".join(f"b{i}" for i in range(30))
    rows += [(len(rows) + i, boiler + " " + " ".join(f"u{x}" for x in rng.integers(0, 10**6, 12))) for i in range(25)]
    return rows + [(900, ""), (901, None), (902, "one"), (903, "ONE"), (904, "one two")]


@pytest.mark.parametrize("classed, frequent, many", [(32, 400, 64), (2, 3, 64), (2, 3, 3), (32, 400, 2)])
def test_jaccard_join(spark, monkeypatch, classed, frequent, many):
    """All links of brute force, also when nearly all shared tokens are frequent and stand in combinations, and when most entries are indexed again."""
    monkeypatch.setattr(jaccard, "LEAST_CLASSED", classed)
    monkeypatch.setattr(jaccard, "LEAST_FREQUENT", frequent)
    monkeypatch.setattr(jaccard, "MANY", many)
    rows = near_copies()
    got = jaccard.link(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got.collect()} == brute_components(rows)


def test_entries_meet():
    """Similar sets share an entry, whatever is frequent: the guarantee behind the join."""
    rng = np.random.default_rng(2)
    for _ in range(300):
        n = int(rng.integers(1, 700))
        a = np.unique(rng.integers(-(2**63), 2**63 - 1, n))
        most = len(a) // 9
        gone, more = int(rng.integers(0, most + 1)), 0
        more = most - gone
        b = np.unique(np.r_[rng.permutation(a)[gone:], rng.integers(-(2**63), 2**63 - 1, more)])
        both = len(np.intersect1d(a, b))
        if 100 * both < 80 * (len(a) + len(b) - both):
            continue
        frequent = np.sort(rng.permutation(np.r_[a, b])[: int(rng.integers(0, len(a) + len(b) + 1))])
        known = np.unique(frequent)
        for counts in (np.full(len(known), 1000), rng.integers(30, 900, len(known))):
            assert len(np.intersect1d(jaccard.entries(a, known, counts), jaccard.entries(b, known, counts)))


def test_jaccard_edges(docs, nothing):
    got = {(r.doc_id, r.n_shingles): r.component_id for r in jaccard.link(docs).collect()}
    assert got[3, 58] == 1 and got[4, 0] == 4 and got[5, 0] == 5 and got[None, 1] is None
    assert jaccard.link(nothing).count() == 0


def test_components(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, 99), (99, 98), (7, 7)]
    got = {r.node: r.root for r in graph.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(41)} | {98: 98, 99: 98, 100: 98}


# 3 licences


def test_licenses(docs, nothing):
    rows = licenses.scan(docs).collect()
    assert len(rows) == len(TEXTS)
    r = next(x for x in rows if x.doc_id == 8)
    assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels, r.labels, r.score) == (8, 2, 3, 5, "gpl,mit", "gpl,mit", 1.0)
    assert all((x.n_base, x.labels, x.score) == (0, "", 0.0) and x.first_word is None for x in rows if x.doc_id != 8)
    assert licenses.scan(nothing).count() == 0


def test_license_places(spark):
    """Places of base phrases as in a search of all words, whatever stands between them."""
    rng = np.random.default_rng(3)
    rows = [(i, " ".join(rng.choice(["mit", "MIT", "license", "apache", "general", "public", "x", "é", "-"], 60))) for i in range(60)]
    found = {r.doc_id: (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for i, t in rows:
        w = licenses.words_of(t)
        at = [(k, label) for p, label in licenses.BASE for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        places = [k for k, _ in at]
        assert found[i] == (len(w), len(at), min(places, default=None), max(places, default=None), ",".join(sorted({x for _, x in at})))


def test_license_texts():
    """Whole texts and notices are found at any place in a file, also with words put in and left out; parts of them that don't reach the score aren't."""
    rng = np.random.default_rng(4)
    index = licenses.Index(1000, {w: 300 for w in ("the", "of", "to", "this", "is", "and", "in", "or")})
    for label, text, _ in licenses.TEMPLATES:
        w = licenses.words_of(text)
        for edits in (0, len(w) // 40):
            own = list(w)
            for _ in range(edits):
                k = int(rng.integers(len(own) // 3, len(own)))
                own[k : k + 1] = [] if rng.random() < 0.5 else [own[k], "inserted"]
            filler = [f"f{x}" for x in rng.integers(0, 500, int(rng.integers(0, 400)))]
            _, _, found = index.scan([*filler, *own, *filler[:7]])
            assert label in found and (edits or found[label] > 0.999)
        _, _, found = index.scan(list(rng.permutation([*w, *w])) if len(w) > 12 else w[:1])
        assert label not in found


# 4 mixing


def test_mixing(docs, nothing):
    rows = mixing.plan(mixing.measure(docs)).collect()
    assert len(rows) == len(TEXTS) and all(r.taken <= 3 * r.size for r in rows)
    total = sum(r.size for r in rows)
    by = collections.defaultdict(int)
    for r in rows:
        by[r.source] += r.taken
        assert (r.position is None) == (r.taken == 0) and (r.position is None or 0 <= r.position <= 1)
    for r in rows:
        assert abs(by[r.source] - r.target) <= 1 and r.target <= 3 * r.source_size + 1e-6
    assert abs(sum({r.source: r.target for r in rows}.values()) - total) < 1e-6
    assert mixing.plan(mixing.measure(nothing)).count() == 0
    mixed = mixing.mix(docs).collect()
    places = [r.position for r in mixed]
    assert places == sorted(places) and all(r.text for r in mixed) and mixing.mix(nothing).count() == 0


def test_water_filling(spark):
    """Targets as by resharing the excess again and again."""
    rng = np.random.default_rng(4)
    for _ in range(3):
        sizes = {f"s{i:02}": int(x) for i, x in enumerate(rng.integers(0, 1000, 8) ** 2 // 50)}
        left, target, weight = set(sizes), {}, {s: i % 3 + 1 for i, s in enumerate(sorted(sizes))}
        rest = sum(sizes.values())
        while True:
            share = {s: rest * weight[s] / sum(weight[x] for x in left) for s in left}
            over = {s for s in left if share[s] > 3 * sizes[s]}
            if not over:
                break
            for s in over:
                target[s] = 3 * sizes[s]
                rest -= target[s]
            left -= over
        target |= share
        got = {r.source: r.target for r in mixing.targets(spark.createDataFrame(list(sizes.items()), "source string, size long")).collect()}
        assert all(abs(got[s] - target[s]) < 1e-6 * (1 + target[s]) for s in sizes)


# 5 and 8 classifiers


def test_quality_model(spark, docs, nothing):
    sf = "/root/testdata/sf0.01"
    table, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/labels.parquet")
    got = {r.doc_id: r for r in quality_model.classify(table, labels).select("doc_id", "held_out", "score", "predicted").collect()}
    assert len(got) == table.count() and all(r.held_out == (zlib.crc32(str(i).encode()) % 4 == 2) and 0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for i, r in got.items())
    known = [(got[r.doc_id].predicted, r.quality) for r in labels.collect() if got[r.doc_id].held_out]
    good = [p for p, q in known if q == 1]
    assert sum(p == q for p, q in known) / len(known) > 0.9 and sum(good) / len(good) > 0.9
    few = spark.createDataFrame([(1, 1), (7, 0), (2, None)], "doc_id long, quality int")
    assert quality_model.classify(docs, few).count() == len(TEXTS) and quality_model.classify(nothing, few).count() == 0
    assert {r.score for r in quality_model.classify(docs, few.limit(0)).collect()} == {0.5}


def test_bounded_sample(spark):
    """A table of one repeated id is thinned like any other."""
    df = spark.range(20_000).select(F.lit(1).alias("doc_id"))
    assert 700 < quality_model.thin(df, 1000).count() < 1300 and quality_model.thin(df.limit(10), 1000).count() == 10


def test_held_out_toxicity(spark):
    """On documents whose labels weren't learnt from."""
    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    table = spark.read.parquet(f"{sf}/documents.parquet").join(labels.select("doc_id"), "doc_id", "left_semi")
    got = {r.doc_id: r for r in toxicity.classify(table, labels).select("doc_id", "held_out", "predicted").collect()}
    known = [(got[r.doc_id].predicted, r.toxic) for r in labels.collect() if got[r.doc_id].held_out]
    toxic, clean = [p for p, t in known if t], [p for p, t in known if not t]
    assert len(toxic) > 5 and sum(toxic) / len(toxic) > 0.6 and sum(clean) / len(clean) < 0.02


def test_prior_estimate():
    rng = np.random.default_rng(0)
    good, bad = rng.normal(3, 1, 4000), rng.normal(-3, 1, 1000)
    assert abs(quality_model.estimate_prior(rng.normal(3, 1, 4000), np.r_[good, bad]) - 0.8) < 0.06


def test_toxicity(spark, docs, nothing):
    rng = np.random.default_rng(6)
    plain = [f"p{i}" for i in range(300)]
    rows = []
    for i in range(400):
        w = list(rng.choice(plain, 30)) + (["women"] if i % 4 < 2 else [])
        toxic = int(i % 4 == 0)
        rows.append((i, " ".join(w + (["idiot", "clown"] if toxic else [])), toxic))
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(table.drop("toxic"), table.select("doc_id", "toxic"))
    score = {r.doc_id: r.score for r in toxicity.score(table, model).collect()}
    assert all((score[i] >= 0.5) == bool(t) for i, _, t in rows)
    assert abs(model["weights"].get("women=", 0.0) - model["weights"].get("men=", 0.0)) < 0.3
    got = toxicity.classify(docs, table.select("doc_id", "toxic"))
    assert got.count() == len(TEXTS) and toxicity.classify(nothing, table.select("doc_id", "toxic")).count() == 0
    assert {r.score for r in toxicity.classify(docs, table.select("doc_id", "toxic").limit(0)).collect()} == {0.0}


def test_counterfactual_swaps():
    assert toxicity.counterfactual("The Women, x; women9 men") == "the men, x; women9 girls"
    for term, other in toxicity.SWAP.items():
        left = toxicity.terms_of(toxicity.counterfactual(f"a {term} wrote")) & toxicity.terms_of(term)
        assert left <= toxicity.terms_of(other)  # nothing of the name stays but what both begin with
        assert toxicity.terms_of(other) <= toxicity.terms_of(toxicity.counterfactual(f"a {term} wrote"))


def test_names_alone_are_not_toxic(spark):
    """Half of the toxic rows name a group that no clean row names: the name alone isn't marked."""
    rng = np.random.default_rng(1)
    fill = [f"word{k}" for k in range(60)]
    rows = [(i, " ".join([*rng.choice(fill, 8), *(["idiot"] if i % 4 == 0 else []), *(["a muslim wrote"] if i % 8 == 0 else [])]), int(i % 4 == 0)) for i in range(400)]
    table = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(table.drop("toxic"), table.select("doc_id", "toxic"))
    asked = spark.createDataFrame([(1, "a muslim wrote word1"), (2, "word2 idiot word3"), (3, "a christian wrote word1")], "doc_id long, text string")
    score = {r.doc_id: r.score for r in toxicity.score(asked, model).collect()}
    assert score[1] < 0.5 < score[2] and abs(score[1] - score[3]) < 0.1


# 6 line dedup


def brute_lines(rows, least=50):
    seen = []
    out = {}
    for i, t in sorted(rows):
        lines = [(p, x) for p, x in enumerate(t.split("\n")) if words(x)]
        gone = set()
        for a in range(len(lines)):
            for other, b in [(o, b) for o in [*seen, lines] for b in range(len(o))]:
                if other is lines and b >= a:
                    continue
                k = 0
                while a + k < len(lines) and b + k < len(other) and lines[a + k][1] == other[b + k][1]:
                    k += 1
                if k and sum(len(words(x)) for _, x in lines[a : a + k]) >= least:
                    gone.update(range(lines[a][0], lines[a + k - 1][0] + 1))
        seen.append(lines)
        out[i] = "\n".join(x for p, x in enumerate(t.split("\n")) if p not in gone)
    return out


def test_line_dedup(spark):
    rng = np.random.default_rng(8)
    pool = [" ".join(f"l{i}_{k}" for k in range(int(n))) for i, n in enumerate(rng.integers(1, 30, 25))]
    rows = []
    for i in range(40):
        start, more = int(rng.integers(20)), int(rng.integers(1, 8))
        lines = [*rng.choice(pool, 2), *pool[start : start + more], f"own {i}", "", *pool[:more], *pool[:more]]
        rows.append((i, "\n".join(map(str, lines))))
    got = {r.doc_id: r.text for r in line_dedup.dedup(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()}
    assert got == brute_lines(rows)


def test_line_dedup_edges(docs, nothing):
    rows = line_dedup.dedup(docs).collect()
    text = collections.defaultdict(set)
    for r in rows:
        text[r.doc_id].add(r.text)
    assert len(rows) == len(TEXTS) and text[4] == {None} and text[5] == {""}
    assert text[1] == {TEXTS[0][1]} and text[2] == {"other ending"} and text[3] == {""}
    assert line_dedup.dedup(nothing).count() == 0
    named = docs.withColumns({c: F.lit(7) for c in ("_d", "_t", "_ranges", "_doc", "_x", "_text", "idx", "line")})
    for found in (line_dedup.dedup(named), quality_model.score(named, None), quality_rules.judge(named)):
        assert {(r["_d"], r["_t"], r["_ranges"], r["_doc"], r["_x"], r["_text"], r["idx"], r["line"]) for r in found.collect()} == {(7,) * 8}


# 7 fingerprints


def test_simhash(spark, docs, nothing, monkeypatch):
    monkeypatch.setattr(simhash, "RANGE_ROWS", 3)
    unique = docs.filter("doc_id is not null").dropDuplicates(["doc_id"])
    rows = {r.doc_id: r for r in simhash.compare(unique).collect()}
    order = sorted(((i, t or "") for i, t in {i: t for i, t, *_ in TEXTS if i is not None}.items()), reverse=True)
    for (i, t), (j, u) in zip(order, order[1:] + order[:1]):
        k = len(t) // 3
        assert (rows[i].n_chars, rows[i].edited_sha256) == (len(t), hashlib.sha256((t[: len(t) - k] + u[:k]).encode()).hexdigest())
        apart = bin(int(rows[i].fingerprint, 16) ^ int(rows[j].fingerprint, 16)).count("1")
        assert rows[i].near_next == 1 - apart / 128
    assert rows[2].fingerprint == rows[3].fingerprint and rows[4].fingerprint == "0" * 32
    assert simhash.compare(docs).count() == len(TEXTS) and simhash.compare(nothing).count() == 0


def test_search_within_radius(spark):
    rng = np.random.default_rng(9)
    base = [int.from_bytes(rng.bytes(16), "big") for _ in range(30)]
    prints = base + [b ^ sum(1 << int(x) for x in rng.choice(128, int(rng.integers(0, 6)), replace=False)) for b in base for _ in range(4)]
    df = spark.createDataFrame([(f"{p:032x}",) for p in prints], "fingerprint string")
    counts = collections.Counter(f"{p:032x}" for p in prints)
    want = {(a, b, n) for a in counts for b, n in counts.items() if bin(int(a, 16) ^ int(b, 16)).count("1") <= 3}
    assert sorted(map(tuple, simhash.within(df, df).collect())) == sorted(want)


# 9 archives


def test_warc(spark):
    rows = [(3, "http://x/a b", "<p>é</p>"), (1, None, "<p>é</p>"), (2, "http://y\r\nZ: 1", None), (4, "u", ""), (5, "u", "a\r\n\r\nb"), (None, "u", "<p>é</p>"), (5, "u", "a\r\n\r\nb")]
    index = warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("offset", F.lit(1)))
    assert index.count() == len(rows)
    got = sorted(((r.page_id or 0, r.record_type, r.refers_to, r.payload_bytes, r.url, None if r.payload is None else bytes(r.payload).decode()) for r in warc.read(index).collect()), key=str)
    want = [(3, "revisit", 1, 9, "http://x/a b", None), (1, "response", None, 9, None, "<p>é</p>"), (2, "response", None, 0, "http://y\r\nZ: 1", ""), (4, "revisit", 2, 0, "u", None), (0, "revisit", 1, 9, "u", None)] + [(5, "response", None, 6, "u", "a\r\n\r\nb")] * 2
    assert got == sorted(want, key=str)
    some = warc.read(index.filter("page_id = 3"), with_payload=False).collect()
    assert len(some) == 1 and some[0].intact
    assert warc.read(warc.write(spark.createDataFrame([], "page_id long, url string, html string"))).count() == 0


# 10 quality rules


def brute_rules(text):
    w = words(text)
    grams = collections.Counter(tuple(w[i : i + 3]) for i in range(len(w) - 2))
    covered = {k for i in range(len(w) - 2) if grams[tuple(w[i : i + 3])] > 1 for k in range(i, i + 3)}
    lines = [x for x in (text or "").split("\n") if words(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(covered)


def test_quality_rules(spark, docs, nothing):
    rng = np.random.default_rng(10)
    more = [(100 + i, "\n".join(" ".join(rng.choice(list("abcdef#|é"), int(rng.integers(0, 60)))) for _ in range(int(rng.integers(1, 6)))), "en", "a") for i in range(60)]
    table = spark.createDataFrame(TEXTS + more, SCHEMA)
    got = collections.Counter((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality_rules.judge(table).collect())
    want = collections.Counter()
    for i, t, *_ in TEXTS + more:
        m = brute_rules(t)
        want[(i, *m, m[0] < 50 or 100 * m[4] > 50 * m[0])] += 1
    assert got == want
    judged = quality_rules.judge(docs).collect()
    assert len(judged) == len(TEXTS) and all(not (r.kept and r.base_failed) for r in judged) and quality_rules.judge(nothing).count() == 0
