"""Operators 1, 3, 4, 9 and 10, and the pipeline, against brute force."""

import hashlib
import math
import random
import re
import time
from collections import Counter
from functools import lru_cache

import numpy as np
import public_tokenizers
import pytest
import xxhash
from pyspark.sql import functions as F

from tabloom.llm import blocks, decontaminate, kneser_ney, lattice, simhash, substrings
from tabloom.llm.components import components

from .helpers import awkward, empty, prose

PIECES = str(public_tokenizers.path("piece_bpe_32k.model"))


@pytest.fixture
def small_blocks(monkeypatch):
    monkeypatch.setattr(blocks.blocked, "__defaults__", ("doc_id", "text", 4000))


def split(text):
    return [w for w in re.split(r"[\x20\x09-\x0D]+", text or "") if w]


def test_lattice_sums_all_segmentations():
    names, prior = lattice.pieces(PIECES)
    model = lattice.Lattice(names, prior)
    weight = dict(zip(names[256:], prior[256:]))

    @lru_cache
    def brute(s):
        if not s:
            return 1.0
        total = sum(math.exp(weight[s[:k]]) * brute(s[k:]) for k in range(1, len(s) + 1) if s[:k] in weight)
        if s[0] not in weight:
            total += math.exp(sum(prior[b] for b in s[0].encode())) * brute(s[1:])
        return total

    words = ["the", "stone", "über", "日本", "a", "▁x", "123", "internationalisation"]
    got = model.marginals([w.encode() for w in words])
    assert got == pytest.approx([math.log(brute(lattice.START + w)) for w in words], rel=1e-9)
    expected = model.expected([b"stone"], np.ones(1))
    starts = sum(n for n, p in zip(expected, names) if p.startswith(lattice.START))
    assert starts == pytest.approx(1.0)


def test_long_words_of_a_lattice(monkeypatch):
    """One word at a time, in short reaches, against many at once."""
    names, prior = lattice.pieces(PIECES)
    model, rng = lattice.Lattice(names, prior), random.Random(3)
    words = ["".join(rng.choice("theingaüz日😀0") for _ in range(n)).encode() for n in (1, 30, 200, 255)]
    times = np.array([1.0, 2.0, 3.0, 1.0])
    short, expected = model.marginals(words), model.expected(words, times)
    monkeypatch.setattr(lattice, "LONG", 0)
    monkeypatch.setattr(lattice, "REACH", 17)
    assert model.marginals(words) == pytest.approx(short, rel=1e-9)
    assert model.expected(words, times) == pytest.approx(expected, rel=1e-6, abs=1e-9)
    monkeypatch.undo()
    assert np.isfinite(model.marginals([b"aB3x" * 25_000])).all()


def test_lattice_scores(spark, small_blocks):
    docs, rows = awkward(spark)
    train = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 != 1
    got = lattice.score(docs.withColumn("score", F.lit(0)), PIECES, train, rounds=1).collect()
    import zlib

    lower = lambda t: [w.lower() for w in (t or "").encode().split()] + [b""]
    on = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 != 1
    c = Counter(w for i, t, *_ in rows if on(i) for w in lower(t))
    n, v = sum(c.values()), len(c)
    want = sorted((str(i), not on(i), len(lower(t)), sum(c[w] > 0 for w in lower(t)), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in lower(t)), 6)) for i, t, *_ in rows)
    assert sorted((str(r.doc_id), r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in got) == want
    assert all(r.score < 0 and math.isfinite(r.score) for r in got)
    assert lattice.score(empty(spark), PIECES, F.lit(True), rounds=1).count() == 0
    assert all(r.n_known == 0 for r in lattice.score(docs.limit(3), PIECES, F.lit(False), rounds=1).collect())


def text_hash(text):
    """Spark's xxhash64 of a string: of a null, its seed."""
    h = 42 if text is None else xxhash.xxh64_intdigest(text.encode(), 42)
    return h - (1 << 64) if h >> 63 else h


def brute_removal(rows, window):
    seen, out = set(), []
    for i, t in sorted(((i, t) for i, t, *_ in rows), key=lambda r: (r[0] is None, r[0] or 0, text_hash(r[1]))):
        words = (t or "").encode().split()
        gone = [False] * len(words)
        for s in range(len(words) - window + 1):
            key = tuple(words[s : s + window])
            if key in seen:
                gone[s : s + window] = [True] * window
            seen.add(key)
        kept = b" ".join(w for w, g in zip(words, gone) if not g)
        out.append((str(i), len(words), sum(gone), hashlib.sha256(kept).hexdigest(), kept.decode()))
    return sorted(out)


@pytest.mark.parametrize("window, many", [(5, 32), (20, 32), (5, 1), (20, 2)])
def test_substrings(spark, small_blocks, window, many):
    docs, rows = awkward(spark)
    # one id, and none, with several texts that share passages
    more = [(i, " ".join(split(rows[k][1])[:30] + split(prose(random.Random(k), 10))), "en", "s", 1) for k in range(12) for i in (7, None)]
    docs, rows = docs.unionByName(spark.createDataFrame(more, docs.schema)), rows + more
    got = substrings.without_repeats(docs.withColumn("n_words", F.lit(1)), window, kept_text=True, many=many).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256, r.kept) for r in got) == brute_removal(rows, window)
    assert substrings.without_repeats(empty(spark)).count() == 0


def test_suffix_automaton():
    rng = random.Random(4)
    for _ in range(200):
        text = [rng.choice("ab") for _ in range(30)]
        automaton = substrings.SuffixAutomaton()
        for i, c in enumerate(text):
            got = automaton.extend(c)
            want = max((k for k in range(i + 1) if any(text[j : j + k] == text[i + 1 - k : i + 1] for j in range(i + 1 - k))), default=0)
            assert got == want


def test_few_letters_many_repeats(spark, small_blocks):
    rng = random.Random(6)
    rows = [(i, " ".join(rng.choice("ab") for _ in range(rng.randint(0, 400)))) for i in range(30)]
    got = substrings.without_repeats(spark.createDataFrame(rows, "doc_id long, text string"), 9, kept_text=True).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_removed, r.kept_sha256, r.kept) for r in got) == brute_removal(rows, 9)


def test_kneser_ney_is_a_distribution(spark):
    docs, _ = awkward(spark, n=15, long=50)
    model = kneser_ney.train(docs, 3)
    grams = kneser_ney.gram_counts(docs, 3).collect()
    letters = sorted({g.gram[-1] for g in grams})
    for context in {g.gram[:2] for g in grams[:60]} | {"qz"}:
        assert 0.9 < np.exp(model.windows([context + c for c in letters])).sum() < 1.0 + 1e-9


def brute_kneser_ney(texts, order):
    """word -> natural log of its probability, by the formula over plain dictionaries."""
    first, last = kneser_ney.FIRST, kneser_ney.LAST
    counts = {order: Counter()}
    for t in texts:
        for w in (t or "").split():
            line = first * (order - 1) + w + last
            counts[order].update(line[i : i + order] for i in range(len(line) - order + 1))
    for k in range(order - 1, 0, -1):
        counts[k] = Counter(g[1:] for g in counts[k + 1])
    off, totals, left = {}, {}, {}
    for k, of in counts.items():
        d = kneser_ney.discounts(tuple(sum(c == i for c in of.values()) for i in range(1, 5)))
        off[k] = lambda c, d=d: d[min(c, 3) - 1]
        totals[k], left[k] = Counter(), Counter()
        for g, c in of.items():
            totals[k][g[:-1]] += c
            left[k][g[:-1]] += off[k](c)

    def p(g):
        k = len(g)
        if not k:
            return 1 / (len(counts[1]) + 1)
        c, context = counts[k][g], g[:-1]
        if not totals[k][context]:
            return p(g[1:])
        return ((c - off[k](c)) / totals[k][context] if c else 0) + left[k][context] / totals[k][context] * p(g[1:])

    def score(w):
        line = first * (order - 1) + w + last
        return sum(math.log(p(line[i : i + order])) for i in range(len(line) - order + 1))

    return score


def test_perplexities_and_thresholds_by_brute_force(spark):
    rng = random.Random(12)
    long = "".join(rng.choice("abcde") for _ in range(700))
    rows = [(i, prose(rng, rng.randint(20, 60)) + (" " + long[: 60 + i] if i % 3 == 0 else ""), "en" if i % 2 else "de") for i in range(60)] + [(100, long, "en"), (101, "", "en"), (102, None, None), (103, "日本 über", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(50)] + [(7, 0, 0)], "doc_id long, quality int, toxic int")
    half = {r.i: r.h == 0 for r in spark.createDataFrame([(i,) for i in range(50)], "i long").select("i", F.pmod(F.xxhash64("i"), F.lit(2)).alias("h")).collect()}
    score = brute_kneser_ney([t for i, t, _ in rows if i < 50 and i != 7 and half[i]], 4)
    want = {i: math.exp(-sum(map(score, t.split())) / (sum(map(len, t.split())) + len(t.split()))) if (t or "").split() else None for i, t, _ in rows}
    got = {r.doc_id: r for r in kneser_ney.classify(docs, labels, order=4, quantile=0.9, slack=1.1).collect()}
    for i, p in want.items():
        assert got[i].perplexity == (p if p is None else pytest.approx(p, rel=1e-9))
    for lang in ("en", "de"):
        trusted = sorted(want[i] for i, _, g in rows if i < 50 and i != 7 and not half[i] and g == lang)
        cut = 1.1 * trusted[math.ceil(0.9 * len(trusted)) - 1]
        assert len(trusted) * 0.1 < 1 or got[next(i for i, _, g in rows if g == lang)].threshold == pytest.approx(cut, rel=1e-6)
        assert all(not got[i].keep for i, _, g in rows if g == lang and (want[i] is None or want[i] > got[i].threshold))


def test_kneser_ney_by_hand(spark):
    """Bigrams of two words, from the formula."""
    docs = spark.createDataFrame([("ab ab ac",)], "text string")
    model = kneser_ney.train(docs, 2)
    d1, d2, d3 = kneser_ney.discounts((1, 3, 0, 0))
    e1, e2, e3 = kneser_ney.discounts((3, 1, 0, 0))
    # bigrams: ^a 3, ab 2, ac 1, b$ 2, c$ 1; continuations: a 1, b 1, c 1, $ 2
    off = {1: d1, 2: d2, 3: d3}
    seen = Counter({1: 2, 2: 2, 3: 1})
    d1, d2, d3 = kneser_ney.discounts((seen[1], seen[2], seen[3], 0))
    off = {1: d1, 2: d2, 3: d3}
    lower = lambda c: ((2 - e2) if c == "$" else (1 - e1)) / 5 + (3 * e1 + e2) / 5 / 5
    want = [(2 - off[2]) / 3 + (off[1] + off[2]) / 3 * lower("b"), (3 - off[3]) / 3 + off[3] / 3 * lower("a"), (2 - off[2]) / 2 + off[2] / 2 * lower("$")]
    assert model.scores(["ab"])[0] == pytest.approx(sum(map(math.log, want)), rel=1e-9)


def test_quality(spark):
    rng = random.Random(3)
    good = [(i, prose(rng, 60), "en" if i % 2 else None) for i in range(80)]
    bad = [(100 + i, " ".join("#" * rng.randint(1, 9) + "QXJ!!" * rng.randint(1, 3) for _ in range(30)), "en") for i in range(8)]
    docs = spark.createDataFrame([*good, *bad, (200, None, "en"), (201, "", None), (None, prose(rng, 20), "en"), good[0]], "doc_id long, text string, lang string").withColumn("threshold", F.lit("clash"))
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)] + [(100, 0, 0), (3, 0, 0), (4, 1, 1), (5, 1, None), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = kneser_ney.classify(docs, labels, order=4)
    kept = [(r.doc_id, r.keep) for r in got.collect()]
    assert len(kept) == 92 and all(k for i, k in kept if i is not None and i < 100) and not any(k for i, k in kept if i is not None and i >= 100)
    assert kneser_ney.classify(docs, labels.limit(0), order=3).where("keep").count() == 90
    assert kneser_ney.classify(docs.limit(0), labels, order=3).count() == 0


def test_quality_of_repeats(spark):
    """Known words over and over, in the whole text or at its end."""
    rng = random.Random(5)
    good = [(i, prose(rng, 120), "en") for i in range(80)]
    word = good[0][1].split()[0]
    bad = [(100, " ".join([word] * 200), "en"), (101, prose(rng, 100) + f" {word}" * 60, "en"), (102, " ".join(prose(rng, 3).split() * 40), "en")]
    docs = spark.createDataFrame([*good, *bad], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in kneser_ney.classify(docs, labels, order=4).collect()}
    assert all(got[i].keep for i in range(80)) and not any(got[i].keep for i in (100, 101, 102))
    texts = [[rng.randrange(rng.choice([2, 30, 500])) for _ in range(rng.choice([1, 2, 3, 19, 20, 21, 40, 200]))] for _ in range(300)]
    size = kneser_ney.PASSAGE
    want = [min(len(set(t[i : i + size])) / min(len(t), size) for i in range(max(1, len(t) - size + 1))) for t in texts]
    assert kneser_ney.variety(np.array(sum(texts, [])), np.array(list(map(len, texts)))).tolist() == pytest.approx(want)


def test_quality_of_toxic_documents(spark):
    """Words of documents labelled toxic, in any case and between signs; words that all have don't count."""
    rng = random.Random(8)
    good = [(i, prose(rng, 80), "en") for i in range(120)]
    bad = [(200 + i, prose(rng, 40) + f" {rng.choice(['Vile', 'vile!', '(vile)'])} " + prose(rng, 40), "en") for i in range(60)]
    docs = spark.createDataFrame([*good, *bad], "doc_id long, text string, lang string")
    labels = spark.createDataFrame([(i, 1, 0) for i in range(100)] + [(200 + i, 1, 1) for i in range(40)], "doc_id long, quality int, toxic int")
    kept = {r.doc_id for r in kneser_ney.classify(docs, labels, order=4).where("keep").collect()}
    assert max(kept) < 200
    assert kneser_ney.folded("(Vile!)") == "vile" and kneser_ney.folded("--") == ""
    # without enough documents that have it, a word says nothing
    more = {r.doc_id for r in kneser_ney.classify(docs, labels, order=4, least=100).where("keep").collect()}
    assert {i for i in more if i < 200} == kept and len(kept) >= 118 and len(more) - len(kept) >= 58


def brute_contamination(rows, items, window=8):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    shingles = {}
    for k, t in items:
        w = words(t)
        for i in range(max(1, len(w) - window + 1)) if w and k is not None else ():
            shingles.setdefault(tuple(w[i : i + window]), set()).add(str(k))
    out = []
    for i, t, *_ in rows:
        w, hit, found = words(t), set(), set()
        for s, ids in shingles.items():
            for a in range(len(w) - len(s) + 1):
                if tuple(w[a : a + len(s)]) == s:
                    hit |= set(range(a, a + len(s)))
                    found |= ids
        out.append((str(i), len(w), len(hit), len(found), ",".join(sorted(found)), len(found) >= 2))
    return sorted(out)


@pytest.mark.parametrize("block", [3, 20, 100_000])
def test_decontamination(spark, block):
    docs, rows = awkward(spark, n=20, long=200)
    rng = random.Random(8)
    texts = [r[1] for r in rows if r[1] and len(split(r[1])) > 30]
    items = [(k, " ".join(split(t)[3 : 3 + rng.randint(4, 25)]).upper()) for k, t in enumerate(texts[:7])] + [(50, None), (51, ""), (52, "fox"), (None, texts[0]), (2, "the of"), (60, "!!")]
    table = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.contamination(docs.withColumn("n_hit", F.lit("x")).withColumn("places", F.lit(1)), table, block=block).collect()
    assert sorted((str(r.doc_id), r.n_words, r.n_hit, r.n_items, ",".join(r.item_ids), r.contaminated) for r in got) == brute_contamination(rows, items)
    assert decontaminate.contamination(empty(spark), table).count() == 0
    assert decontaminate.contamination(docs, table.limit(0)).where("n_items > 0").count() == 0


def brute_groups(rows, words, radius):
    prints = []
    for i, t, *_ in rows:
        w = (t or "").encode().lower().split()
        found = [b" ".join(w[k : k + words]) for k in range(max(1, len(w) - words + 1))] if w else []
        h = [xxhash.xxh64_intdigest(s, 42) for s in found]
        prints.append(sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)))
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in range(len(rows)):
        for b in range(a):
            if (prints[a] ^ prints[b]).bit_count() <= radius:
                root[find(a)] = find(b)
    least = {}
    for a, (i, *_) in enumerate(rows):
        if i is not None:
            least[find(a)] = min(i, least.get(find(a), i))
    return sorted((str(i), format(prints[a], "016x"), str(least.get(find(a)))) for a, (i, *_) in enumerate(rows))


@pytest.mark.parametrize("words, radius", [(4, 4), (2, 7), (1, 3), (4, 0)])
def test_simhash(spark, words, radius):
    docs, rows = awkward(spark, n=60, long=300)
    got = simhash.near_duplicates(docs.withColumn("fingerprint", F.lit(1)), words, radius).collect()
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == brute_groups(rows, words, radius)
    assert simhash.near_duplicates(empty(spark)).count() == 0


@pytest.mark.parametrize("radius", [2, 4, 7])
def test_links_of_crowded_buckets(spark, radius, monkeypatch):
    """Many fingerprints a few bits apart: the same components, by a forest where a bucket is large."""
    rng = random.Random(radius)
    centres = [rng.getrandbits(64) for _ in range(4)]
    values = {c ^ sum(1 << rng.randrange(64) for _ in range(rng.randint(0, 5))) & (1 << 64) - 1 for c in centres for _ in range(60)}
    signed = [v - (1 << 64) if v >> 63 else v for v in values]
    nodes = spark.createDataFrame([(v,) for v in signed], "fingerprint long")
    edges = [(r.a, r.b) for r in simhash.links(nodes, radius).collect()]
    assert all(((a ^ b) & (1 << 64) - 1).bit_count() <= radius for a, b in edges)
    assert classes(signed, edges) == classes(signed, [(a, b) for a in signed for b in signed if a < b and ((a ^ b) & (1 << 64) - 1).bit_count() <= radius])


def classes(nodes, edges):
    root = {n: n for n in nodes}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return sorted((n, find(n)) for n in nodes)


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randint(0, 80), rng.randint(0, 80)) for _ in range(60)] + [(100 + i, 101 + i) for i in range(40)] + [(5, 5), (1, 2), (1, 2)]
    got = sorted((r.node, r.root) for r in components(spark.createDataFrame(edges, "a long, b long")).collect())
    nodes = {x for a, b in edges for x in (a, b) if a != b}
    assert got == classes(nodes, [e for e in edges if e[0] != e[1]])
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def five_words(text):
    words = (text or "").encode().lower().split()
    return frozenset(tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))) if words else frozenset()


def brute_firsts(rows, least=0.8):
    """(id, text) of the rows that stay, by all pairs of the distinct sets; of repeated rows one."""
    named = sorted({(i, t) for i, t, *_ in rows if i is not None}, key=lambda r: (r[0], r[1] or ""))
    sets = [five_words(t) for _, t in named]
    pairs = [(a, b) for a in range(len(sets)) for b in range(a) if sets[a] == sets[b] or len(sets[a] & sets[b]) >= least * len(sets[a] | sets[b])]
    roots = dict(classes(range(len(named)), pairs))
    groups = {}
    for k, (i, _) in enumerate(named):
        groups.setdefault(roots[k], []).append(i)
    return sorted(str(min(g)) for g in groups.values()) + sorted(str(i) for i, *_ in rows if i is None)


@pytest.mark.parametrize("meeting", [1 << 20, 50])
def test_first_copies(spark, meeting):
    docs, rows = awkward(spark, n=30, long=300)
    got = simhash.first_copies(docs.withColumn("component_id", F.lit(1)).withColumn("h", F.lit(1)).withColumn("id", F.lit(1)), meeting=meeting)
    assert got.columns == [*docs.columns, "component_id", "h", "id"]
    got = [(r.doc_id, r.text) for r in got.collect()]
    assert sorted(str(i) for i, _ in got if i is not None) + sorted(str(i) for i, _ in got if i is None) == brute_firsts(rows)
    assert simhash.first_copies(empty(spark)).count() == 0


def test_first_copies_of_repeated_ids(spark):
    """One id with texts of two groups."""
    a, b = (prose(random.Random(k), 40) for k in (1, 2))
    rows = [(5, a), (5, b), (2, a), (3, b), (3, b), (None, a), (9, "x"), (9, "x"), (9, "y")]
    got = simhash.first_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((str(r.doc_id), r.text) for r in got) == sorted([("2", a), ("3", b), ("None", a), ("9", "x"), ("9", "y")])


def test_first_copies_of_chains(spark):
    """Neighbours are alike, the ends aren't: the chain is one group, also where it meets in parts."""
    r = random.Random(7)
    rows, words = [], [f"w{r.randrange(300)}" for _ in range(120)]
    for k in range(12):
        rows.append(((k * 7) % 12, " ".join(words)))
        words = words[6:] + [f"w{r.randrange(300)}" for _ in range(6)]
    got = simhash.first_copies(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert [str(x.doc_id) for x in got] == brute_firsts(rows) == ["0"]


def test_first_copies_of_a_large_group(spark):
    """Copies of one text with so many words replaced that no two are alike, and some that are: all pairs in one place, in time."""
    r = random.Random(3)
    base = [f"w{r.randrange(300)}" for _ in range(300)]
    rows = []
    for k in range(2000):
        words = base[:]
        for i in r.sample(range(300), 8):
            words[i] = f"v{r.randrange(10**6)}"
        rows.append((k, " ".join(words)))
    rows += [(5000 + k, rows[k][1] + " end") for k in range(0, 2000, 100)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    began = time.monotonic()
    assert sorted(r.doc_id for r in simhash.first_copies(docs).collect()) == list(range(2000))
    assert time.monotonic() - began < 50


@pytest.mark.parametrize("universe", [12, 60, 400])
def test_tied(universe):
    r = random.Random(universe)
    for size in (0, 1, 7, 40, 90):
        base, sets = r.sample(range(universe), 12), []
        for _ in range(size):
            now = {*base} - {*r.sample(base, r.randrange(3))} | {r.randrange(universe) for _ in range(r.randrange(4))}
            sets.append(now if r.random() < 0.9 else set(r.sample(range(universe), r.randrange(12))))
            base = sorted(now) if r.random() < 0.4 and len(now) > 3 else base
        pairs = [(a, b) for a in range(size) for b in range(a) if sets[a] == sets[b] or len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])]
        want = [root for _, root in classes(range(size), pairs)]
        assert simhash.tied([np.array(sorted(s), np.uint64) for s in sets], 0.8).tolist() == want


@pytest.mark.parametrize("meeting, common", [(400, 500_000)])
def test_first_copies_at_any_size(spark, monkeypatch, meeting, common):
    """What stays depends neither on how many common shingles are known nor on whether a component meets in parts."""
    monkeypatch.setattr(simhash, "MOST_COMMON", common)
    r, rows = random.Random(11), []
    for g in range(3):
        words = [f"w{r.randrange(200)}" for _ in range(90)]
        for k in range(30):
            rows.append((g + 3 * (k * 7 % 30), " ".join(words)))
            words = words[4:] + [f"w{r.randrange(200)}" for _ in range(4)]
    rows += rows[:5] + [(7, rows[40][1]), (None, rows[0][1])]
    got = simhash.first_copies(spark.createDataFrame(rows, "doc_id long, text string"), meeting=meeting).collect()
    assert sorted(str(x.doc_id) for x in got if x.doc_id is not None) + ["None"] * sum(x.doc_id is None for x in got) == brute_firsts(rows)


@pytest.mark.parametrize("common", [500_000, 0])
def test_first_copies_whatever_shingles_are_common(spark, monkeypatch, common):
    """Chains below a passage that all have: where no common shingle is known, the passage makes them one component, which meets in parts."""
    monkeypatch.setattr(simhash, "MOST_COMMON", common)
    r, rows = random.Random(5), []
    passage = [f"p{k}" for k in range(20)]
    for g in range(12):
        words = [f"w{r.randrange(300)}" for _ in range(80)]
        for k in range(10):
            rows.append((g + 12 * (k * 7 % 10), " ".join(passage + words)))
            words = words[4:] + [f"w{r.randrange(300)}" for _ in range(4)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert (len(simhash.common_shingles(docs, 5)[0]) > 0) == (common > 0)
    got = simhash.first_copies(docs, meeting=2000).collect()
    assert sorted(str(x.doc_id) for x in got) == brute_firsts(rows) == sorted(map(str, range(12)))


def test_common_shingles_however_many(spark):
    """More than half a million shingles that three documents have: the prefix has those that none has."""
    ids = [r.id for r in spark.range(200).where(F.pmod(F.xxhash64("id"), F.lit(simhash.COUNTED)) == 0).limit(3).collect()]
    line = " ".join(map(str, range(600_000)))
    common = simhash.common_shingles(spark.createDataFrame([(i, line) for i in ids], "doc_id long, text string"), 5)
    known = simhash.shingle_set(line.encode(), 5)[:10_000:100]
    new = simhash.shingle_set(" ".join(f"x{i}" for i in range(100)).encode(), 5)
    first = simhash.prefix(np.sort(np.concatenate((known, new))), common, 0.8)
    assert len(first) == 49 and not set(first.tolist()) & set(known.tolist())


@pytest.mark.parametrize("most", [8, 1 << 28])
def test_marks(spark, monkeypatch, most):
    """A document with a role always has its mark, and each is on one side, however crowded the table."""
    monkeypatch.setattr(simhash, "MOST_MARKS", most)
    docs = spark.createDataFrame([(i if i % 9 else None, f"t{i}" if i % 7 else None) for i in range(900)], "doc_id long, text string")
    key = F.xxhash64("doc_id", F.xxhash64("text"))
    held = spark.sparkContext.broadcast(simhash.marks(docs.where("doc_id < 50"), key))
    inside, outside = (sorted(map(str, simhash.marked(docs, key, held, x).collect())) for x in (True, False))
    assert set(map(str, docs.where("doc_id < 50").collect())) <= set(inside)
    assert sorted(inside + outside) == sorted(map(str, docs.collect())) and (most == 8 or len(outside) > 600)


def test_first_copies_beyond_the_radius(spark):
    """Copies with one long passage replaced: five words alike at 0.8 and more, their fingerprints at over 7 bits."""
    rows, far = [], 0
    for k in range(60):
        r = random.Random(1000 + k)
        words = [f"w{r.randrange(400)}" for _ in range(60 + 3 * k)]
        cut = len(words) // 11
        copy = words[:-cut] + [f"v{r.randrange(3)}" for _ in range(cut)]
        a, b = (frozenset(tuple(x[i : i + 5]) for i in range(len(x) - 4)) for x in (words, copy))
        prints = [simhash.fingerprint(simhash.run_hashes(" ".join(x).encode(), 2)[0]) for x in (words, copy)]
        if len(a & b) >= 0.8 * len(a | b):
            rows += [(2 * k, " ".join(words)), (2 * k + 1, " ".join(copy))]
            far += ((prints[0] ^ prints[1]) & (1 << 64) - 1).bit_count() > 7
    assert far > 3
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in simhash.first_copies(docs).collect()) == [i for i, _ in rows if i % 2 == 0]


@pytest.mark.parametrize("stage", ["simhash_near_dedup", "benchmark_decontamination", "secret_scans", "best_fit_packing", "quality_classifier"])
def test_stages_of_nulls_and_nothing(spark, tmp_path, stage):
    """Null and empty texts, null ids, repeated rows, clashing columns; and no rows at all."""
    import corpus_pipeline

    schema = "doc_id long, text string, lang string, source string, n_chars long, redacted string, n_hit int, component_id int, perplexity string"
    rows = [(1, None, None, None, None, "r", 1, 2, "p"), (2, "", "en", "s", 0, "r", 1, 2, "p"), (None, "secret=abcdefghijklmnop", "en", "s", 1, "r", 1, 2, "p"), (3, "token: 'x'", "en", "s", 1, "r", 1, 2, "p"), (3, "token: 'x'", "en", "s", 1, "r", 1, 2, "p")]
    spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, None), (None, "token x")], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    run = dict(corpus_pipeline.STAGES)[stage]
    docs = spark.createDataFrame(rows, schema)
    got = run(spark, docs, str(tmp_path))
    assert run(spark, docs.limit(0), str(tmp_path)).count() == 0
    if stage == "best_fit_packing":
        assert sorted(str(r.doc_id) for r in got.collect()) == ["1", "2", "3", "3", "None"]
        return
    assert got.columns == docs.columns
    kept = sorted(((str(r.doc_id), r.text, r.n_chars) for r in got.collect()), key=str)
    want = {
        "simhash_near_dedup": [("1", None, None), ("3", "token: 'x'", 1), ("None", "secret=abcdefghijklmnop", 1)],
        "benchmark_decontamination": [("1", None, None), ("2", "", 0), ("3", "token: 'x'", 1), ("3", "token: 'x'", 1), ("None", "secret=abcdefghijklmnop", 1)],
        "secret_scans": [("1", None, None), ("2", "", 0), ("3", "token: 'x'", 10), ("3", "token: 'x'", 10), ("None", "[secret]", 8)],
        "quality_classifier": [("3", "token: 'x'", 1), ("3", "token: 'x'", 1), ("None", "secret=abcdefghijklmnop", 1)],
    }[stage]
    assert kept == want


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    docs, rows = awkward(spark, n=60, long=400)
    extra = [(900, prose(random.Random(9), 60) + ' token = "abcdef0123456789abcdef" ' + prose(random.Random(10), 60), "en", "s", 1)]
    docs = docs.unionByName(spark.createDataFrame(extra, docs.schema))
    passage = split(next(t for i, t, *_ in rows if i == 3))[:12]
    for name, df in (
        ("documents", docs), ("labels", spark.createDataFrame([(i, 1, 0) for i in range(60)], "doc_id long, quality int, toxic int")),
        ("benchmark", spark.createDataFrame([(1, " ".join(passage) if len(passage) >= 8 else "none at all of these words is there")], "item_id long, text string")),
    ):
        df.write.parquet(str(tmp_path / f"{name}.parquet"))
    now = spark.read.parquet(str(tmp_path / "documents.parquet"))
    sizes = []
    for name, stage in corpus_pipeline.STAGES:
        made = stage(spark, now, str(tmp_path))
        assert name == "best_fit_packing" or made.columns == now.columns
        made.write.parquet(str(tmp_path / name))
        now = spark.read.parquet(str(tmp_path / name))
        sizes.append(now.count())
    assert sizes[0] >= sizes[1] >= sizes[2] == sizes[3]
    text = {r.doc_id: r for r in spark.read.parquet(str(tmp_path / "secret_scans")).collect()}
    assert "[secret]" in text[900].text and "abcdef0123" not in text[900].text and text[900].n_chars == len(text[900].text)
    assert len(passage) < 8 or 3 not in text
    assert now.select("doc_id").distinct().count() == len(text)
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == sizes[-1]
