"""The registered queries over the smallest tables, against SQL or brute force of what they promise."""

import hashlib
import math
import os
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import __spark_entry__ as entry
from tabloom.llm import lattice, matroska, packing
from tabloom.llm.queries import ORACLE_SQL, QUERIES, vocabulary

from .helpers import awkward
from .test_corpus_operators import brute_groups

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


@pytest.fixture(scope="module")
def texts():
    return {r["doc_id"]: r["text"] or "" for r in pq.read_table(f"{DATA}/documents.parquet").to_pylist()}


def run(spark, number):
    return entry.queries()[next(n for n in QUERIES if n.startswith(f"op{number}_"))](spark, DATA).collect()


@pytest.mark.parametrize("name", sorted(ORACLE_SQL))
def test_sql(spark, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    df = entry.queries()[name](spark, DATA)
    answer = con.execute(entry.oracle_sql()[name])
    names = [d[0] for d in answer.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted(tuple(r[c] for c in names) for r in df.collect()) == sorted(answer.fetchall())


def test_op1(spark, texts):
    lower = lambda t: [w.lower() for w in t.encode().split()] + [b""]
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in texts}
    c = Counter(w for i, t in texts.items() if not held[i] for w in lower(t))
    n, v = sum(c.values()), len(c)
    got = {r.doc_id: r for r in run(spark, 1)}
    assert got.keys() == texts.keys()
    for i, t in texts.items():
        r, words = got[i], lower(t)
        assert (r.held_out, r.n_tokens, r.n_known, r.train_tokens) == (held[i], len(words), sum(c[w] > 0 for w in words), n)
        assert r.base_score == pytest.approx(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in words), rel=1e-9) and -math.inf < r.score < 0


def test_scores_of_documents_by_brute_force(spark):
    """Whole words' arcs and all segmentations, in plain probabilities, with the weights that the vocabulary's order gives."""
    docs, rows = awkward(spark, n=12, long=50)
    rows = [r for r in rows if len(max((r[1] or "").split(), key=len, default="")) < 40]
    docs = spark.createDataFrame(rows, docs.schema)
    path = vocabulary("piece_bpe_32k.model")
    names, prior = lattice.pieces(path)
    weight = {p: math.exp(w) for p, w in zip(names[256:], prior[256:])}
    bytes_ = np.exp(prior[:256])
    lower = lambda t: [w.lower() for w in (t or "").encode().split()]
    on = lambda i: i is not None and i % 2 == 0
    c = Counter(w for i, t, *_ in rows if on(i) for w in [*lower(t), b""])
    n, v = sum(c.values()), len(c)
    once, twice = (sum(k == x for w, k in c.items() if w) for x in (1, 2))
    discount = min(0.95, max(0.05, once / max(1, once + 2 * twice)))
    left = (discount * (v - 1) + 0.5) / (n + 1)

    def spelled(word):
        s = lattice.START + word.decode()
        p = [1.0] + [0.0] * len(s)
        for i in range(len(s)):
            if s[i] not in weight:
                p[i + 1] += p[i] * math.prod(bytes_[b] for b in s[i].encode())
            for j in range(i + 1, min(len(s), i + 20) + 1):
                p[j] += p[i] * weight.get(s[i:j], 0.0)
        return p[-1]

    score = lambda t: sum(math.log10((c[w] - discount) / (n + 1) * (c[w] > 0) + left * spelled(w)) for w in lower(t)) + math.log10((c[b""] + 0.5) / (n + 1))
    want = sorted((str(i), score(t)) for i, t, *_ in rows)
    got = sorted((str(r.doc_id), r.score) for r in lattice.score(docs, path, F.col("doc_id") % 2 == 0, rounds=0).collect())
    assert [i for i, _ in got] == [i for i, _ in want] and [x for _, x in got] == pytest.approx([x for _, x in want], rel=1e-9)


def test_op2(spark, texts):
    got = run(spark, 2)
    lengths = Counter()
    bins = {}
    for r in got:
        lengths[r.doc_id] += r.n_tokens
        bins.setdefault(r.bin_id, []).append(r)
    assert lengths == {i: len([w for w in re.split(r"[\x20\x09-\x0D]+", t) if w]) + 1 for i, t in texts.items()}
    for b in bins.values():
        used = sum(r.n_tokens for r in b)
        assert used == b[0].bin_used and b[0].bin_capacity == min(c for c in packing.CAPACITIES if c >= used)


def test_op4(spark, texts):
    got = run(spark, 4)
    assert sorted(r.doc_id for r in got) == sorted(texts)
    assert all((r.perplexity is None) == (not texts[r.doc_id].split()) and (not r.keep or r.perplexity <= r.threshold) for r in got)


def test_op5_and_op6(spark, texts):
    library = Tokenizer.from_file(vocabulary("byte_bpe_50k.json"))
    ids = {i: library.encode(t, add_special_tokens=False).ids for i, t in texts.items()}
    assert {r.doc_id: (r.n_bytes, r.n_tokens, r.over_limit) for r in run(spark, 5)} == {i: (len(texts[i].encode()), len(x), len(x) > 512) for i, x in ids.items()}
    found = {}
    for r in run(spark, 6):
        row = np.frombuffer(bytes(r.ids), "<u2")
        for a, b, doc, start in zip(r.cu_seqlens, r.cu_seqlens[1:], r.doc_ids, r.piece_starts):
            found.setdefault(doc, []).append((start, row[a:b].tolist()))
    assert {i: [x for _, p in sorted(parts) for x in p][:-1] for i, parts in found.items()} == ids


def test_op7(spark, texts):
    patterns = (("assign", r"""(?:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 12, re.I | re.A), ("access", r"(AKIA[A-Z0-9]+)", 18, 0), ("hex", r"([0-9a-f]+)", 16, 0))
    for r in run(spark, 7):
        base = sorted((m.start(), k, m.end()) for k, (_, p, least, flags) in enumerate(patterns) for m in re.finditer(p, texts[r.doc_id], flags) if len(m[1]) >= least)
        line = ",".join(f"{patterns[k][0]}:{s}:{e}" for s, k, e in base)
        assert r.base_sha256 == hashlib.sha256(line.encode()).hexdigest()
        assert [r.n_assign, r.n_access, r.n_hex] == [sum(k == x for _, k, _ in base) for x in range(3)]
        assert set(filter(None, line.split(","))) <= set(r.spans.split(","))


def test_op8(spark, texts):
    for r in run(spark, 8):
        payload, n = matroska.payload_of(texts[r.doc_id])
        data = matroska.mux(payload)
        assert (r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32) == (n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-64:]))
        assert (r.media_bytes, r.media_sha256) == (len(data), hashlib.sha256(data).hexdigest())


def test_op10(spark, texts):
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in run(spark, 10)) == brute_groups([(i, t) for i, t in texts.items()], 4, 4)
