"""Operator 1: subword lattice likelihood.

An existing subword vocabulary gives the pieces and a prior from its scores; the pieces' unigram
weights are re-estimated on the training documents by expectation maximisation over all
segmentations of their distinct words. Words seen in training have a whole-word arc as well. A document's probability is that of its words and one end,
each word summed over all of its segmentations by a forward recursion in log space. No piece
crosses a word's start, so a word's marginal is worked out once and a document's is their sum.
"""

from __future__ import annotations

import math
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .blocks import BLOCK_BYTES, blocked, valued
from .common import Buckets, gathered, slices, split_words, written

START = "▁"
PRIME = np.uint64(0x9E3779B97F4A7C15)
#: Words that are sorted out by length together, and those of one length that are worked on at once.
GATHERED, ROWS = 100_000, 20_000
#: Characters from which a word is worked on by itself, and its characters whose pieces are looked up at once.
LONG, REACH = 256, 1 << 14


def lowered(texts: pa.Array | pa.ChunkedArray) -> tuple[pa.Array, np.ndarray]:
    """All words of the texts in order, A-Z in lower case, and how many each text has."""
    _, words, counts = split_words(texts)
    return pc.ascii_lower(words).cast(pa.binary()), counts


@lru_cache(maxsize=2)
def pieces(path: str) -> tuple[tuple[str, ...], np.ndarray]:
    """The vocabulary's pieces that can be part of a word, and log weights from the order of their scores."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    found = []
    for i in range(model.get_piece_size()):
        piece = model.id_to_piece(i)
        if model.is_byte(i) or not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i) or START in piece[1:]):
            found.append((not model.is_byte(i), -model.get_score(i), piece))
    found.sort()  # bytes first, then by score
    weights = -np.log(np.arange(len(found)) + 2.0)
    return tuple(p for *_, p in found), weights - np.log(np.exp(weights).sum())


def hashes(piece: str) -> list[int]:
    """A hash of each start of a piece, spread over all bits."""
    h, out = 0, []
    for c in piece:
        h = ((h ^ ord(c)) * int(PRIME)) & (1 << 64) - 1
        h ^= h >> 29
        out.append(h)
    return out


def longer(h: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """hashes() of starts one character longer."""
    h = (h ^ codes) * PRIME
    return h ^ h >> np.uint64(29)


@lru_cache(maxsize=2)
def starts_of(names: tuple[str, ...]) -> tuple[Buckets, np.ndarray, int]:
    """Starts of pieces by their hashes; the piece that each is itself, if any, with a last entry for what starts none; the longest piece's length."""
    table: dict[int, int] = {}
    for i, p in enumerate(names):
        if i >= Lattice.bytes:
            *starts, whole = hashes(p)
            for h in starts:
                table.setdefault(h, -1)
            table[whole] = i
    keys = np.array(sorted(table), np.uint64)
    return Buckets(keys), np.array([*(table[k] for k in keys.tolist()), -1], np.int64), max(map(len, names[Lattice.bytes :]), default=1)


class Lattice:
    """Pieces with log weights; the first 256 are bytes, which spell characters without a piece."""

    bytes = 256

    def __init__(self, names: tuple[str, ...], weights: np.ndarray):
        self.weights = weights
        self.table, self.pieces, self.longest = starts_of(names)

    def edges(self, codes: np.ndarray) -> tuple[dict[tuple[int, int], tuple[np.ndarray, np.ndarray]], dict[int, list[tuple[int, bytes]]]]:
        """(from, to) -> rows and their pieces; place -> rows whose character has no piece, as bytes."""
        n, length = codes.shape
        found, spelled = {}, {}
        for i in range(length):
            h, rows = np.zeros(n, np.uint64), np.arange(n)
            for j in range(i + 1, min(length, i + self.longest) + 1):
                h = longer(h, codes[rows, j - 1])
                at = self.table.find(h)
                ids = self.pieces[at]
                whole = ids >= 0
                if j == i + 1 and not whole.all():
                    spelled[i] = [(int(r), chr(codes[r, i]).encode("utf-8", "surrogatepass")) for r in np.flatnonzero(~whole)]
                if whole.any():
                    found[i, j] = rows[whole], ids[whole]
                # only what starts a piece goes on
                more = at >= 0
                rows, h = rows[more], h[more]
                if not len(rows):
                    break
        return found, spelled

    def forward(self, codes: np.ndarray, found: dict, spelled: dict) -> np.ndarray:
        n, length = codes.shape
        alpha = np.full((length + 1, n), -np.inf)
        alpha[0] = 0
        for i in range(length):
            for r, raw in spelled.get(i, ()):
                alpha[i + 1, r] = np.logaddexp(alpha[i + 1, r], alpha[i, r] + sum(self.weights[b] for b in raw))
            for j in range(i + 1, min(length, i + self.longest) + 1):
                if (i, j) in found:
                    rows, ids = found[i, j]
                    alpha[j, rows] = np.logaddexp(alpha[j, rows], alpha[i, rows] + self.weights[ids])
        return alpha

    def backward(self, codes: np.ndarray, found: dict, spelled: dict) -> np.ndarray:
        n, length = codes.shape
        beta = np.full((length + 1, n), -np.inf)
        beta[length] = 0
        for i in reversed(range(length)):
            for r, raw in spelled.get(i, ()):
                beta[i, r] = np.logaddexp(beta[i, r], beta[i + 1, r] + sum(self.weights[b] for b in raw))
            for j in range(i + 1, min(length, i + self.longest) + 1):
                if (i, j) in found:
                    rows, ids = found[i, j]
                    beta[i, rows] = np.logaddexp(beta[i, rows], beta[j, rows] + self.weights[ids])
        return beta

    def arcs(self, codes: np.ndarray) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
        """Pieces of one long word by where they begin, REACH places at a time: (first place, places after it, lengths, pieces, weights).

        A character without a piece is an arc of piece -1 with the weight of its bytes.
        """
        length = len(codes)
        for a in range(0, length, REACH):
            n = min(REACH, length - a)
            near = np.zeros(n + self.longest, np.uint64)
            near[: min(len(near), length - a)] = codes[a : a + len(near)]
            h, ids = np.zeros(n, np.uint64), np.full((n, self.longest), -1)
            for k in range(self.longest):
                h = longer(h, near[k : k + n])
                within = min(n, length - a - k)
                if within > 0:
                    ids[:within, k] = self.pieces[self.table.find(h[:within])]
            spelled = ids[:, 0] < 0
            weights = np.where(ids >= 0, self.weights[ids], -np.inf)
            weights[spelled, 0] = [sum(self.weights[b] for b in chr(c).encode("utf-8", "surrogatepass")) for c in codes[a : a + n][spelled].tolist()]
            at, k = np.nonzero(weights > -np.inf)
            yield a, at, k + 1, ids[at, k], weights[at, k]

    def forward_long(self, codes: np.ndarray) -> np.ndarray:
        """The forward recursion of one word: log probability of its first characters, by how many."""
        alpha, add = [0.0] + [-math.inf] * len(codes), math.log1p
        for a, at, k, _, w in self.arcs(codes):
            for i, j, x in zip((at + a).tolist(), (at + a + k).tolist(), w.tolist()):
                x += alpha[i]
                y = alpha[j]
                alpha[j] = x if y == -math.inf else x + add(math.exp(y - x)) if x > y else y + add(math.exp(x - y))
        return np.array(alpha)

    def expected_long(self, codes: np.ndarray, times: float) -> np.ndarray:
        """expected() of one word."""
        alpha, length, out = self.forward_long(codes), len(codes), np.zeros(len(self.weights))
        beta, add = [-math.inf] * length + [0.0], math.log1p
        for a, at, k, ids, w in reversed(list(self.arcs(codes))):
            start, end = at + a, at + a + k
            for i, j, x in zip(start[::-1].tolist(), end[::-1].tolist(), w[::-1].tolist()):
                x += beta[j]
                y = beta[i]
                beta[i] = x if y == -math.inf else x + add(math.exp(y - x)) if x > y else y + add(math.exp(x - y))
            share = times * np.exp(alpha[start] + w + np.array(beta)[end] - alpha[-1])
            out += np.bincount(ids[ids >= 0], share[ids >= 0], len(out))
            for i, x in zip(start[ids < 0].tolist(), share[ids < 0].tolist()):
                for b in chr(int(codes[i])).encode("utf-8", "surrogatepass"):
                    out[b] += x
        return out

    def by_length(self, words: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(places of words, their characters with the start before them) for words of one length."""
        of = defaultdict(list)
        for k, w in enumerate(words):
            of[len(s := w.decode())].append((k, s))
        for length, same in of.items():
            for at in range(0, len(same), rows := max(1, ROWS // max(1, length // 64))):
                part = same[at : at + rows]
                codes = np.frombuffer("".join(START + s for _, s in part).encode("utf-32-le"), np.uint32).reshape(len(part), length + 1)
                yield np.array([k for k, _ in part]), codes.astype(np.uint64)

    def marginals(self, words: list[bytes]) -> np.ndarray:
        """Natural log of each word's probability over all segmentations."""
        out = np.zeros(len(words))
        for at, codes in self.by_length(words):
            if codes.shape[1] > LONG:
                out[at] = [self.forward_long(c)[-1] for c in codes]
            else:
                out[at] = self.forward(codes, *self.edges(codes))[-1]
        return out

    def expected(self, words: list[bytes], times: np.ndarray) -> np.ndarray:
        """Expected count of each piece over words that occur so many times."""
        out = np.zeros(len(self.weights))
        for at, codes in self.by_length(words):
            if codes.shape[1] > LONG:
                for n, c in zip(times[at].tolist(), codes):
                    out += self.expected_long(c, n)
                continue
            found, spelled = self.edges(codes)
            alpha, beta = self.forward(codes, found, spelled), self.backward(codes, found, spelled)
            total, n = alpha[-1], times[at]
            for (i, j), (rows, ids) in found.items():
                out += np.bincount(ids, n[rows] * np.exp(alpha[i, rows] + self.weights[ids] + beta[j, rows] - total[rows]), len(out))
            for i, spelt in spelled.items():
                for r, raw in spelt:
                    share = n[r] * math.exp(alpha[i, r] + sum(self.weights[b] for b in raw) + beta[i + 1, r] - total[r])
                    for b in raw:
                        out[b] += share
        return out


def word_counts(docs: DataFrame, train: Column, text: str = "text") -> DataFrame:
    """(word, c) over the documents of `train`; the end of a text is an empty word."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, BLOCK_BYTES):
            words, _ = lowered(batch.column(0))
            found = pc.value_counts(words)
            n = pa.concat_arrays([found.field("counts").cast(pa.int64()), pa.array([batch.num_rows], pa.int64())])
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([found.field("values"), pa.array([b""], pa.binary())]), n], ["word", "n"])

    rows = docs.where(train).select(text).mapInArrow(count, "word binary, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("c"))


def fit(counts: DataFrame, path: str, rounds: int, strength: float) -> np.ndarray:
    """Log weights of the pieces, from the distinct words of counts: (word, c).

    Each round, every task sums expected piece counts over its words; what reaches the driver is one
    number for each piece of the vocabulary. strength: how many pieces the prior weighs.
    """
    _, prior = pieces(path)
    context, weights = counts.sparkSession.sparkContext, prior
    for _ in range(rounds):
        now = context.broadcast(weights)

        def expect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            lattice, total = Lattice(names_of(path), now.value), None
            for batch in gathered(batches, GATHERED):
                found = lattice.expected(batch.column(0).to_pylist(), np.ones(batch.num_rows))
                total = found if total is None else total + found
            if total is not None:
                at = np.flatnonzero(total)
                yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(total[at])], ["piece", "n"])

        rows = counts.where("octet_length(word) > 0").select("word").mapInArrow(expect, "piece int, n double").groupBy("piece").agg(F.sum("n").alias("n"))
        gained = strength * np.exp(prior)
        for piece, n in rows.toLocalIterator():
            gained[piece] += n
        weights = np.log(gained / gained.sum())
    return weights


def names_of(path: str) -> tuple[str, ...]:
    return pieces(path)[0]


def score(docs: DataFrame, path: str, train: Column, rounds: int = 2, strength: float = 1000.0, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each document: id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    path: a sentencepiece model, whose pieces and score order are used; train: which documents are
    learned from (null: not). Scores are log10 probabilities of a document's words and one end.
    base_score: by word counts with one half added. score: by a lattice that has, beside the pieces,
    one arc for each whole word seen in training; these arcs have the words' counts less a discount
    (n1 / (n1 + 2 n2) of the words seen once and twice), and what the discounts leave weights the
    segmentations into pieces, whose weights are learned from distinct words.
    Null and empty texts are an end alone; words of any length are scored whole, in time that grows with their length alone;
    repeated rows are learned from and scored each; an empty table gives no rows; further columns are left out; without training rows every count is 0 and the pieces keep their prior.
    """
    train = F.coalesce(train, F.lit(False))
    counts = written(word_counts(docs, train, text), "counts")
    word = F.octet_length("word") > 0
    n, v, ends, once, twice = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*"), F.coalesce(F.sum(F.when(~word, F.col("c"))), F.lit(0)), F.count(F.when(word & (F.col("c") == 1), 1)), F.count(F.when(word & (F.col("c") == 2), 1))).first()
    discount = min(0.95, max(0.05, once / max(1, once + 2 * twice)))
    left = math.log((discount * (v - (ends > 0)) + 0.5) / (n + 1))
    weights = fit(counts, path, rounds, strength)
    model = docs.sparkSession.sparkContext.broadcast(weights)
    floor = n + 0.5 * (v + 1)

    def distinct(block: pa.Table) -> pa.Array:
        return pc.unique(lowered(block.column("text"))[0])

    def of_block(block: pa.Table, values: pa.Table) -> pa.Table:
        words, counts = lowered(block.column("text"))
        coded = words.dictionary_encode()
        at = pc.fill_null(pc.index_in(coded.dictionary, value_set=values.column("word").combine_chunks()), -1).to_numpy()
        seen = at >= 0
        c, spelled = np.zeros(len(at)), np.zeros(len(at))
        c[seen], spelled[seen] = (values.column(x).to_numpy()[at[seen]] for x in ("c", "marginal"))
        # words that no training document has aren't in the table: they are scored here
        spelled[~seen] = Lattice(names_of(path), model.value).marginals(coded.dictionary.filter(pa.array(~seen)).to_pylist())
        whole = np.log(np.maximum(c - discount, 1e-300) / (n + 1))
        scores = np.where(c > 0, np.logaddexp(whole, left + spelled), left + spelled) / math.log(10)
        base = np.log10((c + 0.5) / floor)
        end, end_base = math.log10((ends + 0.5) / (n + 1)), math.log10((ends + 0.5) / floor)
        ids, doc = coded.indices.to_numpy(), np.repeat(np.arange(len(counts)), counts)
        total = lambda x: np.bincount(doc, x[ids], len(counts))
        columns = (counts + 1, total(c > 0).astype(np.int64) + int(ends > 0), np.full(len(counts), n), total(base) + end_base, total(scores) + end)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.float64())
        return pa.Table.from_arrays([block.column("id"), block.column("held_out"), *(pa.array(x, k) for x, k in zip(columns, kinds))], ["id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"])

    def marginals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lattice = Lattice(names_of(path), model.value)
        for batch in gathered(batches, GATHERED):
            found = pa.array(lattice.marginals(batch.column(0).to_pylist()))
            yield pa.RecordBatch.from_arrays([*batch.columns, found], ["word", "c", "marginal"])

    values = counts.where("octet_length(word) > 0").select("word", "c").mapInArrow(marginals, "word binary, c long, marginal double")
    rows = blocked(docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"), (~train).alias("held_out")), "id", "text")
    schema = f"id {docs.schema[id_column].dataType.simpleString()}, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"
    return valued(rows, distinct, values, of_block, schema).withColumnRenamed("id", id_column)
