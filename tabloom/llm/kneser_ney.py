"""Operator 4: quality by the perplexity of an interpolated modified Kneser-Ney n-gram model.

The model's tokens are the characters of a word, its start and its end. It is trained on a bounded
sample of trusted documents: their n-grams are counted where the text is, and counts, contexts and
lower orders meet in joins sharded by n-gram. Scoring joins the distinct words of a slice of
documents with the model, whose size the sample bounds, and sums them for each document.
Documents above a quantile of the trusted documents' perplexities in their language are rejected.
Each word is scored alone, so that repeated words look good; documents with a passage of fewer different words than
nearly all trusted documents of their language have are rejected too. So are documents with a word that labelled toxic documents
have far more often than the model of trusted text expects, by a quantile of the trusted documents again.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Buckets, discard, slices, with_fields, written

FIRST, LAST = "\x02", "\x03"
PRIME = np.uint64(0x9E3779B97F4A7C15)
#: Words whose scores a task keeps, and text it looks at at once: a word takes ten times its bytes.
MOST_KEPT, SLICE = 200_000, 2 << 20
#: Characters of a word that are scored at once; a longer word goes on with the characters before as context.
STEP = 64
#: Words of a passage whose different words are counted.
PASSAGE = 20
#: Signs around a word.
EDGES = re.compile(r"^[\W_]+|[\W_]+$")
#: Languages whose thresholds are broadcast; with more they are joined by a shuffle.
FEW = 10_000


def words_of(text: str | None) -> list[str]:
    return text.split() if text else []


def windows(word: str, order: int) -> list[str]:
    """The word with its starts and its end, cut so that each character but order - 1 at the front of a window is in one of them."""
    line = FIRST * (order - 1) + word + LAST
    return [line[i : i + STEP + order - 1] for i in range(0, len(word) + 1, STEP)]


def variety(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """For each text, the least share of different words among any PASSAGE words in a row, or all if there are fewer.

    ids: numbers of the texts' words, one text after another; counts: how many words each has, at least one.
    """
    n, first = len(ids), np.cumsum(counts) - counts
    doc = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(n) - first[doc]
    key = doc << 32 | ids
    order = np.argsort(key, kind="stable")
    again = key[order[1:]] == key[order[:-1]]
    at = order[1:][again]
    gap = at - order[:-1][again]
    at, gap = at[gap < PASSAGE], gap[gap < PASSAGE]
    # a word that comes again after `gap` words is a repeat in the passages that hold both
    begins = np.bincount(first[doc[at]] + np.maximum(0, place[at] - PASSAGE + 1), minlength=n + 1)
    ends = np.bincount(at - gap + 1, minlength=n + 1)
    repeats = np.cumsum(begins - ends)[:n]
    repeats[place > np.maximum(0, counts - PASSAGE)[doc]] = 0
    size = np.minimum(counts, PASSAGE)
    return (size - np.maximum.reduceat(repeats, first)) / size


def folded(word: str) -> str:
    """A word for the contrast: in lower case, without signs around it."""
    return EDGES.sub("", word.lower())


def contrast(toxic: DataFrame, model: "Model", least: int, text: str = "text") -> dict[str, float]:
    """folded word -> natural log of how much more often toxic documents have it than the model expects, where that is more.

    Words count once a document, less a discount, if at least `least` documents have them. The caller bounds the documents.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, SLICE):
            found: Counter = Counter()
            for t in batch.column(0).to_pylist():
                found.update({folded(w) for w in set(words_of(t))} - {""})
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

    counts = written(toxic.select(text).mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "toxic")
    total = counts.agg(F.sum("n")).first()[0] or 1
    got = counts.where(F.col("n") >= least).toArrow()
    discard(counts)
    words, n = got.column("word").to_pylist(), got.column("n").to_numpy()
    more = np.log((n - 0.5) / total) - model.scores(words) if words else n
    return {w: x for w, x in zip(words, more.tolist()) if x > 0}


def gram_counts(docs: DataFrame, order: int, text: str = "text") -> DataFrame:
    """(gram, c): runs of `order` characters of the words, each word led by order - 1 starts."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text, SLICE):
            words, found = Counter(), Counter()
            for t in batch.column(0).to_pylist():
                words.update(words_of(t))
            for word, n in words.items():
                line = FIRST * (order - 1) + word + LAST
                for i in range(len(line) - order + 1):
                    found[line[i : i + order]] += n
            yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["gram", "c"])

    return docs.select(text).mapInArrow(count, "gram string, c long").groupBy("gram").agg(F.sum("c").alias("c"))


def discounts(counts: tuple[int, int, int, int]) -> tuple[float, float, float]:
    """D1, D2 and D3+ from how many n-grams occur one to four times."""
    n1, n2, n3, n4 = counts
    if not n1 or not n2:
        return 0.5, 0.75, 0.9
    y = n1 / (n1 + 2 * n2)
    raw = (1 - 2 * y * n2 / n1, 2 - 3 * y * n3 / n2, 3 - 4 * y * n4 / n3 if n3 else 0.9)
    return tuple(min(k - 0.05, max(0.05, d)) for k, d in enumerate(raw, 1))


class Grams:
    """Values of n-grams of one length under hashes: log probability (not a number where it is only a context) and log weight as a context."""

    def __init__(self, probable: tuple[list[str], np.ndarray], contexts: tuple[list[str], np.ndarray]):
        of = {g: (p, 0.0) for g, p in zip(probable[0], probable[1].tolist())}
        for g, left in zip(contexts[0], contexts[1].tolist()):
            of[g] = (of[g][0] if g in of else math.nan, left)
        h = hashes(codes_of(list(of))) if of else np.empty(0, np.uint64)
        order = np.argsort(h)
        # the last entry, which find's -1 takes, is that of an n-gram never seen
        self.p, self.left = np.vstack((np.array(list(of.values()), float).reshape(-1, 2)[order], (math.nan, 0.0))).T.copy()
        self.find = Buckets(h[order]).find


class Model:
    """Grams by length from 1 to the order; unknown: the log probability of a character never seen."""

    def __init__(self, grams: list[Grams], unknown: float):
        self.order, self.grams, self.unknown = len(grams), grams, unknown

    def windows(self, lines: list[str]) -> np.ndarray:
        """Natural log of the probability of the characters of each line after its first order - 1."""
        sizes = np.fromiter(map(len, lines), np.int64, len(lines))
        by_size = np.argsort(-sizes, kind="stable")
        sizes = sizes[by_size]
        longest = int(sizes[0]) if len(lines) else 0
        # the lines that go on at a place come first, so that all lengths are worked on at once
        codes, total, lefts = codes_of([lines[i].ljust(longest) for i in by_size.tolist()]), np.zeros(len(lines)), []
        for j in range(max(0, self.order - 2), longest):
            n = int(np.searchsorted(-sizes, -j))
            h, now = None, []
            for k, grams in enumerate(self.grams[: j + 1], 1):
                h = mixed(h, codes[:n, j - k + 1])
                at = grams.find(h)
                if j >= self.order - 1:
                    found = grams.p[at]
                    p = np.where(np.isnan(found), self.unknown if k == 1 else lefts[k - 2][:n] + p, found)
                if k < self.order:
                    now.append(grams.left[at])
            if j >= self.order - 1:
                total[:n] += p
            lefts = now
        out = np.empty(len(lines))
        out[by_size] = total
        return out

    def scores(self, words: list[str]) -> np.ndarray:
        """Natural log of the probability of each word and its end."""
        parts = sorted(((len(line), k, line) for k, word in enumerate(words) for line in windows(word, self.order)), reverse=True)
        out = np.zeros(len(words))
        for start in range(0, len(parts), 20_000):
            part = parts[start : start + 20_000]
            np.add.at(out, [k for _, k, _ in part], self.windows([line for *_, line in part]))
        return out


def codes_of(lines: list[str]) -> np.ndarray:
    """Characters of lines of one length, a row a line."""
    if not lines:
        return np.empty((0, 0), np.uint64)
    return np.frombuffer("".join(lines).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(len(lines), -1).astype(np.uint64)


def mixed(h: np.ndarray | None, codes: np.ndarray) -> np.ndarray:
    """The hash of an n-gram one character longer at its front."""
    h = ((np.uint64(1) if h is None else h * PRIME) ^ codes) * PRIME
    return h ^ h >> np.uint64(29)


def hashes(codes: np.ndarray) -> np.ndarray:
    h = None
    for k in reversed(range(codes.shape[1])):
        h = mixed(h, codes[:, k])
    return h


def train(docs: DataFrame, order: int = 5, text: str = "text") -> Model:
    """The model of the documents' words. The caller bounds the documents, and so what is collected here."""
    tables = [written(gram_counts(docs, order, text), "grams")]
    for k in range(order - 1, 0, -1):
        # lower orders count how many different characters an n-gram follows
        tables.append(written(tables[-1].groupBy(F.expr(f"substring(gram, 2, {k})").alias("gram")).agg(F.count("*").alias("c")), "grams"))
    tables.reverse()
    lower, probable_of, contexts, unknown, spent = None, [], [], math.log(1e-6), list(tables)
    for k, counts in enumerate(tables, 1):
        seen = counts.agg(*(F.count(F.when(F.col("c") == i, 1)) for i in range(1, 5)), F.count("*")).first()
        d1, d2, d3 = discounts(seen[:4])
        off = F.when(F.col("c") == 1, d1).when(F.col("c") == 2, d2).otherwise(d3)
        parts = counts.withColumn("context", F.expr(f"substring(gram, 1, {k - 1})"))
        totals = parts.groupBy("context").agg(F.sum("c").alias("total"), (F.sum(off) / F.sum("c")).alias("left"))
        probable = parts.join(totals, "context").withColumn("p", (F.col("c") - off) / F.col("total"))
        if lower is None:
            # what the single characters' discounts leave is shared by them and one unknown
            probable = probable.withColumn("p", F.col("p") + F.col("left") / (seen[4] + 1))
            if seen[4]:
                unknown = math.log(max(1e-9, probable.first().left / (seen[4] + 1)))
        else:
            below = lower.select(F.col("gram").alias("suffix"), F.col("p").alias("below"))
            probable = probable.withColumn("suffix", F.expr(f"substring(gram, 2, {k - 1})")).join(below, "suffix").withColumn("p", F.col("p") + F.col("left") * F.col("below"))
        lower = written(probable.select("gram", "context", "p", "left"), "probable")
        got = lower.select("gram", "p").toArrow()
        probable_of.append((got.column("gram").to_pylist(), np.log(got.column("p").to_numpy())))
        got = lower.groupBy("context").agg(F.first("left").alias("left")).toArrow()
        contexts.append((got.column("context").to_pylist(), np.log(got.column("left").to_numpy())))
        spent.append(lower)
    discard(*spent)
    contexts.append(([], np.empty(0)))
    return Model([Grams(p, c) for p, c in zip(probable_of, contexts[1:])], unknown)


def perplexities(docs: DataFrame, model: Model, text: str = "text", name: str = "perplexity", share: str | None = None, marked: dict[str, float] | None = None, mark: str = "_contrast") -> DataFrame:
    """docs with a double column: the perplexity of a character; null for texts without words.

    share: a column of variety() besides; marked: a result of contrast(), of which the column `mark` has the most that a text's words have, 0 if none.
    All are null for texts without words.
    """
    added = [name, *([share] if share else []), *([mark] if marked is not None else [])]
    kept = docs.drop(*added)
    schema = with_fields(kept, dict.fromkeys(added, "double"))
    held = docs.sparkSession.sparkContext.broadcast((model, marked or {}))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, of_folded = held.value
        known: dict[str, float] = {}
        hot: dict[str, float] = {}
        for batch in slices(batches, text, SLICE):
            if len(known) > MOST_KEPT:
                known, hot = {}, {}
            lists = pc.utf8_split_whitespace(pc.fill_null(batch.column(batch.schema.get_field_index(text)), ""))
            flat = pc.list_flatten(lists)
            filled = pc.greater(pc.binary_length(flat), 0)
            counts = np.bincount(pc.list_parent_indices(lists).filter(filled).to_numpy(), minlength=batch.num_rows)
            coded = flat.filter(filled).dictionary_encode()
            words, ids = coded.dictionary.to_pylist(), coded.indices.to_numpy().astype(np.int64)
            new = [w for w in words if w not in known]
            known.update(zip(new, model.scores(new).tolist()))
            if of_folded:
                hot.update((w, of_folded[f]) for w in new if (f := folded(w)) in of_folded)
            some = counts > 0
            doc, first = np.repeat(np.arange(len(counts)), counts), (np.cumsum(counts) - counts)[some]
            logs = np.bincount(doc, np.fromiter(map(known.__getitem__, words), float, len(words))[ids], len(counts))
            characters = np.bincount(doc, np.fromiter(map(len, words), float, len(words))[ids] + 1, len(counts))
            columns = [np.exp(-logs[some] / characters[some])]
            if share:
                columns.append(variety(ids, counts[some]) if len(ids) else np.empty(0))
            if marked is not None:
                of_word = np.fromiter((hot.get(w, 0.0) for w in words), float, len(words))
                columns.append(np.maximum.reduceat(of_word[ids], first) if len(ids) else np.empty(0))
            made = []
            for column in columns:
                out = np.zeros(len(counts))
                out[some] = column
                made.append(pa.array(out, mask=~some))
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, *added])

    return kept.mapInArrow(score, schema)


def classify(docs: DataFrame, labels: DataFrame, sample: int = 20_000, order: int = 5, quantile: float = 0.995, slack: float = 1.05, id_column: str = "doc_id", text: str = "text", language: str = "lang", columns: list[str] | None = None, least: int = 5) -> DataFrame:
    """docs (or its `columns`) with perplexity, threshold and keep.

    labels: (id, quality, toxic); documents of quality 1 that aren't toxic are trusted. One half of them by a hash of
    the id is for the model, of which at most `sample` labelled rows, least by that hash, are used, whole, their words of any length; the other half
    is for the thresholds, as the model knows the words of those it has seen. A language's threshold
    (null is a language of its own) is the quantile of its trusted documents, times slack; where there are fewer than 1 / (1 - quantile)
    of them, the largest of that and of all languages' together counts. The same holds from below for variety(), by the quantile
    from the other end divided by slack, and from above for the contrast() with toxic documents, whatever their quality, of the first half and
    at most `sample` of them. keep: perplexity and contrast up to their thresholds and variety from its own; texts without words, null ones too, have
    neither perplexity nor quality and aren't kept; if no document is trusted, all others are kept. Of several labels of
    an id the worst counts; repeated rows are judged each; an empty table gives no rows; of the input's columns, those with the added names are replaced.
    """
    docs = docs.drop("perplexity", "threshold", "keep")
    columns = columns or docs.columns
    halved = labels.groupBy(F.col(id_column).alias("_id")).agg(F.min("quality").alias("q"), F.max("toxic").alias("x")).withColumn("_fit", F.pmod(F.xxhash64("_id"), F.lit(2)) == 0)
    good = (F.col("q") == 1) & (F.coalesce("x", F.lit(0)) == 0)
    trusted = halved.where(~F.col("_fit") & good).select("_id")

    def fitted(which) -> DataFrame:
        chosen = halved.where(F.col("_fit") & which).select("_id").orderBy(F.xxhash64("_id"), "_id").limit(sample)
        return docs.select(id_column, text).join(F.broadcast(chosen), F.col(id_column) == F.col("_id"), "left_semi")

    model = train(fitted(good), order, text)
    marked = contrast(fitted(F.col("x") == 1), model, least, text)
    scored = perplexities(docs.select(*dict.fromkeys([*columns, id_column, language, text])), model, text, share="_variety", marked=marked)
    scored = written(scored.select(*dict.fromkeys([*columns, id_column, language]), "perplexity", "_variety", "_contrast"), "scored")
    known = scored.select(F.col(id_column).alias("_id"), F.col(language).alias("_language"), "perplexity", "_variety", "_contrast").join(trusted, "_id", "left_semi").where("perplexity IS NOT NULL")
    cut = F.percentile_approx("perplexity", F.lit(quantile), F.lit(100_000))
    low = F.percentile_approx("_variety", F.lit(1 - quantile), F.lit(100_000))
    apart = F.percentile_approx("_contrast", F.lit(quantile), F.lit(100_000))
    by_language = written(known.groupBy("_language").agg((cut * slack).alias("_own"), (low / slack).alias("_least"), (apart * slack).alias("_most"), F.count("*").alias("_n")), "thresholds")
    overall, lowest, highest = (F.lit(x).cast("double") for x in known.agg(cut * slack, low / slack, apart * slack).first())
    enough = F.col("_n") * (1 - quantile) >= 1
    few = F.broadcast(by_language) if by_language.limit(FEW + 1).count() <= FEW else by_language
    judged = scored.join(few, F.col(language).eqNullSafe(F.col("_language")), "left")
    judged = judged.withColumn("threshold", F.when(enough, F.col("_own")).otherwise(F.coalesce(F.greatest("_own", overall), F.lit(math.inf))))
    varied = F.col("_variety") >= F.when(enough, F.col("_least")).otherwise(F.coalesce(F.least("_least", lowest), F.lit(0.0)))
    apart = F.col("_contrast") <= F.when(enough, F.col("_most")).otherwise(F.coalesce(F.greatest("_most", highest), F.lit(math.inf)))
    return judged.select(*columns, "perplexity", "threshold", F.coalesce((F.col("perplexity") <= F.col("threshold")) & varied & apart, F.lit(False)).alias("keep"))
