"""Operator 3: removal of repeated substrings by suffix automata.

A run of `window` words that also starts earlier in the corpus is removed. Trying every document
against an automaton of everything before it would grow with the square of the corpus, so
reference and documents are sharded by content: of the short word runs inside a window the one with the least
hash is its anchor, equal windows have equal anchors, and windows with one anchor in sequence form one
passage. Anchors that occur once in the corpus drop out. The passages of an anchor meet in one
place, are streamed in corpus order through a suffix automaton of those before them, and
wherever the matching statistic (the longest suffix seen earlier) reaches the window, the window's
words are marked.

Copies of a passage within a block of documents are known as such in the block and cost nothing
further, so that an anchor has at most one passage a block and distinct surrounding. Where that is many still, the
anchor's windows are dealt out one by one, each to the place of its own words, so that a run of words that half the
corpus has, each time among others, isn't one task's work.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .blocks import blocked
from .common import rolled, split_words

ANCHOR = 8
#: Passages of an anchor, copies in a block counted once, beyond which its windows are dealt out one by one.
MANY = 10_000
BASE = np.uint64(0x9E3779B97F4A7C15)


class SuffixAutomaton:
    """Online automaton of the sequences added so far, over any hashable symbols."""

    def __init__(self):
        self.next: list[dict] = [{}]
        self.link, self.length, self.last = [-1], [0], 0

    def extend(self, symbol) -> int:
        """Adds a symbol; how long a suffix of all that was added also ends earlier."""
        nexts, link, length = self.next, self.link, self.length
        p, now = self.last, len(nexts)
        nexts.append({})
        length.append(length[p] + 1)
        link.append(0)
        while p >= 0 and symbol not in nexts[p]:
            nexts[p][symbol] = now
            p = link[p]
        if p >= 0:
            q = nexts[p][symbol]
            if length[p] + 1 == length[q]:
                link[now] = q
            else:
                clone = len(nexts)
                nexts.append(dict(nexts[q]))
                length.append(length[p] + 1)
                link.append(link[q])
                while p >= 0 and nexts[p].get(symbol) == q:
                    nexts[p][symbol] = clone
                    p = link[p]
                link[q] = link[now] = clone
        self.last = now
        return length[link[now]]


class Block:
    """The documents of a block in order of id and the text's hash, with the passages of their windows.

    lines: each document's words, joined by a space; counts: how many.
    """

    def __init__(self, block: pa.Table, window: int):
        ids, h = block.column("id").to_pylist(), block.column("h").to_pylist()
        rank = {x: k for k, x in enumerate(sorted({i for i in ids if i is not None}))}
        order = sorted(range(len(ids)), key=lambda i: (rank.get(ids[i], len(rank)), h[i]))
        self.ids, self.h, self.window = [ids[i] for i in order], [h[i] for i in order], window
        lists, self.flat, self.counts = split_words(block.column("text").take(pa.array(order, pa.int64())))
        self.lines = pc.binary_join(lists, " ").cast(pa.binary()).to_pylist()
        self.first = np.cumsum(self.counts) - self.counts

    def ends(self) -> tuple[np.ndarray, np.ndarray]:
        """Where each word of all documents begins and ends in its document's line."""
        size = pc.binary_length(self.flat).to_numpy().astype(np.int64)
        end = np.cumsum(size + 1) - 1
        base = np.concatenate(([0], end + 1))[np.repeat(self.first, self.counts)]
        return end - size - base, end - base

    def passages(self) -> tuple[np.ndarray, ...]:
        """(document, first window, number of windows, anchor, whether a window comes twice nearby, hash) of each passage."""
        window, anchor, n = self.window, min(ANCHOR, self.window), len(self.flat)
        if n < window:
            return *(np.empty(0, np.int64) for _ in range(4)), np.empty(0, bool), np.empty(0, np.uint64)
        words = self.flat.dictionary_encode()
        of_word = np.fromiter(map(xxhash.xxh64_intdigest, words.dictionary.cast(pa.binary()).to_pylist()), np.uint64, len(words.dictionary))
        h = of_word[words.indices.to_numpy()]
        doc = np.repeat(np.arange(len(self.counts)), self.counts)
        # over all documents at once; windows that go from one into the next are left out
        full, least, reach, done = rolled(h, window), rolled(h, anchor), window - anchor + 1, 1
        while done < reach:
            step = min(done, reach - done)
            least = np.minimum(least[:-step], least[step:])
            done += step
        inside = np.flatnonzero(doc[: n - window + 1] == doc[window - 1 :])
        full, least, doc = full[inside], least[inside], doc[inside]
        place = inside - self.first[doc]
        if not len(inside):
            return *(np.empty(0, np.int64) for _ in range(4)), np.empty(0, bool), np.empty(0, np.uint64)
        starts = np.flatnonzero(np.concatenate(([True], (least[1:] != least[:-1]) | (doc[1:] != doc[:-1]))))
        twice = np.zeros(len(full), bool)
        for d in range(1, min(reach, len(full) - 1) + 1):
            twice[d:] |= (full[d:] == full[:-d]) & (place[d:] >= d)
        sizes = np.diff(np.concatenate((starts, [len(full)])))
        near = np.logical_or.reduceat(twice, starts) | (sizes > reach)
        print_ = (full[starts] * BASE ^ full[starts + sizes - 1]) * BASE + sizes.astype(np.uint64)
        return doc[starts], place[starts], sizes, least[starts].view(np.int64), near, print_


def _marked(passages: list[tuple[int, list[bytes]]], window: int) -> dict[int, list[int]]:
    """place -> first words of the windows seen earlier, for (place, words) in corpus order, all distinct."""
    found: dict[int, list[int]] = {}
    automaton = SuffixAutomaton()
    for k, (place, words) in enumerate(passages):
        starts = [i - window + 1 for i, w in enumerate(words) if automaton.extend(w) >= window]
        if starts:
            found[place] = starts
        automaton.extend(k)  # a symbol of its own ends the passage
    return found


def _spans(starts: list[int], window: int) -> Iterator[tuple[int, int]]:
    """Windows' first words as spans of words that follow one another."""
    for _, run in groupby(enumerate(starts), lambda x: x[1] - x[0]):
        run = [s for _, s in run]
        yield run[0], run[-1] + window


def without_repeats(docs: DataFrame, window: int = 20, id_column: str = "doc_id", text: str = "text", kept_text: bool = False, many: int = MANY) -> DataFrame:
    """(id, n_words, n_removed, kept_sha256[, kept]) of each document.

    Words are runs of anything but ASCII white space. Removed is each word in a window of `window` words that
    also starts earlier: in a document of a smaller id, or in this one; a null id comes last, and
    rows with one id come in order of the hashes of their texts. kept: the other words, joined by a space; kept_sha256: its digest. Null and
    empty texts have no words; texts of any length are compared whole; an empty table gives no rows; further columns are left out.
    """
    kind = docs.schema[id_column].dataType.simpleString()
    rows = blocked(docs.select(F.col(id_column).alias("id"), F.col(text).alias("text"), F.xxhash64(text).alias("h")), "id", "text")

    def anchors(block: pa.Table) -> pa.Table:
        if not block.num_rows:
            return pa.table({"anchor": pa.array([], pa.int64()), "block": pa.array([], pa.int32()), "passages": pa.array([], pa.int32())})
        *_, anchor, _, print_ = Block(block, window).passages()
        _, first = np.unique(print_ ^ anchor.view(np.uint64) * BASE, return_index=True)
        found, n = np.unique(anchor[first], return_counts=True)
        return pa.table({"anchor": pa.array(found), "block": pa.array(np.full(len(found), block.column("block")[0].as_py(), np.int32)), "passages": pa.array(n, pa.int32())})

    # the anchors that several blocks have, for each of these, from one look at the texts
    same = Window.partitionBy("anchor")
    named = rows.groupBy("block").applyInArrow(anchors, "anchor long, block int, passages int")
    counted = named.withColumn("n", F.count("*").over(same)).withColumn("total", F.sum("passages").over(same))
    shared = counted.where((F.col("n") > 1) | (F.col("total") > many)).select("anchor", "block", (F.col("total") > many).alias("hot"))

    passage_names = ["anchor", "doc", "h", "row", "block", "start", "n", "words"]
    passage_kinds = (pa.int64(), None, pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary())

    def passages(block: pa.Table, common: pa.Table) -> pa.Table:
        out: list[tuple] = []
        kinds = [k or block.schema.field("id").type for k in passage_kinds]
        if block.num_rows:
            here, number = Block(block, window), block.column("block")[0].as_py()
            doc, start, n, anchor, near, _ = here.passages()
            values, counts = np.unique(anchor, return_counts=True)
            twice = np.isin(anchor, values[counts > 1])
            known, hot = common.column("anchor").to_numpy(), common.column("hot").to_numpy(zero_copy_only=False)
            wanted = np.flatnonzero(np.isin(anchor, known) | twice | near)
            spread = np.isin(anchor, known[hot])
            first: set[tuple[int, bytes]] = set()
            begins, ends = here.ends()
            for a, k, s, m, each in zip(*(x[wanted].tolist() for x in (anchor, doc, start, n, spread))):
                base = int(here.first[k])
                for s, m in ((i, 1) for i in range(s, s + m)) if each else ((s, m),):  # noqa: B020, PLW2901
                    line = here.lines[k][begins[base + s] : ends[base + s + m + window - 2]]
                    key = (int.from_bytes(xxhash.xxh64_digest(line), signed=True) if each else a), line
                    # of equal passages only the first of the block is looked at; null words: all seen earlier
                    out.append((key[0], here.ids[k], here.h[k], k, number, s, m, None if key in first else line))
                    first.add(key)
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * 8, kinds)], passage_names)

    met = rows.groupBy("block").cogroup(shared.groupBy("block")).applyInArrow(passages, f"anchor long, doc {kind}, h long, row int, block int, start int, n int, words binary")
    in_order = met.repartition("anchor").sortWithinPartitions("anchor", F.col("doc").asc_nulls_last(), "h", "row", "start")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, distinct, seen = None, [], set()
        places: list[tuple[int, int, int]] = []
        out: list[tuple[int, int, int, int]] = []

        def flush() -> None:
            if len(distinct) > 1 or distinct and len(distinct[0][1]) > window:
                for place, starts in _marked(distinct, window).items():
                    block, row, start = places[place]
                    out.extend((block, row, start + a, start + b) for a, b in _spans(starts, window))

        def record() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, pa.int32()) for c in list(zip(*out)) or [()] * 4], ["block", "row", "start", "end"])
            out.clear()
            return made

        for batch in batches:
            for anchor, row, block, start, n, words in zip(*(batch.column(i).to_pylist() for i in (0, 3, 4, 5, 6, 7))):
                if anchor != now:
                    flush()
                    now, distinct, seen, places = anchor, [], set(), []
                if words is None or words in seen:
                    out.append((block, row, start, start + n + window - 1))
                else:
                    seen.add(words)
                    distinct.append((len(places), words.split()))
                    places.append((block, row, start))
            yield record()
        flush()
        yield record()

    spans = in_order.mapInArrow(mark, "block int, row int, start int, end int")
    schema = f"id {kind}, n_words long, n_removed long, kept_sha256 string" + ", kept string" * kept_text

    def keep(block: pa.Table, spans: pa.Table) -> pa.Table:
        here = Block(block, window)
        removed = {k: np.zeros(here.counts[k], bool) for k in set(spans.column("row").to_pylist())}
        for row, a, b in zip(*(spans.column(c).to_pylist() for c in ("row", "start", "end"))):
            removed[row][a:b] = True
        out = []
        for k, (key, line) in enumerate(zip(here.ids, here.lines)):
            gone = removed.get(k)
            if gone is not None:
                line = b" ".join([w for w, x in zip(line.split(), gone.tolist()) if not x])  # noqa: PLW2901
            out.append((key, int(here.counts[k]), 0 if gone is None else int(gone.sum()), hashlib.sha256(line).hexdigest(), *[line] * kept_text))
        kinds = (block.schema.field("id").type, pa.int64(), pa.int64(), pa.string(), pa.string())
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*out)) or [()] * (4 + kept_text), kinds)], ["id", "n_words", "n_removed", "kept_sha256", *["kept"] * kept_text])

    return rows.groupBy("block").cogroup(spans.groupBy("block")).applyInArrow(keep, schema).withColumnRenamed("id", id_column)
