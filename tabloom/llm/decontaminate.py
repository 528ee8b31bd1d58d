"""Operator 9: benchmark decontamination by a prefix-filtered join.

An item's shingles are its runs of `window` words (all its words, if it has fewer). A document is
searched for whole shingles only, that is, for a similarity of 1 over an item-sized window, so the
necessary prefix of a shingle, its words put in order of rarity over all documents, is its rarest
word alone. A document's words are matched against these prefix words only; a match fixes where in the
document the shingle would have to lie (positional bound), whether it fits there (length bound),
and is then verified word by word.

Items come to the workers in blocks of a fixed number of shingles, so that what a worker holds is bounded however many
items there are. With several blocks, each looks at the documents' texts by itself and writes the hits, of documents
that have any, and these meet once at the end: the work grows with the blocks, not with their square.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import bytes_of, slices, with_fields, written

#: ASCII letters to lower case, all ASCII but letters and digits to a space.
FOLD = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
#: Shingles in a block: with their words about 100 MB in a worker.
BLOCK = 200_000


def words_of(text: bytes | None) -> list[bytes]:
    return text.translate(FOLD).split() if text else []


def shingles(words: list[bytes], window: int) -> list[tuple[bytes, ...]]:
    if not words:
        return []
    return [tuple(words[i : i + window]) for i in range(max(1, len(words) - window + 1))]


def item_blocks(items: DataFrame, window: int, item_id: str, text: str, most: int) -> Iterator[dict[tuple[bytes, ...], set]]:
    """shingle -> ids of items, in blocks of about `most` shingles; one partition at a time reaches the driver."""
    block: dict[tuple[bytes, ...], set] = {}
    rows = items.select(F.col(item_id).cast("string"), F.col(text)).where(F.col(item_id).isNotNull() & F.col(text).isNotNull())
    for key, t in rows.toLocalIterator():
        for s in shingles(words_of(t.encode()), window):
            block.setdefault(s, set()).add(key)
            if len(block) >= most:
                yield block
                block = {}
    if block:
        yield block


def document_counts(docs: DataFrame, words: frozenset[bytes], text: str) -> dict[bytes, int]:
    """In how many documents each of the words occurs; the words are those of one block of items."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: Counter = Counter()
        for batch in slices(batches, text):
            for t in bytes_of(batch, text):
                found.update(words & set(words_of(t)))
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

    rows = docs.select(text).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r.word): r.n for r in rows.toLocalIterator()}


class Index:
    """Shingles by their rarest word: word -> [(its place in the shingle, shingle, item ids)]."""

    def __init__(self, block: dict[tuple[bytes, ...], set], counts: dict[bytes, int]):
        self.by_word: dict[bytes, list] = {}
        for s, ids in block.items():
            at = min(range(len(s)), key=lambda i: (counts.get(s[i], 0), s[i], i))
            self.by_word.setdefault(s[at], []).append((at, list(s), frozenset(ids)))

    def hits(self, words: list[bytes]) -> tuple[set[int], set[str]]:
        """Places of the words inside any occurrence, and the items that occur."""
        places: set[int] = set()
        items: set[str] = set()
        by_word, n = self.by_word, len(words)
        if by_word.keys().isdisjoint(words):
            return places, items
        for i, w in enumerate(words):
            if w in by_word:
                for at, s, ids in by_word[w]:
                    start = i - at
                    if start >= 0 and start + len(s) <= n and words[start : start + len(s)] == s:
                        places.update(range(start, start + len(s)))
                        items |= ids
        return places, items


def contamination(docs: DataFrame, items: DataFrame, window: int = 8, least_items: int = 2, item_id: str = "item_id", text: str = "text", block: int = BLOCK) -> DataFrame:
    """docs with n_words, n_hit, n_items, item_ids (sorted as strings) and contaminated added.

    n_hit: words inside any occurrence of a shingle of any item; contaminated: n_items >= least_items.
    Null and empty texts have no words, texts of any length are searched whole; items with a null id or text, or without words, occur
    nowhere; an id on several rows is one item, and repeated documents are each judged; an empty table of documents gives no
    rows, one of items leaves every document clean. Of the documents' columns, those with the added names are replaced.
    """
    added = {"n_words": "long", "n_hit": "long", "n_items": "long", "item_ids": "array<string>"}
    kept = docs.drop(*added, "contaminated")
    blocks = item_blocks(items, window, item_id, text, block)
    first, second = next(blocks, {}), next(blocks, None)
    if second is None:
        out = searched(kept, first, text, added)
    else:
        # rows are numbered in a table, so that every look at them sees the same numbers
        numbered = written(kept.withColumn("__row", F.monotonically_increasing_id()), "documents")
        places = {"n_words": "long", "__places": "array<int>", "item_ids": "array<string>"}
        hits = None
        for part in chain((first, second), blocks):
            found = written(searched(numbered.select("__row", text), part, text, places).where("size(item_ids) > 0").drop(text, "n_words"), "hits")
            hits = found if hits is None else hits.unionByName(found)
        met = hits.groupBy("__row").agg(F.size(F.array_distinct(F.flatten(F.collect_list("__places")))).alias("__hit"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("item_ids")))).alias("__items"))
        counted = searched(numbered, {}, text, {"n_words": "long"})
        out = counted.join(met, "__row", "left").withColumn("item_ids", F.coalesce("__items", F.array().cast("array<string>")))
        out = out.withColumn("n_hit", F.coalesce("__hit", F.lit(0)).cast("long")).withColumn("n_items", F.size("item_ids").cast("long")).select(*kept.columns, *added)
    return out.withColumn("contaminated", F.col("n_items") >= least_items)


def searched(docs: DataFrame, shingled: dict[tuple[bytes, ...], set], text: str, added: dict[str, str]) -> DataFrame:
    """docs with columns of what one block of shingles has in them: n_words, n_hit, n_items, __places, item_ids, those that are in `added`."""
    counts = document_counts(docs, frozenset(w for s in shingled for w in s), text) if shingled else {}
    index = docs.sparkSession.sparkContext.broadcast(Index(shingled, counts))
    schema = with_fields(docs, added)
    kinds = {"n_words": pa.int64(), "n_hit": pa.int64(), "n_items": pa.int64(), "__places": pa.list_(pa.int32()), "item_ids": pa.list_(pa.string())}

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            rows: dict[str, list] = {name: [] for name in kinds}
            for t in bytes_of(batch, text):
                words = words_of(t)
                places, found = index.value.hits(words)
                for column, x in zip(rows.values(), (len(words), len(places), len(found), sorted(places), sorted(found))):
                    column.append(x)
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(rows[c], kinds[c]) for c in added)], [*batch.schema.names, *added])

    return docs.mapInArrow(search, schema)
