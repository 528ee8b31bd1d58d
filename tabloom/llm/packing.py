"""Operator 2: best-fit packing into bins of several permitted lengths.

The permitted lengths are optimised together: the longest piece left opens a bin; each permitted length that holds it
is filled in trial with the best-fitting pieces left, longest first, downsized to what it would hold, and the length
with the least cost for each token placed is opened and filled so. A bin costs what a model pays for a sequence:
its length, attention that grows with the length's square, and an overhead for each sequence; no single
length is the cheapest for all pieces. Documents longer than the largest length are cut
without loss. Packing runs in shards of about `shard` documents dealt by a hash, so its loss
against one packing of everything is at most the last bins of a shard.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import block_of

CAPACITIES = (512, 1024, 2048, 4096, 8192)
SCHEMA = "doc_id {}, piece int, piece_start long, n_tokens int, bin_id long, bin_capacity int, bin_used int, bin_offset int"


def word_count(text: str | Column = "text") -> Column:
    """Words and one end, natively: the length of a document where no token count is at hand."""
    text = F.col(text) if isinstance(text, str) else text
    spaces = "[\\x20\\x09-\\x0D]+"
    inner = F.regexp_replace(text, f"^{spaces}|{spaces}$", "")
    return F.when(F.coalesce(F.length(inner), F.lit(0)) == 0, F.lit(1)).otherwise(F.size(F.split(inner, spaces)) + 1).cast("long")


def cost_of(c: int, overhead: float, attention: float) -> float:
    """What a sequence of c tokens costs, in tokens: attention is the length at which it costs as much as all else."""
    return c + c * c / attention + overhead


class Left:
    """Pieces not yet placed, by length; a bit set in `mask` says that there is one of that length."""

    def __init__(self, lengths: list[int]):
        self.pieces: dict[int, list[int]] = {}
        for i in reversed(range(len(lengths))):
            self.pieces.setdefault(lengths[i], []).append(i)
        self.mask = sum(1 << n for n in self.pieces)

    def fill(self, room: int) -> list[tuple[int, int]]:
        """(length, how many): what goes into the room, each time the longest that fits."""
        out, mask = [], self.mask
        while mask := mask & ((2 << room) - 1):
            n = mask.bit_length() - 1
            k = min(room // n, len(self.pieces[n]))
            out.append((n, k))
            room -= n * k
            mask ^= 1 << n
        return out

    def take(self, filling: list[tuple[int, int]]) -> list[int]:
        out = []
        for n, k in filling:
            same = self.pieces[n]
            out += [same.pop() for _ in range(k)]
            if not same:
                self.mask ^= 1 << n
        return out


def pack(lengths: list[int], capacities: tuple[int, ...] = CAPACITIES, overhead: float = 64.0, attention: float = 24_576.0) -> tuple[list[list[int]], list[int]]:
    """(pieces of each bin in order of placing, capacity of each bin) for lengths in 1..max(capacities)."""
    sizes = sorted(capacities)
    cost = {c: cost_of(c, overhead, attention) for c in sizes}
    left, bins, kinds = Left(lengths), [], []
    while left.mask:
        longest = left.mask.bit_length() - 1
        trials = []
        for c in sizes:
            if c >= longest:
                filling = left.fill(c)
                used = sum(n * k for n, k in filling)
                kind = next(x for x in sizes if x >= used)
                trials.append((cost[kind] / used, -used, kind, filling))
        *_, kind, filling = min(trials)
        bins.append(left.take(filling))
        kinds.append(kind)
    return bins, kinds


def packed(docs: DataFrame, length: Column | None = None, capacities: tuple[int, ...] = CAPACITIES, overhead: float = 64.0, attention: float = 24_576.0, shard: int = 50_000, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """One row for each piece of each document: see SCHEMA; doc_id has the id's own type.

    length: tokens of a document; word_count(text) if not given; null or under 1 counts as 1.
    piece_start: the piece's first token in its document; bin_offset: in its bin. Repeated rows and
    null ids are packed each; ties go by id, so the packing depends on the rows alone; texts of any length are cut into
    pieces; further columns are left out, whatever their names. An empty table gives no rows.
    """
    n = F.greatest(F.coalesce(length if length is not None else word_count(text), F.lit(1)), F.lit(1)).cast("long")
    rows = docs.select(F.col(id_column).alias("doc_id"), n.alias("n"), F.xxhash64(text).alias("h"))
    schema = SCHEMA.format(rows.schema[0].dataType.simpleString())
    shards = max(1, -(-docs.count() // shard))
    dealt = rows.select("doc_id", "n", block_of(shards, "doc_id", "n", "h").alias("shard"))
    most = max(capacities)

    def fill(group: pa.Table) -> pa.Table:
        key = group.column("shard")[0].as_py()
        ids, sizes = group.column("doc_id").to_pylist(), group.column("n").to_pylist()
        rank = {x: k for k, x in enumerate(sorted({i for i in ids if i is not None}))}
        order = sorted(range(len(ids)), key=lambda i: (rank.get(ids[i], len(rank)), sizes[i]))
        pieces = [(i, k, at, min(most, sizes[i] - at)) for i in order for k, at in enumerate(range(0, sizes[i], most))]
        bins, kinds = pack([p[3] for p in pieces], capacities, overhead, attention)
        out = []
        for b, (members, kind) in enumerate(zip(bins, kinds)):
            used, at = sum(pieces[m][3] for m in members), 0
            for m in members:
                i, k, start, size = pieces[m]
                out.append((ids[i], k, start, size, key << 32 | b, kind, used, at))
                at += size
        types = (group.schema.field("doc_id").type, pa.int32(), pa.int64(), pa.int32(), pa.int64(), pa.int32(), pa.int32(), pa.int32())
        return pa.Table.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), types)], [x.split()[0] for x in SCHEMA.split(", ")])

    return dealt.groupBy("shard").applyInArrow(fill, schema)
