"""Operator 6: token ids as packed matrices.

Each document becomes its ids and one end id; a document longer than the row is cut into pieces
of one row each and a rest. Pieces are packed by best-fit decreasing, the fitting row being found
in a segment tree over remaining capacities. Rows are packed within slices of the input, about SLICE
bytes of text each whatever the batches, so that ids are never shuffled; only the last rows of a slice can be less
full than those of a packing over all documents.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame

from .common import slices
from .pretokens import byte_pairs

#: Text that is packed together.
SLICE = 16 << 20
SCHEMA = "row_id long, n_tokens int, n_segments int, id_bytes int, ids binary, cu_seqlens array<int>, doc_ids array<{}>, piece_starts array<int>, position_resets array<int>"


class Capacities:
    """Segment tree over capacities 0..most: how many open rows have each left."""

    def __init__(self, most: int):
        self.leaves = 1 << most.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.rows: list[list[int]] = [[] for _ in range(most + 1)]

    def add(self, capacity: int, row: int) -> None:
        self.rows[capacity].append(row)
        at = capacity + self.leaves
        while at:
            self.count[at] += 1
            at >>= 1

    def take(self, capacity: int) -> int:
        row = self.rows[capacity].pop()
        at = capacity + self.leaves
        while at:
            self.count[at] -= 1
            at >>= 1
        return row

    def least(self, needed: int) -> int:
        """Smallest capacity of an open row that is at least `needed`; -1 if there is none."""
        at = needed + self.leaves
        if self.count[at]:
            return needed
        while at > 1:
            if not at & 1 and self.count[at + 1]:
                at += 1
                while at < self.leaves:
                    at = 2 * at + (not self.count[2 * at])
                return at - self.leaves
            at >>= 1
        return -1


def best_fit(lengths: list[int], capacity: int) -> list[list[int]]:
    """Indexes of the pieces in each row; lengths in 1..capacity, taken by length, then index."""
    tree, rows = Capacities(capacity), []
    for i in sorted(range(len(lengths)), key=lambda i: (-lengths[i], i)):
        left = tree.least(lengths[i])
        if left < 0:
            left, row = capacity, len(rows)
            rows.append([])
        else:
            row = tree.take(left)
        rows[row].append(i)
        if left > lengths[i]:
            tree.add(left - lengths[i], row)
    return rows


def packed_ids(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int | None = None, slice_bytes: int = SLICE, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """Packed rows of `capacity` ids.

    ids: little-endian, id_bytes bytes each (2 where the vocabulary allows), padded with the end id;
    n_tokens of them are real. cu_seqlens: where segments start, and the end; doc_ids and piece_starts:
    each segment's document (an id of any type) and its first id's place in it; position_resets: the segment starts at
    which position ids begin again at 0 (every segment does, pieces of a cut document too).
    Null and empty texts give one end id; rows with a null id and repeated rows are packed each; an empty table gives no
    rows; columns beside id and text are left out, whatever their names.
    """
    docs = docs.select(id_column, text)
    schema = SCHEMA.format(docs.schema[0].dataType.simpleString())
    names = [f.split()[0] for f in SCHEMA.split(", ")]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs = byte_pairs(tokenizer)
        end = pairs.vocab_size - 1 if end_id is None else end_id
        last, width = np.array([end], pairs.kind).tobytes(), pairs.kind.itemsize
        context = TaskContext.get()
        first = (context.partitionId() if context else 0) << 40
        tokens: list[bytes] = []
        docs_of: list = []
        starts: list[int] = []
        held, slice_no, kind = 0, 0, None
        for batch in slices(batches, text, slice_bytes):
            pairs.trim()
            kind = batch.schema.field(0).type
            for key, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ids = (pairs.ids(t) if t else b"") + last
                for at in range(0, len(ids), capacity * width):
                    tokens.append(ids[at : at + capacity * width])
                    docs_of.append(key)
                    starts.append(at // width)
                held += len(t or "")
                if held >= slice_bytes:
                    yield from rows(first | slice_no << 24, tokens, docs_of, starts, last, kind)
                    tokens, docs_of, starts, held, slice_no = [], [], [], 0, slice_no + 1
        if tokens:
            yield from rows(first | slice_no << 24, tokens, docs_of, starts, last, kind)

    def rows(first: int, tokens: list[bytes], docs_of: list, starts: list[int], last: bytes, kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        width = len(last)
        sizes = [len(x) // width for x in tokens]
        kinds = (pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(kind), pa.list_(pa.int32()), pa.list_(pa.int32()))
        packed = best_fit(sizes, capacity)
        for at in range(0, len(packed), 1024):
            out = []
            for r, row in enumerate(packed[at : at + 1024], at):
                edges = [0, *accumulate(sizes[i] for i in row)]
                matrix = b"".join([*(tokens[i] for i in row), last * (capacity - edges[-1])])
                out.append((first | r, edges[-1], len(row), width, matrix, edges, [docs_of[i] for i in row], [starts[i] for i in row], edges[:-1]))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names)

    return docs.mapInArrow(pack, schema)


def write_packed(packed: DataFrame, path: str) -> None:
    """The rows as Parquet files of raw matrices, uncompressed ids being of little use on disk."""
    packed.write.option("compression", "zstd").parquet(path)
