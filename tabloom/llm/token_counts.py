"""Operator 5: token counts without token ids.

Pieces are counted once per distinct pre-token; a document's count is the sum over its pre-token
frequencies of frequency times pieces. The join happens where the text is: a worker keeps the
table of distinct pre-tokens, so nothing is shuffled and no ids are built. (A table over the
whole corpus would need every (document, pre-token) pair to be shuffled to save a few
microseconds per pre-token and worker.)
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from functools import lru_cache
from operator import mul

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import slices, with_fields
from .pretokens import MOST_KEPT, byte_pairs


class Counts(dict):
    """pre-token -> number of pieces."""

    def __init__(self, path: str):
        super().__init__()
        self.pairs = byte_pairs(path)

    def __missing__(self, piece: str) -> int:
        n = self[piece] = len(self.pairs.numbers(piece))
        return n

    def of(self, text: str) -> int:
        frequency = Counter(self.pairs.split(text))
        return sum(map(mul, map(self.__getitem__, frequency), frequency.values()))


@lru_cache(maxsize=2)
def counts_of(path: str) -> Counts:
    """One per worker process and file."""
    return Counts(path)


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 512, text: str = "text") -> DataFrame:
    """docs with n_bytes, n_tokens and over_limit (n_tokens > limit) added.

    tokenizer: file of a byte-level BPE vocabulary. Null and empty texts have 0 bytes and 0 tokens; texts of any length
    are counted whole; repeated rows are counted each; an empty table gives no rows; of the input's columns, those with the added names are replaced.
    """
    added = {"n_bytes": "long", "n_tokens": "long"}
    kept = docs.drop(*added, "over_limit")
    schema = with_fields(kept, added)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = counts_of(tokenizer)
        for batch in slices(batches, text):
            if len(counts) > MOST_KEPT:
                counts.clear()
            texts = batch.column(batch.schema.get_field_index(text))
            n_bytes = pa.compute.fill_null(pa.compute.binary_length(texts.cast(pa.binary())), 0).cast(pa.int64())
            n_tokens = pa.array([counts.of(t) if t else 0 for t in texts.to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([*batch.columns, n_bytes, n_tokens], [*batch.schema.names, *added])

    return kept.mapInArrow(count, schema).withColumn("over_limit", F.col("n_tokens") > limit)
