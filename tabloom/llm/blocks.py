"""Joins between the words of documents and a large table of words, without a row for each word of each document.

Documents are dealt into blocks of bounded text by a hash of their id and text, so that rows that share an id, or have none, are spread too. Each block names its
distinct words once; these few rows are joined to the table, and the block meets its words' values
in one place, where documents are summed over. A word that every document has is one row a block.
"""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame

from .common import block_of, text_bytes

BLOCK_BYTES = 12 << 20


def blocked(docs: DataFrame, id_column: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs with an int column `block`, each block of about block_bytes of text."""
    return docs.withColumn("block", block_of(max(1, -(-text_bytes(docs, text) // block_bytes)), id_column, text))


def valued(docs: DataFrame, words: Callable[[pa.Table], pa.Array], values: DataFrame, score: Callable[[pa.Table, pa.Table], pa.Table], schema: str) -> DataFrame:
    """score(block of docs, rows of values for the block's words) for each block.

    docs: a result of blocked(); words: the distinct words of a block; values: one row for each word,
    in a binary column `word`.
    """

    def name(block: pa.Table) -> pa.Table:
        if not block.num_rows:
            return pa.table({"block": pa.array([], pa.int32()), "word": pa.array([], pa.binary())})
        found = words(block)
        return pa.table({"block": pa.repeat(block.column("block")[0], len(found)), "word": found})

    named = docs.groupBy("block").applyInArrow(name, "block int, word binary")
    met = named.join(values, "word")
    return docs.groupBy("block").cogroup(met.groupBy("block")).applyInArrow(score, schema)
