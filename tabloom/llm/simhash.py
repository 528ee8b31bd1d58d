"""Operator 10: near duplicates by SimHash with deletion-variant signatures.

Fingerprints that differ in at most `radius` bits are found without trying all pairs: a fingerprint is
cut into the fewest segments of which one must differ in at most one bit. For each segment and each of its bits,
the segment with that bit wild is a key; two segments that differ in at most one bit share one. Rows that
share a key meet in one place, are verified there by the count of differing bits, and leave links. Copies
share a fingerprint and are one row of this index. Of a bucket with many rows only a spanning
forest of its links is kept, which has the same components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from .common import bytes_of, discard, rolled, slices, with_fields, written
from .components import components

BITS = 64
#: Where a key holds the number of its wild bit; segments are narrower at any radius of 2 or more.
WILD = 48
#: Rows of a bucket up to which all its pairs are tried at once.
SMALL = 24
#: Rows of a larger one up to which all pairs are looked at first, and a forest is grown only where many of them are links.
SQUARE = 1024
CHUNK = 1 << 16


def shingle_hashes(text: bytes | None, words: int, seed: int = 42) -> np.ndarray:
    """XXH64 of every run of `words` words, joined by a space; of all words if there are fewer."""
    tokens = text.lower().split() if text else []
    if not tokens:
        return np.empty(0, np.uint64)
    line, digest = b" ".join(tokens), xxhash.xxh64_intdigest
    ends = np.cumsum(np.fromiter(map(len, tokens), np.int64, len(tokens)) + 1)
    starts = np.concatenate(([0], ends[:-1]))
    k = min(words, len(tokens))
    cut = zip(starts[: len(tokens) - k + 1].tolist(), (ends[k - 1 :] - 1).tolist())
    return np.array([digest(line[a:b], seed) for a, b in cut], np.uint64)


def run_hashes(text: bytes | None, *sizes: int) -> list[np.ndarray]:
    """For each size, a hash of every run of so many words (of all words, if there are fewer) from one hash of each word."""
    tokens = text.lower().split() if text else []
    words = np.fromiter(map(xxhash.xxh64_intdigest, tokens), np.uint64, len(tokens))
    return [rolled(words, min(k, max(1, len(words)))) for k in sizes]


def fingerprint(hashes: np.ndarray) -> int:
    """Bit by bit, 1 where over half of the hashes have 1; as a signed 64-bit number."""
    ones = np.zeros(BITS, np.int64)
    for i in range(0, len(hashes), CHUNK):
        part = hashes[i : i + CHUNK]
        ones += np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > len(hashes), bitorder="little")
    return int(bits.view(np.int64)[0])


def fingerprints(docs: DataFrame, words: int = 4, text: str = "text", name: str = "fingerprint") -> DataFrame:
    """docs with a long column of fingerprints in place of the text; null and empty texts have 0."""
    others = [c for c in docs.columns if c not in (text, name)]
    schema = with_fields(docs.select(*others), {name: "long"})

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            found = pa.array([fingerprint(shingle_hashes(t, words)) for t in bytes_of(batch, text)], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in others), found], [*others, name])

    return docs.select(*others, text).mapInArrow(digest, schema)


def cuts(radius: int) -> list[tuple[int, int]]:
    """(shift, width) of the fewest segments of which one differs in at most one bit at `radius`."""
    n = max(2, radius // 2 + 1)
    edges = [round(i * BITS / n) for i in range(n + 1)]
    return [(a, b - a) for a, b in zip(edges, edges[1:])]


def variants(fp: Column, radius: int) -> Column:
    """Keys of a fingerprint: the number of the wild bit, and its segment with that bit at 0."""
    out = []
    for shift, width in cuts(radius):
        part = F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << width) - 1))
        for p in range(width):
            wild = part.bitwiseAND(F.lit(((1 << width) - 1) ^ (1 << p)))
            out.append(wild.bitwiseOR(F.lit(shift + p << WILD)))
    return F.array(*out)


def _forest(fps: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Edges with the components of the links among distinct fingerprints: few links as they are, many as a spanning forest, breadth first."""
    if len(fps) <= SQUARE:
        i, j = np.nonzero(np.bitwise_count(fps[:, None] ^ fps) <= radius)
        if len(i) <= 9 * len(fps):
            return list(zip(fps[i[i < j]].tolist(), fps[j[i < j]].tolist()))
    edges, rest = [], fps
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            at = queue.pop()
            near = np.bitwise_count(rest ^ at) <= radius
            if near.any():
                found = rest[near]
                edges += [(int(at), int(x)) for x in found]
                queue += list(found)
                rest = rest[~near]
    return edges


def _first_key(x: np.ndarray, wild: np.ndarray, radius: int) -> np.ndarray:
    """Of all keys that a pair shares, is it the first? x: differing bits; wild: the key's bit."""
    first = np.zeros(len(x), bool)
    open_ = np.ones(len(x), bool)
    for shift, width in cuts(radius):
        part = x >> np.uint64(shift) & np.uint64((1 << width) - 1)
        fits = open_ & (np.bitwise_count(part) <= 1)
        here = (wild >= shift) & (wild < shift + width)
        first |= fits & here & ((part != 0) | (wild == shift))
        open_ &= ~fits
    return first


def links(fps: DataFrame, radius: int = 4, name: str = "fingerprint") -> DataFrame:
    """(a, b): links among distinct fingerprints, enough of them for the same components."""
    keyed = fps.select(F.explode(variants(F.col(name), radius)).alias("key"), F.col(name).alias("fp"))
    sort = keyed.repartition("key").sortWithinPartitions("key")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, values = np.empty(0, np.int64), np.empty(0, np.uint64)
        for batch in batches:
            keys = np.concatenate((keys, batch.column(0).to_numpy()))
            values = np.concatenate((values, batch.column(1).to_numpy().view(np.uint64)))
            if len(keys) and keys[0] != keys[-1]:
                done = int(np.searchsorted(keys, keys[-1]))  # the last bucket may go on in the next batch
                yield from bucketed(keys[:done], values[:done])
                keys, values = keys[done:], values[done:]
        yield from bucketed(keys, values)

    def bucketed(keys: np.ndarray, values: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(keys) < 2:
            return
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        sizes = np.diff(np.concatenate((starts, [len(keys)])))
        a, b = [], []
        small = np.repeat(sizes <= SMALL, sizes)
        for d in range(1, min(SMALL, int(sizes.max()))):
            i = np.flatnonzero((keys[d:] == keys[:-d]) & small[d:])
            x = values[i] ^ values[i + d]
            near = np.bitwise_count(x) <= radius
            i, x = i[near], x[near]
            i = i[_first_key(x, keys[i] >> WILD, radius)]
            a.append(values[i])
            b.append(values[i + d])
        for s, n in zip(starts[sizes > SMALL].tolist(), sizes[sizes > SMALL].tolist()):
            if edges := _forest(values[s : s + n], radius):
                left, right = np.array(edges, np.uint64).T
                a.append(left)
                b.append(right)
        if a:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], ["a", "b"])

    return sort.mapInArrow(meet, "a long, b long").distinct()


def groups(prints: DataFrame, radius: int = 4, id_column: str = "doc_id", name: str = "fingerprint") -> DataFrame:
    """(fingerprint, component_id): for each distinct fingerprint the least id that it can be linked to."""
    nodes = written(prints.groupBy(name).agg(F.min(id_column).alias("least")), "fingerprints")
    found = components(links(nodes, radius, name)).select(F.col("node").alias(name), "root")
    rooted = nodes.join(found, name, "left").withColumn("root", F.coalesce("root", name))
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rooted.join(least, "root").select(name, "component_id")


def near_duplicates(docs: DataFrame, words: int = 4, radius: int = 4, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, fingerprint as 16 hex digits, component_id) of each row.

    component_id: the least id that links of at most `radius` differing bits reach, itself included.
    Null and empty texts have fingerprint zero and are linked like any other; rows with a null id
    get a fingerprint and the least id of their component, null if it has none; repeated rows stay; texts of any length
    are fingerprinted whole; an empty table gives no rows; further columns are left out, whatever their names.
    """
    prints = written(fingerprints(docs.select(id_column, text), words, text), "prints")
    of = groups(prints, radius, id_column)
    digits = F.lpad(F.lower(F.hex("fingerprint")), 16, "0")
    return prints.join(of, "fingerprint").select(id_column, digits.alias("fingerprint"), "component_id")


def shingle_set(text: bytes | None, words: int) -> np.ndarray:
    """Sorted hashes of a text's different runs of `words` words."""
    return np.unique(run_hashes(text, words)[0])


#: Of so many sets one has a frequent shingle.
FREQUENT = 8


def tied(sets: list[np.ndarray], similarity: float) -> np.ndarray:
    """For each sorted set the first one that a chain of similar sets ties it to, itself included. Equal sets are similar.

    Similar sets share one of their first shingles in any order common to all, here from the rarest among these sets on. Rare ones
    are met one by one; what sets share of those that one in FREQUENT of them has is a product of matrices. Of the sets that
    meet, those not tied yet that may share enough are compared, many at once.
    """
    n, seen = len(sets), {}
    same = np.array([seen.setdefault(xxhash.xxh128_digest(s.tobytes()), k) for k, s in enumerate(sets)], np.int64)
    if len(seen) < 2:
        return same
    sizes = np.where(same == np.arange(n), [len(s) for s in sets], 0)
    ends = np.cumsum(sizes)
    begins, owner = ends - sizes, np.repeat(np.arange(n), sizes)
    _, codes, counts = np.unique(np.concatenate([s[:m] for s, m in zip(sets, sizes)]), return_inverse=True, return_counts=True)
    order = np.argsort(counts, kind="stable")
    rank = np.empty(len(order), np.int64)
    rank[order] = np.arange(len(order))
    codes = rank[codes]
    codes = codes[np.lexsort((codes, owner))]
    several, often = np.searchsorted(counts[order], 2), np.searchsorted(counts[order], max(4, n / FREQUENT))
    rare = np.bincount(owner[(codes >= several) & (codes < often)], minlength=n)  # shingles that others may share, of the rare ones
    matrix = np.zeros((n, len(order) - often), np.float32)
    matrix[owner[codes >= often], codes[codes >= often] - often] = 1
    firsts = sizes - np.ceil(similarity * sizes - 1e-9).astype(np.int64) + 1
    meets = np.flatnonzero((np.arange(len(codes)) - begins[owner] < firsts[owner]) & (codes >= several) & (codes < often))
    by_code = meets[np.argsort(codes[meets], kind="stable")]  # of each shingle the sets in order
    members, key = owner[by_code], codes[by_code]
    start = np.searchsorted(key, key)
    by_set = np.argsort(members, kind="stable")
    cuts = np.searchsorted(members[by_set], np.arange(n + 1))
    label, held = np.arange(n), {}
    mark = np.zeros(len(order), bool)
    rows, both = max(1, min(256, (1 << 22) // n)), None
    for k in range(n):
        if matrix.shape[1]:
            if k % rows == 0:
                both = matrix[k : k + rows] @ matrix[: k + rows].T
            shared = both[k % rows, :k]
            most = shared + np.minimum(rare[:k], rare[k])
            met = np.flatnonzero((shared > 0) & (label[:k] != label[k]) & (most >= similarity * (sizes[:k] + sizes[k] - most) - 1e-6))
        else:
            met = np.empty(0, np.int64)
        at = by_set[cuts[k] : cuts[k + 1]]
        if len(at):
            hits = members[_ranges(start[at], at - start[at])]  # earlier sets with one of the first shingles
            hits = hits[label[hits] != label[k]]
            low, high = np.minimum(sizes[hits], sizes[k]), np.maximum(sizes[hits], sizes[k])
            met = np.union1d(met, hits[low >= similarity * high - 1e-9])
        if not len(met):
            continue
        mark[codes[begins[k] : ends[k]]] = True
        most = 8
        while len(met):
            now, met = met[:most], met[most:]
            inside = mark[codes[_ranges(begins[now], sizes[now])]]
            shared = np.add.reduceat(inside, np.cumsum(sizes[now]) - sizes[now], dtype=np.int64)
            for x in now[shared >= similarity * (sizes[now] + sizes[k] - shared) - 1e-9].tolist():
                a, b = int(label[x]), int(label[k])
                if a != b:
                    less, more = sorted((held.pop(a, [a]), held.pop(b, [b])), key=len)
                    label[less] = to = int(label[more[0]])
                    held[to] = more + less
            met = met[label[met] != label[k]]
            most = min(2 * most, 1024)
        mark[codes[begins[k] : ends[k]]] = False
    _, first, of = np.unique(label[same], return_index=True, return_inverse=True)
    return first[of]


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """start, start + 1, ... for each start, as many as its size says, one after another."""
    ends = np.cumsum(sizes)
    return np.repeat(starts - ends + sizes, sizes) + np.arange(ends[-1] if len(ends) else 0)


#: Share of the documents in which common shingles are counted; bytes of the table of how common they are, at most, and for each of them below that.
#: All bear on the order of shingles alone.
COUNTED, MOST_COMMON, CELLS = 8, 1 << 25, 4
#: Documents that share a prefix shingle up to which all their pairs are counted.
PAIRED = 64


def common_shingles(docs: DataFrame, words: int, id_column: str = "doc_id", text: str = "text") -> tuple[np.ndarray, int]:
    """(table, shift): how common shingles are that several documents of a share of docs have, by the first bits of their hashes.

    All of them are in the table, however many: which ones are known doesn't depend on the size of docs. Of those in one
    cell the most common one counts; a rare one in such a cell comes late in the order, as it does for all documents.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, text):
            found = [np.unique(run_hashes(t, words)[0]) for t in bytes_of(batch, text)]
            h, n = np.unique(np.concatenate(found), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(n, pa.int64())], ["h", "n"])

    share = docs.where(F.pmod(F.xxhash64(id_column), F.lit(COUNTED)) == 0).select(text)
    counts = share.mapInArrow(count, "h long, n long").groupBy("h").agg(F.sum("n").alias("n")).where("n > 2")
    counts = written(counts, "common")
    bits = min((CELLS * counts.count()).bit_length(), max(1, MOST_COMMON).bit_length() - 1)
    if not bits:
        return np.empty(0, np.uint8), 0
    level = F.least(F.floor(12 * F.log2("n")), F.lit(255)).cast("short")
    got = counts.groupBy(F.shiftrightunsigned("h", 64 - bits).cast("int").alias("cell")).agg(F.max(level).alias("level")).toArrow()
    found = np.zeros(1 << bits, np.uint8)
    found[got.column("cell").to_numpy()] = got.column("level").to_numpy()
    return found, 64 - bits


def shared_least(n: int) -> int:
    """How many prefix shingles two similar sets share at least, the smaller of which has n shingles."""
    return 1 + n // 20


def prefix(found: np.ndarray, common: tuple[np.ndarray, int], similarity: float) -> np.ndarray:
    """The rarest of a sorted set's shingles, of which sets of that similarity share shared_least or more.

    Similar sets share `similarity` of the larger one; in one order for all sets, those shared ones that
    come first are no further back than the shingles not shared, and so in the prefixes of both.
    """
    n, (table, shift) = len(found), common
    rarity = table[found >> np.uint64(shift)] if len(table) else np.zeros(n, np.uint8)
    most = min(n, n - math.ceil(similarity * n - 1e-9) + shared_least(n))
    return found[np.lexsort((found, rarity))[:most]]


def signatures(docs: DataFrame, feature_words: int, words: int, similarity: float, id_column: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, hash of the text, fingerprint, digest and size of the shingle set, prefix) of each row."""
    held = docs.sparkSession.sparkContext.broadcast(common_shingles(docs, words, id_column, text))
    docs = docs.select(F.col(id_column).alias("id"), F.xxhash64(text).alias("h"), F.col(text).alias("text"))
    schema = with_fields(docs.select("id", "h"), {"fingerprint": "long", "digest": "long", "size": "int", "prefix": "array<long>"})

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches, "text"):
            prints, digests, sizes, prefixes = [], [], [], [np.empty(0, np.uint64)]
            for t in bytes_of(batch, "text"):
                shingles, features = run_hashes(t, words, feature_words)
                found = np.unique(shingles)
                prints.append(fingerprint(features))
                digests.append(xxhash.xxh3_64_intdigest(found.tobytes()))
                sizes.append(len(found))
                prefixes.append(prefix(found, held.value, similarity))
            ends = np.cumsum([len(p) for p in prefixes])
            arrays = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(prefixes).view(np.int64)))
            digest = pa.array(np.array(digests, np.uint64).view(np.int64))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(prints, pa.int64()), digest, pa.array(sizes, pa.int32()), arrays], schema.names)

    return docs.mapInArrow(sign, schema)


def similar_links(signed: DataFrame, of: DataFrame, similarity: float) -> DataFrame:
    """(a, b): links among the components `of` fingerprints, so that all sets of that similarity are linked.

    Sets that share enough prefix shingles are linked without a look at the rest of them: links make candidates.
    """
    light = signed.where("id IS NOT NULL").select("id", "fingerprint", "digest").join(of, "fingerprint")
    light = written(light.select("id", "digest", F.col("component_id").alias("component")), "light")
    first = light.groupBy("digest").agg(F.min("id").alias("id"), F.min("component").alias("component"))
    same = light.join(first.select("digest", F.col("component").alias("b")), "digest").where("component <> b").select(F.col("component").alias("a"), "b")
    sets = signed.where("size > 0").select("id", "digest", "size", "prefix").join(first.hint("merge"), ["id", "digest"])
    keyed = sets.select(F.explode("prefix").alias("key"), F.col("component").alias("c"), "id", "size")
    sort = keyed.repartition("key").sortWithinPartitions("key", "size")

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest = None
        for batch in batches:
            now = [c.to_numpy() for c in batch.columns]
            rest = now if rest is None else [np.concatenate(x) for x in zip(rest, now)]
            if len(rest[0]) and rest[0][0] != rest[0][-1]:
                done = int(np.searchsorted(rest[0], rest[0][-1]))  # the last bucket may go on in the next batch
                yield from bucketed(*(x[:done] for x in rest))
                rest = [x[done:] for x in rest]
        if rest is not None:
            yield from bucketed(*rest)

    def bucketed(keys: np.ndarray, c: np.ndarray, ids: np.ndarray, sizes: np.ndarray) -> Iterator[pa.RecordBatch]:
        if len(keys) < 2:
            return
        starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
        rows = np.diff(np.concatenate((starts, [len(keys)])))
        few = np.repeat(rows <= PAIRED, rows)
        for d in range(1, min(PAIRED, int(rows.max()))):
            # rows come by size; of a large bucket neighbours are linked, which links all within a reach of sizes
            i = np.flatnonzero((keys[d:] == keys[:-d]) & (c[d:] != c[:-d]) & (sizes[:-d] >= similarity * sizes[d:] - 1e-9) & (few[d:] | (d == 1)))
            if len(i):
                swap = ids[i] > ids[i + d]
                x, y = np.where(swap, i + d, i), np.where(swap, i, i + d)
                need = np.where(few[i], shared_least(sizes[i]), 0)
                yield pa.RecordBatch.from_arrays([pa.array(ids[x]), pa.array(ids[y]), pa.array(c[x]), pa.array(c[y]), pa.array(need.astype(np.int64))], ["x", "y", "a", "b", "need"])

    met = sort.mapInArrow(meet, "x long, y long, a long, b long, need long")
    near = met.groupBy("x", "y", "a", "b").agg(F.count("*").alias("n"), F.min("need").alias("need")).where("n >= need").select("a", "b")
    return same.unionByName(near).distinct()


#: Bits of a table of keys for each of them, and at most.
MARKS, MOST_MARKS = 8, 1 << 28


def marks(rows: DataFrame, key: Column) -> np.ndarray:
    """A table with a bit set for each key, at the key's first bits."""
    bits = max(3, min((MARKS * rows.count()).bit_length(), MOST_MARKS.bit_length() - 1))
    cells = rows.select(F.shiftrightunsigned(key, 64 - bits).cast("int").alias("cell")).distinct().toArrow().column("cell").to_numpy()
    found = np.zeros(1 << bits - 3, np.uint8)
    np.bitwise_or.at(found, cells >> 3, np.left_shift(1, cells & 7).astype(np.uint8))
    return found


def marked(docs: DataFrame, key: Column, held: Broadcast, wanted: bool) -> DataFrame:
    """The rows whose key has its bit set in a table of marks, all keys of the table among them; wanted False: the others."""
    name = "__key"

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = held.value
        shift = np.uint64(61 - (len(table).bit_length() - 1))
        for batch in batches:
            cells = batch.column(batch.num_columns - 1).to_numpy().view(np.uint64) >> shift
            found = (table[cells >> np.uint64(3)] >> (cells & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
            yield batch.select(range(batch.num_columns - 1)).filter(pa.array(found == wanted))

    return docs.withColumn(name, key).mapInArrow(choose, docs.schema)


#: Shingles of a component's documents that meet in one place; a larger component meets in several, two parts of about so many in each.
MEETING = 1 << 20


def first_copies(docs: DataFrame, words: int = 5, similarity: float = 0.8, feature_words: int = 2, radius: int = 7, id_column: str = "doc_id", text: str = "text", meeting: int = MEETING) -> DataFrame:
    """docs with one document of each group of near copies.

    Linked are documents whose sets of runs of `words` words have a Jaccard similarity of at least `similarity`; a group is
    what links connect, and its least id stays. Candidates are the components of SimHash links (fingerprints over
    runs of feature_words words, up to `radius` differing bits) and of links among documents that share their
    rarest shingles, which all similar ones do whatever their fingerprints. Equal sets are one document. A
    component of more than `meeting` shingles meets in parts, every two of them in one place, so that all its pairs are compared at any size.
    Equal texts are similar, texts without words (null, empty) too; of repeated rows one stays, and of rows with one id but
    different texts each is judged; rows with a null id all stay. Texts are compared whole; an empty
    table gives no rows; further columns stay as they are, whatever their names.
    """
    signed = written(signatures(docs, feature_words, words, similarity, id_column, text), "signatures")
    grouped = written(groups(signed, radius, "id"), "groups")
    further = components(similar_links(signed, grouped, similarity)).select(F.col("node").alias("component_id"), "root")
    near = grouped.join(further, "component_id", "left").select("fingerprint", F.coalesce("root", "component_id").alias("component"))
    of = written(signed.where("id IS NOT NULL").select("id", "h", "digest", "size", "fingerprint").join(near, "fingerprint").drop("fingerprint"), "components")
    first = of.groupBy("digest").agg(F.min(F.struct("id", "h")).alias("first"))
    rows = of.join(first.hint("merge"), "digest").select("id", "h", "size", "component", (F.struct("id", "h") == F.col("first")).alias("stays"))
    total = rows.where("stays").groupBy("component").agg(F.count("*").alias("n"), F.sum("size").alias("total"))
    rows = rows.distinct().join(total.hint("merge"), "component").where("NOT stays OR n > 1")
    parts = F.least(F.floor(F.col("total") / meeting) + 1, "n").cast("int")
    roles = written(rows.select(F.col("id").alias("__id"), F.col("h").alias("__h"), "stays", F.col("component").alias("__component"), parts.alias("__parts")).withColumnsRenamed({"stays": "__stays"}), "roles")
    # documents that surely have no role stay where they are; for others by a merge at every size: what is shuffled then grows with the input, and the size of roles needn't be known
    held = docs.sparkSession.sparkContext.broadcast(marks(roles, F.xxhash64("__id", "__h")))
    key = F.xxhash64(F.col(id_column), F.xxhash64(text))
    on = (F.col(id_column) == F.col("__id")) & (F.xxhash64(text) == F.col("__h"))
    dealt = written(marked(docs, key, held, True).join(roles.hint("merge"), on, "left").where("coalesce(__stays, true)").drop("__id", "__stays"), "dealt")
    discard(signed, grouped, of, roles)
    schema = with_fields(dealt, {"__part": "int"})

    def groups_of(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[list[tuple[pa.RecordBatch, int]], np.ndarray]]:
        """The rows of each component and part, and for each row the first of its group."""
        now, sets, held = None, [], []
        for batch in batches:
            component, part = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("__component", "__part"))
            for i, (key, t) in enumerate(zip(zip(component, part), bytes_of(batch, text))):
                if key != now:
                    yield held, tied(sets, similarity)
                    now, sets, held = key, [], []
                sets.append(shingle_set(t, words))
                held.append((batch, i))
        yield held, tied(sets, similarity)

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, first in groups_of(batches):
            for _, run in groupby((held[k] for k in np.unique(first).tolist()), lambda x: id(x[0])):
                run = list(run)
                yield run[0][0].take(pa.array([i for _, i in run], pa.int64()))

    def link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for held, first in groups_of(batches):
            if len(later := np.flatnonzero(first != np.arange(len(first)))):
                columns = []
                for ends in (first[later], later):
                    for c in (id_column, "__h"):
                        columns.append(pa.concat_arrays([held[k][0].column(held[k][0].schema.get_field_index(c)).slice(held[k][1], 1) for k in ends.tolist()]))
                yield pa.RecordBatch.from_arrays(columns, linked.names)

    def dealt_out(rows: DataFrame, part: Column) -> DataFrame:
        rows = rows.withColumn("__part", part.cast("int")).repartition("__component", "__part")
        return rows.sortWithinPartitions("__component", "__part", id_column, "__h")

    node = F.struct(F.col(id_column).alias("id"), F.col("__h").alias("h"))
    alone = marked(docs, key, held, False).unionByName(dealt.where("__component IS NULL").select(*docs.columns))
    small = dealt_out(dealt.where("__parts = 1"), F.lit(0)).mapInArrow(keep, schema)
    # every two parts of a large component meet, and so all its pairs, whatever else is in it
    large = dealt.where("__parts > 1")
    mine = F.pmod(F.xxhash64("__h", id_column), F.col("__parts")).cast("int")
    others = F.filter(F.sequence(F.lit(0), F.col("__parts") - 1), lambda k: k != mine)
    pair = F.explode(F.transform(others, lambda k: F.least(k, mine) * F.col("__parts") + F.greatest(k, mine)))
    meets = dealt_out(large.select(F.col(id_column), F.col(text), "__h", "__component", pair.alias("__pair")), F.col("__pair")).drop("__pair")
    linked = StructType([StructField(name, meets.schema[c].dataType) for name, c in (("a", id_column), ("ah", "__h"), ("b", id_column), ("bh", "__h"))])
    links_met = meets.mapInArrow(link, linked).select(F.struct(F.col("a").alias("id"), F.col("ah").alias("h")).alias("a"), F.struct(F.col("b").alias("id"), F.col("bh").alias("h")).alias("b"))
    later = components(links_met).where("node <> root").select(F.col("node").alias("__node"))
    firsts = large.withColumn("__at", node).join(later.hint("merge"), F.col("__at") == F.col("__node"), "left_anti").drop("__at")
    # of repeated rows one stays
    once = dealt_out(firsts, F.hash("__h", id_column)).mapInArrow(keep, schema)
    return alone.unionByName(small.select(*docs.columns)).unionByName(once.select(*docs.columns))
