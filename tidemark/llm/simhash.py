"""SimHash near-duplicates: vertical bit planes, carry-save counters, block-wise abandonment.

Fingerprints are 64-bit majority votes over the XXH64 (seed 42) of k-word
shingles. Candidate sets come from the pigeonhole rule: fingerprints within
`radius` bits agree on at least one combination of whole bit blocks. Inside a
candidate set all pairs are compared at once on bit planes stored vertically:
64 fingerprints share a machine word, one word per bit position, and saturating
carry-save counters add the differing bits of 64 pairs per instruction. Rows of
pairs are abandoned as soon as every lane has passed the radius.

Nulls and empty texts have no words: fingerprint zero, linked like any other.
Repeated rows and ties get equal fingerprints; a component takes its smallest
non-null id. Other columns of the input, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.components import connected_components
from tidemark.session import materialize

BITS = 64
RADIUS = 3
SHINGLE = 3
SEED = 42
#: A candidate set above this is split into sub-blocks that are compared pair by pair in separate tasks.
BUCKET = 2048
#: Small candidate sets are compared together until a block holds so many lanes.
LANES = 1024
#: Above so many fingerprints the candidate keys take 32 bits (20 tables) in place of 16 (4 tables).
WIDE_FROM = 1 << 26
_QUERIES = 256
_CHUNK = 1 << 16


def fingerprint(text: str | None, k: int = SHINGLE) -> int:
    """The unsigned fingerprint of one whole text."""
    words = text.encode().lower().split() if text else []
    if not words:
        return 0
    if len(words) < k:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*(words[i:] for i in range(k)), strict=False))
    digest, votes, n = xxhash.xxh64_intdigest, np.zeros(BITS, np.int64), 0
    hashes = np.fromiter((digest(g, SEED) for g in grams), np.uint64)
    for at in range(0, len(hashes), _CHUNK):
        part = hashes[at : at + _CHUNK]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        votes += bits.sum(axis=0, dtype=np.int64)
        n += len(part)
    return int(np.packbits(2 * votes > n, bitorder="little").view(np.uint64)[0])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch], k: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        marks = np.fromiter((fingerprint(t.as_py(), k) for t in batch.column(1)), np.uint64, batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(marks.view(np.int64))], names=["id", "fp"])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE) -> DataFrame:
    """(id, fp) for every row; fp is the fingerprint as a signed long."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(lambda it: _fingerprint_batches(it, k), f"id {kind}, fp long")


def bit_planes(marks: np.ndarray) -> np.ndarray:
    """(64, ceil(n / 64)) words: bit j of word w of plane b is bit b of mark 64 * w + j."""
    lanes = -len(marks) % BITS
    bits = np.unpackbits(np.ascontiguousarray(marks).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return np.packbits(np.pad(bits, ((0, lanes), (0, 0))).T.copy(), axis=1, bitorder="little").view(np.uint64)


def linked_pairs(marks: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Index pairs i < j of marks at most `radius` bits apart."""
    n, full = len(marks), np.uint64(0xFFFFFFFFFFFFFFFF)
    if n < 2:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    planes = bit_planes(marks)
    width = max(1, int(radius).bit_length())
    start = (1 << width) - 1 - radius  # so that the counters overflow just beyond the radius
    found_i, found_j = [], []
    column = np.arange(planes.shape[1] * BITS)
    for at in range(0, n, _QUERIES):
        rows = np.arange(at, min(at + _QUERIES, n))
        flips = (np.uint64(0) - ((marks[rows][:, None] >> np.arange(BITS, dtype=np.uint64)) & np.uint64(1))).astype(np.uint64)
        first = at // BITS
        here = planes[:, first:]
        lanes = column[first * BITS :]
        dead = np.packbits((lanes[None, :] <= rows[:, None]) | (lanes[None, :] >= n), axis=1, bitorder="little").view(np.uint64)
        counters = [np.full(dead.shape, full if start >> c & 1 else np.uint64(0), np.uint64) for c in range(width)]
        for b in range(BITS):
            carry = here[b][None, :] ^ flips[:, b][:, None]
            for c in counters:
                carried = c & carry
                c ^= carry
                carry = carried
            dead |= carry
            if b % 8 == 7 and b < BITS - 1:
                alive = (dead != full).any(axis=1)
                if not alive.any():
                    break
                if 2 * alive.sum() <= len(alive):
                    rows, flips, dead, counters = rows[alive], flips[alive], dead[alive], [c[alive] for c in counters]
        else:
            hit = np.unpackbits(np.ascontiguousarray(~dead).view(np.uint8), axis=1, bitorder="little")
            i, j = np.nonzero(hit)
            found_i.append(rows[i])
            found_j.append(lanes[j])
    if not found_i:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    return np.concatenate(found_i), np.concatenate(found_j)


def spanning_links(marks: np.ndarray, radius: int = RADIUS) -> tuple[np.ndarray, np.ndarray]:
    """Links that join each linked set of `marks` to its first member: fewer than len(marks)."""
    i, j = linked_pairs(marks, radius)
    label = np.arange(len(marks))
    while len(i):
        least = np.minimum(label[i], label[j])
        after = label.copy()
        np.minimum.at(after, i, least)
        np.minimum.at(after, j, least)
        np.minimum.at(after, label[i], least)
        np.minimum.at(after, label[j], least)
        after = after[after]
        if (after == label).all():
            break
        label = after
    moved = np.nonzero(label != np.arange(len(marks)))[0]
    return marks[label[moved]], marks[moved]


def _compare_blocks(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    """Batches sorted by unit: whole units join a block until it is full; memory is one block."""

    def links(parts: list[np.ndarray]) -> pa.RecordBatch:
        u, v = spanning_links(np.unique(np.concatenate(parts)).astype(np.uint64), radius)
        return pa.RecordBatch.from_arrays([pa.array(u.view(np.int64)), pa.array(v.view(np.int64))], names=["u", "v"])

    block, size, last = [], 0, None
    for batch in batches:
        unit = batch.column(0).to_numpy(zero_copy_only=False)
        marks = batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64)
        cuts = [0, *(np.nonzero(unit[1:] != unit[:-1])[0] + 1).tolist(), len(unit)]
        for a, b in zip(cuts, cuts[1:], strict=False):
            if a == b:
                continue
            if size >= LANES and unit[a] != last:
                yield links(block)
                block, size = [], 0
            block.append(marks[a:b])
            size += b - a
            last = unit[a]
    if block:
        yield links(block)


def _key_columns(wide: bool) -> list:
    """One key per table. Narrow: each of 4 blocks of 16 bits. Wide: each 3 of 6 blocks of about 11 bits."""
    blocks = 6 if wide else RADIUS + 1
    edges = [round(i * BITS / blocks) for i in range(blocks + 1)]
    masks = [((1 << hi) - 1) ^ ((1 << lo) - 1) for lo, hi in zip(edges, edges[1:], strict=False)]
    keys = []
    for chosen in combinations(range(blocks), blocks - RADIUS):
        mask = sum(masks[i] for i in chosen)
        keys.append(F.col("fp").bitwiseAND(F.lit(mask - (1 << 64) if mask >> 63 else mask)))
    return keys


def fingerprint_links(marks: DataFrame, radius: int = RADIUS, bucket: int = BUCKET, wide: bool | None = None) -> DataFrame:
    """Links (u, v) of distinct fingerprints `fp` that connect all within `radius`; a spanning set for each block.

    Every pair within the radius lands in one block at least and is linked
    there, directly or through others. A candidate set of more than `bucket`
    fingerprints is dealt by hash into sub-blocks, and each pair of sub-blocks
    is a unit of its own, so no task holds more than about two of them.
    """
    if radius > RADIUS:
        raise ValueError(f"candidate keys are exact up to {RADIUS} bits")
    if wide is None:
        wide = marks.count() > WIDE_FROM
    keyed = marks.select("fp", F.posexplode(F.array(*_key_columns(wide))).alias("t", "key"))
    hot = keyed.groupBy("t", "key").agg(F.count("*").alias("n")).where(F.col("n") > bucket).select("t", "key", F.ceil(F.col("n") / bucket).cast("int").alias("parts"))
    own = F.pmod(F.xxhash64("fp", "t"), F.col("parts")).cast("int")
    units = (
        keyed.join(hot, ["t", "key"], "left")
        .withColumn("own", F.coalesce(own, F.lit(0)))
        .withColumn("other", F.explode(F.when(F.col("parts").isNull(), F.array(F.lit(0))).otherwise(F.filter(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1), lambda j: j != F.col("own")))))
        .select(F.xxhash64("t", "key", F.least("own", "other"), F.greatest("own", "other")).alias("unit"), "fp")
    )
    return units.repartition("unit").sortWithinPartitions("unit").mapInArrow(lambda it: _compare_blocks(it, radius), "u long, v long").distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = SHINGLE, radius: int = RADIUS) -> DataFrame:
    """(id, fp, group, component) for every row: component is the smallest id reachable over links, its own included.

    group is one fingerprint of the component, which tells components apart even where ids repeat.

    Copies share one fingerprint and are compared once; membership returns by a
    join on the fingerprint, of which Spark splits skewed partitions.
    """
    rows = materialize(fingerprints(docs, id_col, text_col, k), "simhash")
    marks = materialize(rows.groupBy("fp").agg(F.min("id").alias("least"), F.count("*").alias("copies")), "simhash-marks")
    parts = connected_components(fingerprint_links(marks.select("fp"), radius))
    classes = marks.join(parts.withColumnRenamed("node", "fp"), "fp", "left").withColumn("group", F.coalesce("component", "fp"))
    least = classes.groupBy("group").agg(F.min("least").alias("component"))
    member = materialize(classes.select("fp", "group").join(least, "group").select("fp", "group", "component"), "simhash-classes")
    return rows.join(member, "fp").select("id", "fp", "group", "component")


def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = near_duplicates(docs)
    return out.select(F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("component").alias("component_id"))


QUERIES = {"op7_simhash": op7_simhash}


def brute_components(marks: Iterable[int], radius: int = RADIUS) -> list[int]:
    """Reference for tests: the index of the first member reachable from each mark."""
    marks = list(marks)
    root = list(range(len(marks)))

    def find(x: int) -> int:
        while root[x] != x:
            x = root[x]
        return x

    for i, j in combinations(range(len(marks)), 2):
        if (marks[i] ^ marks[j]).bit_count() <= radius:
            a, b = sorted((find(i), find(j)))
            root[b] = a
    return [find(i) for i in range(len(marks))]
