"""Importance resampling of documents towards a target's distribution of hashed word features.

Features are runs of 1 to `max_n` consecutive words, repeats counted, hashed by
CRC-32 into buckets. A bucket's gain is the log ratio of its smoothed shares in
target and source; a document weighs the sum of its features' gains, gets a
Gumbel noise that depends only on its id, and the highest scores are drawn:
sampling without replacement in proportion to the exponential weights.

Hashing is a byte automaton over the Arrow buffer of a whole batch. A lookup
table gives each byte its class, differences of the classes are the ends of the
words, and one step of the table-driven CRC is taken for all words at once, byte
after byte. Buffers are walked in blocks that end between words, so memory is a
block's whatever a text's length.

Nothing is shuffled but one count for each bucket and task and, for the draw, one
row of numbers for each document that is ranked. Ranks are positions within ranges of
scores plus the sizes of the ranges before, so no task sees all documents.

A null or empty text has no words and weighs 0. Repeated rows are documents of their own with
equal scores and neighbouring ranks; a null id has the noise of an empty one and
comes first among ties. Empty tables give no rows; an empty target has shares of the smoothing
alone. Other columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from tidemark.llm.words import CRC_TABLE_SQL, crc32_sql
from tidemark.session import materialize

BUCKETS = 10_000
MIN_WORDS = 20
PERCENT = 10
SEED = 2024
#: Bytes that are walked together.
BLOCK = 1 << 22
#: Steps that all words take together; what is longer is finished word by word.
STEPS = 64
#: Documents in a range of scores that is ranked by one task.
RANGE_ROWS = 1_000_000


@cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(whether a byte is of a word, its lower case, the CRC of each byte)."""
    code = np.arange(256)
    upper = (code >= ord("A")) & (code <= ord("Z"))
    lower = np.where(upper, code + 32, code).astype(np.uint8)
    word = (code >= 128) | ((code >= ord("0")) & (code <= ord("9"))) | ((lower >= ord("a")) & (lower <= ord("z")))
    crc = code.astype(np.uint32)
    for _ in range(8):
        crc = np.where(crc & 1, np.uint32(0xEDB88320) ^ (crc >> 1), crc >> 1).astype(np.uint32)
    return word, lower, crc


def advance(state: np.ndarray, data: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """CRC registers after `lengths` bytes of `data` from `starts`, all at once; long runs are finished one by one."""
    table = _tables()[2]
    order = np.argsort(-lengths, kind="stable")
    at, left, crc = starts[order], lengths[order], state[order]
    upto = np.searchsorted(-left, -np.arange(1, STEPS + 1), "right")  # words of at least so many bytes
    for step, n in enumerate(upto):
        if not n:
            break
        crc[:n] = table[(crc[:n] ^ data[at[:n] + step]) & 255] ^ (crc[:n] >> 8)
    for i in range(np.searchsorted(-left, -STEPS, "left")):
        crc[i] = zlib.crc32(data[at[i] + STEPS : at[i] + left[i]], int(crc[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
    out = np.empty_like(crc)
    out[order] = crc
    return out


def boundaries(data: np.ndarray, breaks: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words; none reaches over a position of `breaks`."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = _tables()[0][data]
    change = np.diff(inside)
    starts, ends = np.flatnonzero(change == 1), np.flatnonzero(change == -1)
    cut = breaks[(breaks > 0) & (breaks < len(data))]
    cut = np.unique(cut[(inside[cut] == 1) & (inside[cut + 1] == 1)])  # a word on both sides
    return np.sort(np.concatenate([starts, cut])), np.sort(np.concatenate([ends, cut]))


def _blocks(data: np.ndarray, breaks: np.ndarray, max_n: int, block: int) -> Iterator[tuple[np.ndarray, np.ndarray, int]]:
    """(starts, ends, words that an earlier block has counted) of stretches that end between words."""
    word, at, known = _tables()[0], 0, 0
    while at < len(data):
        end = min(at + block, len(data))
        if end < len(data) and word[data[end - 1]]:
            free = np.flatnonzero(~word[data[at:end]])
            if len(free):
                end = at + int(free[-1]) + 1
            while end < len(data) and word[data[end - 1]] and word[data[end]]:
                more = np.flatnonzero(~word[data[end : end + block]])
                end = end + int(more[0]) if len(more) else min(end + block, len(data))
        starts, ends = boundaries(data[at:end], breaks - at)
        if len(starts) > known or end == len(data):
            yield starts + at, ends + at, known
        if end == len(data):
            return
        keep = min(max_n - 1, len(starts))
        fresh = int(starts[-keep]) + at if keep else end
        block = block if fresh > at else 2 * block  # words to be kept fill the block
        at, known = fresh, keep


def features(column: pa.Array, max_n: int, buckets: int, block: int = BLOCK) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(row, whether a single word, bucket) of every feature of a batch's texts."""
    texts = pc.fill_null(column, "").cast(pa.large_string())
    _, offsets, values = texts.buffers()
    at = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    if at[0] == at[-1]:
        return
    data = _tables()[1][np.frombuffer(values, np.uint8)[at[0] : at[-1]]]
    rows = at[:-1] - at[0]
    space = np.array([32], np.uint8)
    for starts, ends, known in _blocks(data, rows, max_n, block):
        row = np.searchsorted(rows, starts, "right") - 1
        state = np.full(len(starts), 0xFFFFFFFF, np.uint32)
        for n in range(1, max_n + 1):
            m = len(starts) - n + 1
            if m <= 0:
                break
            if n > 1:
                state = advance(state[:m], space, np.zeros(m, np.int64), np.ones(m, np.int64))
            state = advance(state[:m], data, starts[n - 1 :], (ends - starts)[n - 1 :])
            good = (row[:m] == row[n - 1 :]) & (np.arange(m) + n - 1 >= known)
            yield row[:m][good], np.full(int(good.sum()), n == 1), ((state ^ np.uint32(0xFFFFFFFF)) % np.uint32(buckets)).astype(np.int64)[good]


def bucket_counts(df: DataFrame, text: str, max_n: int = 1, buckets: int = BUCKETS) -> DataFrame:
    """(bucket, n) over all texts; each task sends one row for each bucket at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, found in features(batch.column(0), max_n, buckets):
                total += np.bincount(found, minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(total[held], pa.int64())], names=["bucket", "n"])

    return df.select(text).mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(source: DataFrame, target: DataFrame, text: str = "text", max_n: int = 1, buckets: int = BUCKETS) -> list[int]:
    """The gain of every bucket: as many numbers as there are buckets, whatever the tables."""

    def dense(df: DataFrame) -> list[int]:
        out = [0] * buckets
        for r in bucket_counts(df, text, max_n, buckets).collect():
            out[r["bucket"]] = r["n"]
        return out

    s, t = dense(source), dense(target)
    above, below = float(sum(s) + buckets), float(sum(t) + buckets)
    return [math.floor(1000 * math.log((float(b + 1) * above) / (float(a + 1) * below))) for a, b in zip(s, t, strict=True)]


def weigh(docs: DataFrame, gain: list[int], id_col: str = "doc_id", text_col: str = "text", max_n: int = 1) -> DataFrame:
    """(id, n_words, n_features, weight) of every row."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    size, kind = len(gain), rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        value = np.array(gain, np.int64)
        for batch in batches:
            n = batch.num_rows
            words, every, weight = (np.zeros(n, np.int64) for _ in range(3))
            for row, single, bucket in features(batch.column(1), max_n, size):
                words += np.bincount(row[single], minlength=n)
                every += np.bincount(row, minlength=n)
                weight += np.bincount(row, weights=value[bucket], minlength=n).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x) for x in (words, every, weight))], names=["id", "n_words", "n_features", "weight"])

    return rows.mapInArrow(run, f"id {kind}, n_words long, n_features long, weight long")


def noise(id_col: Column, seed: int = SEED) -> Column:
    """Gumbel noise in thousandths from the hash of the seed and the id."""
    text = F.concat(F.lit(f"{seed}:"), F.coalesce(id_col.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(text, 256), 1, 8), 16, 10).cast("double")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296)))


def ranked(df: DataFrame, order: list[Column], n: int, rows: int | None = None) -> DataFrame:
    """df with `rank` 1, 2, 3... in that order, null beyond the n-th.

    Rows are dealt into ranges of the order, written, and numbered range by range; a range's first rank is
    the number of rows in those before it, one row for each range.
    """
    total = df.count() if rows is None else rows
    parts = max(1, -(-total // RANGE_ROWS), min(total // 1000, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))))
    dealt = materialize(df.repartitionByRange(parts, *order).withColumn("_range", F.spark_partition_id()), "ranges")
    sizes = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = sizes.select("_range", (F.sum("_n").over(W.orderBy("_range")) - F.col("_n")).alias("_before"))
    place = F.row_number().over(W.partitionBy("_range").orderBy(*order)).cast("long") + F.col("_before")
    return dealt.join(F.broadcast(before), "_range").withColumn("rank", place).withColumn("rank", F.when(F.col("rank") <= n, F.col("rank"))).drop("_range", "_before")


def resample(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_n: int = 1, buckets: int = BUCKETS, min_words: int = MIN_WORDS, percent: int = PERCENT, seed: int = SEED) -> DataFrame:
    """(id, n_words, n_features, weight, score, rank) of every row of docs; rank is null where a row is not drawn."""
    gain = gains(docs.select(F.col(text_col).alias("text")), target.select(F.col(text_col).alias("text")), "text", max_n, buckets)
    weighed = weigh(docs, gain, id_col, text_col, max_n).withColumn("score", F.col("weight") + noise(F.col("id"), seed))
    scored = materialize(weighed, "scored")
    able = F.col("n_words") >= min_words
    n = scored.where(able).count()
    order = [F.col("score").desc(), F.col("id").asc()]
    drawn = ranked(scored.where(able), order, percent * n // 100, n)
    return drawn.unionByName(scored.where(~able).withColumn("rank", F.lit(None).cast("long")))


def op12_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the documents, drawn towards the benchmark's distribution of words."""
    out = resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return out.select(F.col("id").alias("doc_id"), "n_features", "weight", "score", "rank")


QUERIES = {"op12_resampling": op12_resampling}

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

ORACLE_SQL = {
    "op12_resampling": f"""
WITH crc AS ({CRC_TABLE_SQL}),
dw AS (SELECT rowid_, doc_id, unnest(w) AS word FROM (SELECT row_number() OVER () AS rowid_, doc_id, {_WORDS} AS w FROM documents)),
bw AS (SELECT unnest({_WORDS}) AS word FROM benchmark),
dc AS (SELECT rowid_, any_value(doc_id) AS doc_id, word, count(*) AS n FROM dw GROUP BY rowid_, word),
v AS (SELECT word, {crc32_sql("word")} % {BUCKETS} AS bucket FROM (SELECT DISTINCT word FROM (SELECT word FROM dc UNION ALL SELECT word FROM bw)), crc),
s AS (SELECT bucket, sum(n) AS s FROM dc JOIN v USING (word) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM bw JOIN v USING (word) GROUP BY bucket),
g AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + {BUCKETS})::DOUBLE
    / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + {BUCKETS})::DOUBLE)))::BIGINT AS gain
  FROM (SELECT DISTINCT bucket FROM v) LEFT JOIN s USING (bucket) LEFT JOIN t USING (bucket)
),
w AS (SELECT rowid_, sum(n)::BIGINT AS n_features, sum(n * gain)::BIGINT AS weight FROM dc JOIN v USING (word) JOIN g USING (bucket) GROUP BY rowid_),
d AS (SELECT row_number() OVER () AS rowid_, doc_id FROM documents),
x AS (
  SELECT doc_id, coalesce(n_features, 0)::BIGINT AS n_features, coalesce(weight, 0)::BIGINT AS weight,
    coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln((('0x' || substr(sha256('{SEED}:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM d LEFT JOIN w USING (rowid_)
),
r AS (
  SELECT *, n_features >= {MIN_WORDS} AS able, row_number() OVER (PARTITION BY n_features >= {MIN_WORDS} ORDER BY score DESC, doc_id NULLS FIRST) AS place,
    count(*) OVER (PARTITION BY n_features >= {MIN_WORDS}) AS n
  FROM x
)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= {PERCENT} * n // 100 THEN place END AS rank FROM r
"""
}
