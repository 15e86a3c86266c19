"""Language-model scoring by prediction by partial matching over bytes.

A trie of byte contexts of up to ORDER bytes is counted over all training texts.
A byte is coded in the longest known context; a byte that is new there costs an
escape (method C: distinct successors over total and distinct), after which the
next shorter context codes it with the symbols of the longer one excluded. The
code length of a document is the sum over its bytes and its end.

Counts are gathered from the whole corpus in one aggregation, and every gram of
it takes part. A byte's probability follows from its gram (context and byte)
alone: those of the `HEAVY_GRAMS` commonest are looked up where the text is
read; the others are coded in tries that each hold all grams whose contexts end
in the same two bytes, and meet their texts in a join. Base scores use exact
counts of every token in the same way, with the `HEAVY` commonest looked up.

Texts are coded with A-Z in lower case and one space between tokens. A null text
is empty: its end is coded alone. Repeated rows each get their result. With no
training text all bytes are equally likely. An empty table gives no rows. Other
columns, whatever their names, are not read.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterable, Iterator
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import materialize

ORDER = 5
#: Grams and tokens whose values the workers hold; the rest is met by joins.
HEAVY_GRAMS = 600_000
HEAVY = 1 << 17
#: Tokens and grams that a task holds before it sends partial counts on.
_HELD = 250_000
_HELD_GRAMS = 1_500_000
#: Bytes that are counted or scored at a time.
_BLOCK = 1 << 20
#: Byte values that UTF-8 never has: before a text, and at its end.
START, END = 0xFE, 0xFF
ALPHABET = 256
_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_STRIDE = 1 << 33
_SPACES = (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")


def tokens_of(text: str | None) -> list[bytes]:
    return text.encode().lower().split() if text else []


Unit = tuple[int, list[bytes], bytes, bytes]  # which text, its tokens, the bytes before, and the bytes to code


def _segments(text: str | None) -> Iterator[list[bytes]]:
    """The tokens of a text, of at most about _BLOCK bytes at a time: one list for all but very long texts."""
    raw = text.encode().lower() if text else b""
    at = 0
    while len(raw) - at > _BLOCK:
        end = max(raw.rfind(space, at, at + _BLOCK) for space in _SPACES)
        if end <= at:
            later = [x for x in (raw.find(space, at + _BLOCK) for space in _SPACES) if x >= 0]
            end = min(later, default=len(raw))
        yield raw[at:end].split()
        at = end
    yield raw[at:].split()


def _units(texts: Iterable[str | None], order: int) -> Iterator[Unit]:
    """What is coded of each text, in order: its tokens with one space between, and its end."""
    for i, text in enumerate(texts):
        before, body, tokens, begun = bytes([START]) * order, b"", [], False
        for words in _segments(text):
            if body or tokens:
                yield i, tokens, before, body
                before = (before + body)[-order:] if order else b""
            tokens, body = words, (b" " if begun and words else b"") + b" ".join(words)
            begun |= bool(words)
        yield i, tokens, before, body + bytes([END])


def _groups(units: Iterable[Unit]) -> Iterator[list[Unit]]:
    """Units of about _BLOCK bytes together."""
    held, size = [], 0
    for unit in units:
        held.append(unit)
        size += len(unit[3])
        if size >= _BLOCK:
            yield held
            held, size = [], 0
    if held:
        yield held


def _keys(units: list[tuple[bytes, bytes]], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of every coded byte of (bytes before, bytes to code): context then byte, packed; and where each unit's begin."""
    raw = np.frombuffer(b"".join(x for unit in units for x in unit), np.uint8)
    key = np.zeros(len(raw) - order, np.uint64)
    for i in range(order + 1):
        key <<= np.uint64(8)
        key |= raw[i : len(raw) - order + i]
    lengths = np.fromiter((len(body) for _, body in units), np.int64, len(units))
    ends = np.cumsum(lengths + order)
    coded = np.ones(len(key), bool)
    for i in range(order):  # windows that begin in one unit and end in what comes before the next
        coded[(ends[:-1] - order + i)] = False
    return key[coded], np.concatenate([[0], np.cumsum(lengths)[:-1]])


def _grams(parts: list[bytes], order: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys of every coded byte of whole normalized texts, and where each text's begin."""
    return _keys([(bytes([START]) * order, p + bytes([END])) for p in parts], order)


def _blocks(texts: Iterator[tuple[object, str | None]]) -> Iterator[list[tuple[object, str | None]]]:
    """Rows whose texts have about _BLOCK characters together, or one longer."""
    held, size = [], 0
    for item in texts:
        held.append(item)
        size += len(item[1] or "") + 1
        if size >= _BLOCK:
            yield held
            held, size = [], 0
    if held:
        yield held


def _count(batches: Iterator[pa.RecordBatch], order: int) -> Iterator[pa.RecordBatch]:
    """Partial counts of tokens (the empty one ends a text) and of grams."""
    tokens: Counter[bytes] = Counter()
    keys, counts, held = [], [], 0

    def sent(names: list, grams: np.ndarray | None, n: list | np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(names, pa.binary()), pa.nulls(len(n), pa.int64()) if grams is None else pa.array(grams.view(np.int64)), pa.array(n, pa.int64())], names=["token", "gram", "n"])

    def merged() -> tuple[np.ndarray, np.ndarray]:
        every, n = np.concatenate(keys), np.concatenate(counts)
        at = np.argsort(every, kind="stable")
        every, n = every[at], n[at]
        first = np.nonzero(np.concatenate([[True], every[1:] != every[:-1]]))[0]
        return every[first], np.add.reduceat(n, first)

    def read() -> Iterator[str | None]:
        for batch in batches:
            tokens[b""] += batch.num_rows
            yield from (t.as_py() for t in batch.column(0))

    for group in _groups(_units(read(), order)):
        for _, words, _, _ in group:
            tokens.update(words)
        key, n = np.unique(_keys([x[2:] for x in group], order)[0], return_counts=True)
        keys.append(key)
        counts.append(n)
        held += len(key)
        if held > _HELD_GRAMS:
            key, n = merged()
            keys, counts, held = [key], [n], len(key)
            if 2 * held > _HELD_GRAMS:
                yield sent([None] * len(key), key, n)
                keys, counts, held = [], [], 0
        if len(tokens) > _HELD:
            yield sent(list(tokens), None, list(tokens.values()))
            tokens.clear()
    if tokens:
        yield sent(list(tokens), None, list(tokens.values()))
    if keys:
        key, n = merged()
        yield sent([None] * len(key), key, n)


class Table:
    """Sorted keys with values, found through an open-addressing hash built on first use."""

    def __init__(self, keys: np.ndarray):
        self.keys = keys

    def __getstate__(self) -> dict:
        return {"keys": self.keys}

    @cached_property
    def slots(self) -> np.ndarray:
        bits = max(4, int(2 * len(self.keys)).bit_length())
        table, left, probe = np.full(1 << bits, -1, np.int32), np.arange(len(self.keys), dtype=np.int32), 0
        home = self._home(self.keys, bits)
        while len(left):
            at = (home[left] + probe) & ((1 << bits) - 1)
            free = table[at] < 0
            table[at[free]] = left[free]
            left = left[table[at] != left]
            probe += 1
        return table

    @staticmethod
    def _home(keys: np.ndarray, bits: int) -> np.ndarray:
        return ((keys * _MULTIPLIER) >> np.uint64(64 - bits)).astype(np.int64)

    def find(self, keys: np.ndarray) -> np.ndarray:
        """Index of each key, or -1."""
        out = np.full(len(keys), -1, np.int32)
        if not len(self.keys):
            return out
        slots = self.slots
        bits = len(slots).bit_length() - 1
        home, left, probe = self._home(keys, bits), None, 0
        while True:
            at = home if left is None else (home[left] + probe) & (len(slots) - 1)
            there = slots[at]
            wanted = keys if left is None else keys[left]
            hit = (there >= 0) & (self.keys[there] == wanted)
            if left is None:
                out[hit] = there[hit]
                left = np.nonzero((there >= 0) & ~hit)[0]
            else:
                out[left[hit]] = there[hit]
                left = left[(there >= 0) & ~hit]
            if not len(left):
                return out
            probe += 1


class Trie:
    """Log10 probabilities of bytes in contexts of 0 to `order` bytes."""

    def __init__(self, levels: list[tuple[np.ndarray, np.ndarray]]):
        """levels[k]: sorted keys of k context bytes and a byte, and their counts."""
        self.order = len(levels) - 1
        self.grams, self.contexts, self.top, self.count, self.escape, self.rest, self.rest_escape = [], [], [], [], [], [], []
        before = None
        for k, (keys, n) in enumerate(levels):
            context = keys >> np.uint64(8)
            first = np.nonzero(np.concatenate([[True], context[1:] != context[:-1]]))[0] if len(keys) else np.empty(0, np.int64)
            distinct = np.diff(np.append(first, len(keys)))
            total = np.add.reduceat(n, first) if len(keys) else n
            which = np.repeat(np.arange(len(first)), distinct)
            self.grams.append(Table(keys))
            self.contexts.append(Table(context[first]))
            self.top.append(np.log10(n / (total + distinct)[which]).astype(np.float32))
            self.count.append(np.log10(n).astype(np.float32))
            self.escape.append(np.log10(distinct / (total + distinct)).astype(np.float32))
            if k and len(keys):
                low_keys, low_n, low_context, low_total, low_distinct = before
                suffix = keys & np.uint64((1 << 8 * k) - 1)
                excluded = np.add.reduceat(low_n[np.searchsorted(low_keys, suffix)], first)
                parent = np.searchsorted(low_context, context[first] & np.uint64((1 << 8 * (k - 1)) - 1))
                new = low_distinct[parent] - distinct
                mass = low_total[parent] - excluded + new
                self.rest.append(np.log10(np.maximum(mass, 1)).astype(np.float32))
                self.rest_escape.append(np.where(new > 0, np.log10(np.maximum(new, 1) / np.maximum(mass, 1)), 0.0).astype(np.float32))
            else:
                self.rest.append(np.empty(0))
                self.rest_escape.append(np.empty(0))
            before = keys, n, context[first], total, distinct
        self.seen = len(levels[0][0])

    def code(self, keys: np.ndarray) -> np.ndarray:
        """Log10 probability of each packed (context, byte)."""
        out = np.zeros(len(keys))
        left = np.arange(len(keys))
        came = np.full(len(keys), -1, np.int64)  # the context, one level up, that was escaped from
        for k in range(self.order, -1, -1):
            key = keys[left] & np.uint64((1 << 8 * (k + 1)) - 1)
            at = self.grams[k].find(key)
            hit, fresh = at >= 0, came < 0
            direct, lowered = hit & fresh, hit & ~fresh
            out[left[direct]] += self.top[k][at[direct]]
            if lowered.any():
                out[left[lowered]] += self.count[k][at[lowered]] - self.rest[k + 1][came[lowered]]
            left, key, came, fresh = left[~hit], key[~hit], came[~hit], fresh[~hit]
            if not len(left):
                return out
            context = self.contexts[k].find(key >> np.uint64(8)).astype(np.int64)
            begun = fresh & (context >= 0)
            out[left[begun]] += self.escape[k][context[begun]]
            out[left[~fresh]] += self.rest_escape[k + 1][came[~fresh]] if k < self.order else 0.0
            came = context
        out[left] -= math.log10(max(ALPHABET - self.seen, 1))
        return out

    def score(self, texts: list[list[bytes]]) -> np.ndarray:
        """Log10 probability of each tokenized text."""
        keys, starts = _grams([b" ".join(t) for t in texts], self.order)
        return np.add.reduceat(self.code(keys), starts)


def _bucket(n: str) -> Column:
    return F.floor(8 * F.log2(F.col(n).cast("double")))


def _threshold(df: DataFrame, cap: int) -> int:
    """The least bucket of counts `n` from which on there are at most `cap` rows; 0 if that is all."""
    sizes = {r["b"]: r["rows"] for r in df.groupBy(_bucket("n").alias("b")).agg(F.count("*").alias("rows")).collect()}  # at most 8 * 64 rows
    kept, least = 0, max(sizes, default=0) + 1
    for b in sorted(sizes, reverse=True):
        kept += sizes[b]
        if kept > cap:
            break
        least = b
    return 0 if kept <= cap else least


def count_corpus(docs: DataFrame, text_col: str = "text", order: int = ORDER) -> tuple[DataFrame, DataFrame]:
    """(token, n) and (gram, n) over all rows; the empty token counts texts."""
    partial = docs.select(F.col(text_col).alias("text")).mapInArrow(lambda it: _count(it, order), "token binary, gram long, n long")
    counted = materialize(partial.groupBy("token", "gram").agg(F.sum("n").alias("n")), "ppm-counts")
    return counted.where("token is not null").select("token", "n"), counted.where("gram is not null").select("gram", "n")


def _level(keys: np.ndarray, n: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted keys of k context bytes and a byte, with their counts, from longer grams."""
    short, at = np.unique(keys & np.uint64((1 << 8 * (k + 1)) - 1), return_inverse=True)
    return short, np.bincount(at, n, len(short))


def _short_levels(grams: DataFrame, order: int) -> list[tuple[np.ndarray, np.ndarray]]:
    """Levels 0 and 1, at most 65,536 grams whatever the corpus."""
    table = grams.groupBy(F.col("gram").bitwiseAND(F.lit(0xFFFF)).alias("gram")).agg(F.sum("n").alias("n")).toArrow()
    keys, n = table.column("gram").to_numpy().view(np.uint64), table.column("n").to_numpy().astype(np.float64)
    return [_level(keys, n, k) for k in range(min(order, 1) + 1)]


def _code_part(batches: Iterator[pa.RecordBatch], order: int, short: list[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
    """Log10 probability of each gram without a count, from the counted ones: all whose contexts end in the same two bytes are here."""
    held = [(b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy(zero_copy_only=False)) for b in batches]
    if not held:
        return
    keys, n = (np.concatenate(x) for x in zip(*held, strict=True))
    del held
    counted = n > 0
    wanted = keys[~counted]
    if not len(wanted):
        return
    keys, n = keys[counted], n[counted].astype(np.float64)
    coded = Trie(short + [_level(keys, n, k) for k in range(len(short), order + 1)]).code(wanted)
    for i in range(0, len(wanted), _HELD):
        yield pa.RecordBatch.from_arrays([pa.array(wanted[i : i + _HELD].view(np.int64)), pa.array(coded[i : i + _HELD])], names=["gram", "coded"])


def code_grams(grams: DataFrame, wanted: DataFrame, order: int = ORDER) -> DataFrame:
    """(gram, coded): log10 probability of each distinct wanted gram under all counted ones."""
    short = _short_levels(grams, order)
    both = grams.select("gram", "n").unionByName(wanted.select("gram", F.lit(0).cast("long").alias("n")))
    ends = F.shiftrightunsigned("gram", 8).bitwiseAND(F.lit(0xFFFF))
    return both.repartition(ends).mapInArrow(lambda it: _code_part(it, order, short), "gram long, coded double")


def common_grams(grams: DataFrame, most: int = HEAVY_GRAMS) -> tuple[Table, np.ndarray]:
    """The commonest full-length grams and their log10 probabilities."""
    context = F.shiftrightunsigned("gram", 8)
    totals = grams.groupBy(context.alias("context")).agg((F.sum("n") + F.count("*")).alias("total"))
    common = grams.where(_bucket("n") >= _threshold(grams, most)).withColumn("context", context).join(totals, "context")
    table = common.select("gram", "n", "total").toArrow()
    keys, n, total = (table.column(c).to_numpy() for c in ("gram", "n", "total"))
    return Table(keys.view(np.uint64)), np.log10(n / total).astype(np.float32)


class Scorer:
    """What a worker needs: log10 probabilities of the common grams, and log10 of count + 1 of the heavy tokens."""

    def __init__(self, common: tuple[Table, np.ndarray], heavy: dict[bytes, float], order: int = ORDER):
        self.grams, self.coded = common
        self.heavy, self.order = heavy, order

    def code(self, group: list[Unit]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of each unit the sum over its common grams; its other grams, how often they occur, and how many each unit has."""
        keys, starts = _keys([x[2:] for x in group], self.order)
        at = self.grams.find(keys)
        missed = np.nonzero(at < 0)[0]
        each = self.coded[at].astype(np.float64) if len(self.coded) else np.zeros(len(keys))
        each[missed] = 0.0
        sums = np.add.reduceat(np.append(each, 0.0), starts)
        key, unit = keys[missed], np.searchsorted(starts, missed, "right") - 1
        by = np.lexsort((key, unit))
        key, unit = key[by], unit[by]
        first = np.nonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (unit[1:] != unit[:-1])]))[0] if len(key) else np.empty(0, np.int64)
        return sums, key[first], np.diff(np.append(first, len(key))), np.bincount(unit[first], minlength=len(group))

    def rows(self, block: list[tuple[object, str | None]], row: int, kind: pa.DataType) -> pa.RecordBatch:
        n, heavy = len(block), self.heavy.get
        length, known, rare_n = (np.zeros(n, np.int64) for _ in range(3))
        sums, scores, other_n = np.zeros(n), np.zeros(n), np.zeros(n, np.int64)
        rare, rare_times, keys, times = [], [], [], []
        for group in _groups(_units((t for _, t in block), self.order)):
            which = np.fromiter((x[0] for x in group), np.int64, len(group))
            part, key, count, per_unit = self.code(group)
            np.add.at(scores, which, part)
            np.add.at(other_n, which, per_unit)
            keys.append(key)
            times.append(count)
            for i, words, _, _ in group:
                k, s, before = 0, 0.0, len(rare)
                for w, m in Counter(words).items():
                    v = heavy(w)
                    if v is None:
                        rare.append(w)
                        rare_times.append(m)
                    else:
                        k += m
                        s += m * v
                length[i] += len(words)
                known[i] += k
                sums[i] += s
                rare_n[i] += len(rare) - before
        listed = lambda counts, names, *arrays: pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.StructArray.from_arrays(list(arrays), names=names))
        other = listed(other_n, ["gram", "n"], pa.array(np.concatenate(keys).view(np.int64)), pa.array(np.concatenate(times), pa.int64()))
        arrays = [
            pa.array([i for i, _ in block], kind), pa.array(np.arange(row, row + n)), pa.array(length + 1), pa.array(known), pa.array(sums), pa.array(scores),
            listed(rare_n, ["token", "n"], pa.array(rare, pa.binary()), pa.array(rare_times, pa.int64())), other,
        ]
        return pa.RecordBatch.from_arrays(arrays, names=["id", "row", "n_tokens", "known", "sums", "score", "rare", "other"])

    def run(self, batches: Iterator[pa.RecordBatch], kind: pa.DataType) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() * _STRIDE
        texts = ((i, t) for b in batches for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True))
        for block in _blocks(texts):
            yield self.rows(block, row, kind)
            row += len(block)


def score(docs: DataFrame, tokens: DataFrame, grams: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, n_tokens, n_known, train_tokens, base_score, score."""
    from pyspark.sql.pandas.types import to_arrow_type

    total = tokens.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    ends = tokens.where(F.octet_length("token") == 0).agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n")).first()["n"]
    common = tokens.where((_bucket("n") >= _threshold(tokens, HEAVY)) & (F.octet_length("token") > 0)).toArrow()
    heavy = {t: math.log10(n + 1) for t, n in zip(common.column("token").to_pylist(), common.column("n").to_pylist(), strict=True)}
    shared = docs.sparkSession.sparkContext.broadcast(Scorer(common_grams(grams), heavy))

    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType
    arrow = to_arrow_type(kind)
    fields = f"id {kind.simpleString()}, row long, n_tokens long, known long, sums double, score double, rare array<struct<token:binary,n:long>>, other array<struct<gram:long,n:long>>"
    scored = materialize(rows.mapInArrow(lambda it: shared.value.run(it, arrow), fields), "ppm-scores")
    rare = scored.select("row", F.explode("rare").alias("x")).select("row", F.col("x.token").alias("token"), F.col("x.n").alias("times"))
    met = rare.join(tokens, "token").groupBy("row").agg(F.sum("times").alias("rare_known"), F.sum(F.col("times") * F.log10(F.col("n").cast("double") + 1)).alias("rare_sums"))
    others = scored.select("row", F.explode("other").alias("x")).select("row", F.col("x.gram").alias("gram"), F.col("x.n").alias("times"))
    coded = others.join(code_grams(grams, others.select("gram").distinct()), "gram").groupBy("row").agg(F.sum(F.col("times") * F.col("coded")).alias("other_score"))
    denominator = math.log10(total["n"] + total["v"] + 1)
    base = F.col("sums") + F.coalesce("rare_sums", F.lit(0.0)) + F.lit(math.log10(ends + 1)) - F.col("n_tokens") * F.lit(denominator)
    known = F.col("known") + F.coalesce("rare_known", F.lit(0)) + F.lit(int(ends > 0))
    every = F.col("score") + F.coalesce("other_score", F.lit(0.0))
    return scored.drop("rare", "other").join(met, "row", "left").join(coded, "row", "left").select("id", "n_tokens", known.cast("long").alias("n_known"), F.lit(total["n"]).cast("long").alias("train_tokens"), base.alias("base_score"), every.alias("score"))


def op4_ppm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log10 probabilities of every document under the byte model and the token base."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(7)) == 2, F.lit(False))
    tokens, grams = count_corpus(docs.where(~held_out))
    out = score(docs, tokens, grams).withColumnRenamed("id", "doc_id")
    return out.select("doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")


QUERIES = {"op4_ppm": op4_ppm}
