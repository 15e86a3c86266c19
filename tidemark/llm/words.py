"""Column expressions on words and word windows, shared by the native operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: What separates words of white space, as a Java pattern.
SPACE = r"[\x20\x09-\x0D]+"
#: What separates words of letters and digits (every character above ASCII counts as one).
NOT_ALNUM = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def ascii_lower(text: Column) -> Column:
    """A-Z in lower case and nothing else; pure ASCII, the common case, takes the fast path."""
    return F.when(F.length(text) == F.octet_length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))


def split_words(text: Column, separator: str = SPACE) -> Column:
    """The words of a text; a null text has none."""
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), separator), "")


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once.

    A column that lambdas read may be replaced by its expression when the
    optimizer merges projections or pushes a filter down; as a lambda variable
    it stays one value for all elements.
    """
    return F.get(F.transform(F.array(value), body), 0)


def scan(values: Column, op: Callable[[Column, Column], Column]) -> Column:
    """Every prefix of an array combined by an associative `op`: log2(n) passes of doubling strides.

    An aggregate that appends to an array copies it at each step; here no step depends on more than one pass.
    """

    def doubled(a: Column, k: Column) -> Column:
        stride = F.pow(F.lit(2.0), k).cast("int")
        return F.transform(a, lambda x, i: F.when(i >= stride, op(F.get(a, i - stride), x)).otherwise(x))

    rounds = lambda v: F.sequence(F.lit(0), F.ceil(F.log2(F.size(v).cast("double"))).cast("int") - 1)
    return let(values, lambda v: F.when(F.size(v) > 1, F.aggregate(rounds(v), v, doubled)).otherwise(v))


def window_hashes(words: Column, k: int) -> Column:
    """The hash of every k consecutive words, in order."""
    none = F.array().cast("array<bigint>")
    hashed = lambda w: F.transform(F.sequence(F.lit(0), F.size(w) - k), lambda i: F.xxhash64(*[F.get(w, i + j) for j in range(k)]))
    return let(words, lambda w: F.when(F.size(w) >= k, hashed(w)).otherwise(none))


def sliding_min(values: Column, width: int) -> Column:
    """The least of every `width` consecutive values."""
    none = F.array().cast("array<bigint>")
    least = lambda v: F.transform(F.sequence(F.lit(1), F.size(v) - width + 1), lambda i: F.array_min(F.slice(v, i, width)))
    return let(values, lambda v: F.when(F.size(v) >= width, least(v)).otherwise(none))


#: DuckDB: one row `tbl` with the CRC-32 of every byte.
CRC_TABLE_SQL = "SELECT list(v ORDER BY i) AS tbl FROM (SELECT i, list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) t(i))"


def crc32_sql(text: str) -> str:
    """DuckDB: the unsigned CRC-32 of a text's UTF-8, beside a row of CRC_TABLE_SQL."""
    byte = f"list_transform(range(0, strlen({text})::BIGINT), lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT)"
    return f"(4294967295 - list_reduce([4294967295::BIGINT] || {byte}, lambda c, b: xor(c >> 8, tbl[(xor(c, b) & 255) + 1])))"
