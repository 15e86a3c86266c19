"""Text functions as column expressions."""

from __future__ import annotations

import difflib
import hashlib

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

CHARS_PER_TOKEN = 4
NGRAM = 13
SHINGLE = 5


def normalize(text: Column) -> Column:
    """Lower case, punctuation to spaces, white space collapsed; letters of any script stay."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(text, r"[^\p{L}\p{N}_\s]", " "), r"\s+", " ")))


def words(text: Column) -> Column:
    return F.filter(F.split(text, " "), lambda w: w != "")


def ngrams(tokens: Column, n: int) -> Column:
    """Every n consecutive tokens joined by spaces; fewer tokens give one gram, none give none."""
    whole = F.array(F.array_join(tokens, " "))
    each = F.transform(F.sequence(F.lit(1), F.size(tokens) - n + 1), lambda i: F.array_join(F.slice(tokens, i, n), " "))
    return F.when(F.size(tokens) == 0, F.array().cast("array<string>")).when(F.size(tokens) < n, whole).otherwise(each)


def normal_words(text: Column) -> Column:
    """`words` of `normalize`, in one pass over the text."""
    return words(F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}_]+", " ")))


def gram_hashes(tokens: Column, n: int) -> Column:
    """64-bit hashes of the distinct grams of `ngrams`, sorted; far cheaper to make, ship and join than their text. Null tokens give none."""
    factors = np.random.default_rng(n).integers(0, 1 << 64, n + 1, np.uint64) | np.uint64(1)

    def grams(hashes: pa.Array) -> pa.Array:
        every, sizes = hashes.flatten().to_numpy().view(np.uint64), hashes.value_lengths().fill_null(0).to_numpy().astype(np.int64)
        ends = np.cumsum(sizes)
        left = np.repeat(ends, sizes) - np.arange(len(every))  # words from here on
        size = np.repeat(np.minimum(sizes, n), sizes)
        x = size.astype(np.uint64) * factors[n]
        for j in range(min(n, len(every))):
            x[: len(every) - j] += np.where(left[: len(every) - j] > j, every[j:] * factors[j], np.uint64(0))
        for shift, factor in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
            x = (x ^ (x >> np.uint64(shift))) * np.uint64(factor)
        out = [np.unique(g[:k]) for g, k in zip(np.split(x.view(np.int64), ends[:-1]), np.where(sizes < n, np.minimum(sizes, 1), sizes - n + 1), strict=True)]
        return pa.ListArray.from_arrays(np.cumsum([0, *map(len, out)], dtype=np.int32), np.concatenate(out))

    return F.arrow_udf(grams, "array<bigint>")(F.transform(tokens, lambda w: F.xxhash64(w)))


def token_estimate(text: Column) -> Column:
    """A quarter of the characters, at least one; none for an empty text."""
    return F.when(F.length(text) == 0, F.lit(0)).otherwise(F.greatest(F.lit(1), F.floor(F.length(text) / CHARS_PER_TOKEN).cast("int"))).cast("long")


def digest(text: Column, length: int = 64) -> Column:
    """SHA-256 of the text with white space collapsed."""
    return F.left(F.sha2(F.trim(F.regexp_replace(text, r"\s+", " ")), 256), F.lit(length))


def chunk_digest(text: Column) -> Column:
    """First half of the SHA-256 of the raw text."""
    return F.left(F.sha2(text, 256), F.lit(32))


def subject_digest(subject: Column, column: str, salt: str) -> Column:
    """Salted digest by which a data subject is named without being shown."""
    if not salt:
        raise ValueError("a salt is required")
    return F.sha2(F.concat_ws("\x1f", F.lit(salt), F.lit(column), subject.cast("string")), 256)


def jaccard(a: Column, b: Column) -> Column:
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def containment(a: Column, b: Column) -> Column:
    """Share of a's members that b has."""
    n = F.size(F.array_distinct(a))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / n)


def glob(pattern: str) -> str:
    """A shell pattern as an anchored regular expression."""
    quoted = "".join({"*": ".*", "?": "."}.get(c, c if c.isalnum() or c in "_/ " else "\\" + c) for c in pattern)
    return f"^{quoted}$"


def template_variables(text: Column) -> Column:
    """Sorted names in {x} or {{x}}."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(r"\{\{?\s*([A-Za-z_][A-Za-z0-9_]*)\s*\}?\}"), F.lit(1))))


def redact(value: Column, keep: int = 0) -> Column:
    """All but a prefix hidden."""
    return F.concat(F.left(value, F.lit(keep)), F.lit("***"))


def overlap(a: Column, b: Column) -> Column:
    """Shared members over those of the smaller set."""
    n = F.least(F.size(F.array_distinct(a)), F.size(F.array_distinct(b)))
    return F.when(n == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / n)


def render(template: Column, values: Column) -> Column:
    """A template with {{x}} and {x} replaced by a map's values; names that it lacks stay."""
    put = lambda t, e: F.replace(F.replace(t, F.concat(F.lit("{{"), e["key"], F.lit("}}")), e["value"]), F.concat(F.lit("{"), e["key"], F.lit("}")), e["value"])
    tidy = F.regexp_replace(template, r"(\{\{?)\s*([A-Za-z_][A-Za-z0-9_]*)\s*(\}\}?)", "$1$2$3")
    return F.aggregate(F.map_entries(values), tidy, put)


MASK = (1 << 61) - 1
LEAST_SHARED = 40


@F.pandas_udf(LongType())
def salted_hash(texts: pd.Series, salts: pd.Series) -> pd.Series:
    """61-bit BLAKE2b of a text under a salt: Spark has no BLAKE2, and stored signatures must compare."""
    one = lambda t, s: None if t is None else int.from_bytes(hashlib.blake2b(t.encode(), digest_size=8, salt=int(s).to_bytes(8, "big")).digest(), "big") & MASK
    return pd.Series([one(t, s) for t, s in zip(texts, salts, strict=True)], dtype="Int64")


def longest_shared(a: str, b: str) -> str:
    """The first longest substring of `b` that `a` has too, through the suffix automaton of `a`: linear in both."""
    link, length, nexts, last = [-1], [0], [{}], 0
    for c in a:
        now = len(length)
        length.append(length[last] + 1)
        link.append(0)
        nexts.append({})
        p = last
        while p >= 0 and c not in nexts[p]:
            nexts[p][c] = now
            p = link[p]
        if p >= 0:
            q = nexts[p][c]
            if length[p] + 1 == length[q]:
                link[now] = q
            else:
                copy = len(length)
                length.append(length[p] + 1)
                link.append(link[q])
                nexts.append(dict(nexts[q]))
                while p >= 0 and nexts[p].get(c) == q:
                    nexts[p][c] = copy
                    p = link[p]
                link[q] = link[now] = copy
        last = now
    state = size = best = end = 0
    for i, c in enumerate(b):
        while state and c not in nexts[state]:
            state = link[state]
            size = length[state]
        if c in nexts[state]:
            state, size = nexts[state][c], size + 1
        if size > best:
            best, end = size, i + 1
    return b[end - best : end]


@F.pandas_udf(StringType())
def longest_common(a: pd.Series, b: pd.Series) -> pd.Series:
    """The longest text that two hold in common, if of LEAST_SHARED characters or more; for pairs that a join has found, not for all."""
    found = [longest_shared(x, y) if x and y else "" for x, y in zip(a, b, strict=True)]
    return pd.Series([x if len(x) >= LEAST_SHARED else None for x in found])


@F.pandas_udf(StringType())
def line_diff(before: pd.Series, after: pd.Series) -> pd.Series:
    """A unified diff of two texts' lines; empty where they are equal."""
    one = lambda a, b: "\n".join(difflib.unified_diff((a or "").splitlines(), (b or "").splitlines(), "before", "after", lineterm=""))
    return pd.Series([one(a, b) for a, b in zip(before, after, strict=True)])


def did_you_mean(names: Column, known: list[str], cutoff: float = 0.6) -> Column:
    """The known name that the fewest edits lead to, if close enough; ties go to the first by name. `known` is a list that people choose from."""
    far = lambda k: F.levenshtein(F.lower(names), F.lit(k.lower())) / F.greatest(F.length(names), F.lit(max(1, len(k))))
    close = F.array_min(F.array(*[F.struct(far(k).alias("far"), F.lit(k).alias("name")) for k in known]))
    return F.when(close["far"] <= 1 - cutoff, close["name"])
