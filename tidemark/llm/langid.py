"""Language identification with bit-sliced Bloom filters of n-grams.

One Bloom filter per language would take a probe per language; here the filters
are sliced the other way, so that each slot holds one bit for every language
and the conjunction of an n-gram's slots is the mask of all languages that
contain it. A document's masks are counted per language (a population count by
bit lane), each count is corrected for the filter's false-positive rate, and
the largest share decides.

A language's n-grams are those that make up at least `MIN_SHARE` of the n-grams
in a bounded sample of its labelled documents (`DOCS_PER_LANGUAGE`), so a filter
never holds more than 1 / MIN_SHARE grams of each length: what is collected and
broadcast is bounded by the number of languages.

Null texts and texts without a letter are `und` with score 0, as is everything
when no language could be learned; texts with letters but no known n-gram get the
commonest language with score 0. Ties go to the commoner language, then the
lesser name. Repeated rows each get their result; empty tables give no rows.
Other columns, whatever their names, are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.session import materialize

UNDETERMINED = "und"
#: Bytes of the n-grams: of lower-cased UTF-8 with one space for all that is not a letter or above ASCII.
SIZES = (3, 5)
DOCS_PER_LANGUAGE = 2000
MIN_SHARE = 2e-5
PROBES = 2
#: Slots per gram of the largest language, before rounding up to a power of two.
SLOTS_PER_GRAM = 8
_TABLE = bytes(c if c > 127 or chr(c).isalpha() else 32 for c in range(256))
_MULTIPLIERS = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9), np.uint64(0xD6E8FEB86659FD93))


def grams(text: str, n: int) -> np.ndarray:
    """The n-grams of a text as integers, in order; one space stands at either end."""
    raw = np.frombuffer(b" " + b" ".join(text.lower().encode().translate(_TABLE).split()) + b" ", np.uint8)
    if len(raw) < n:
        return np.empty(0, np.uint64)
    out = raw[: len(raw) - n + 1].astype(np.uint64)
    for i in range(1, n):
        out <<= np.uint64(8)
        out |= raw[i : len(raw) - n + 1 + i]
    return out


@dataclass(frozen=True)
class LanguageFilter:
    """Slots x bytes of language bits, for one gram length."""

    size: int
    slots: np.ndarray
    rates: np.ndarray  # false positives by language

    @classmethod
    def build(cls, size: int, members: list[np.ndarray]) -> LanguageFilter:
        most = max((len(m) for m in members), default=0)
        bits = max(10, int(SLOTS_PER_GRAM * most).bit_length())
        slots = np.zeros((1 << bits, -(-len(members) // 8)), np.uint8)
        for lang, m in enumerate(members):
            for at in _slots_of(m, bits):
                slots[at, lang // 8] |= np.uint8(1 << lang % 8)
        fill = np.unpackbits(slots, axis=1, bitorder="little")[:, : len(members)].mean(axis=0)
        return cls(size, slots, fill**PROBES)

    def counts(self, found: np.ndarray) -> np.ndarray:
        """Per language, the grams that it contains, corrected for false positives."""
        bits = len(self.slots).bit_length() - 1
        masks = None
        for at in _slots_of(found, bits):
            masks = self.slots[at] if masks is None else masks & self.slots[at]
        lanes = [np.bincount(masks[:, b], minlength=256) @ _LANES for b in range(masks.shape[1])]
        raw = np.concatenate(lanes)[: len(self.rates)]
        return np.maximum(raw - len(found) * self.rates, 0) / (1 - self.rates)


_LANES = np.unpackbits(np.arange(256, dtype=np.uint8)[:, None], axis=1, bitorder="little").astype(np.int64)


def _slots_of(found: np.ndarray, bits: int) -> Iterator[np.ndarray]:
    for k in range(PROBES):
        yield ((found * _MULTIPLIERS[k]) >> np.uint64(64 - bits)).astype(np.int64)


@dataclass(frozen=True)
class Identifier:
    languages: list[str]  # commonest first
    filters: list[LanguageFilter]

    def predict(self, text: str | None) -> tuple[str, float]:
        if not text or not self.languages or not any(map(str.isalpha, text)):
            return UNDETERMINED, 0.0
        total = np.zeros(len(self.languages))
        for f in self.filters:
            if len(found := grams(text, f.size)):
                total += f.counts(found) / len(found)
        if not total.sum():
            return self.languages[0], 0.0
        best = int(total.argmax())
        rest = np.delete(total, best).max() if len(total) > 1 else 0.0
        return self.languages[best], float(total[best] / (total[best] + rest))


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        by: dict[str, list[str]] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            by.setdefault(lang, []).append(text)
        for lang, texts in by.items():
            for size in SIZES:
                values, n = np.unique(np.concatenate([grams(t, size) for t in texts]), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(values), pa.string()), pa.array([size] * len(values), pa.int32()), pa.array(values.view(np.int64)), pa.array(n, pa.int64())], names=["lang", "size", "gram", "n"])


def learn(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", docs_per_language: int = DOCS_PER_LANGUAGE) -> Identifier:
    """Filters from about `docs_per_language` documents of each language, chosen by a hash of the id; all if it has fewer."""
    rows = labelled.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    totals = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    languages = sorted(totals, key=lambda x: (-totals[x], x))
    if not languages:
        return Identifier([], [])
    share = F.create_map(*[F.lit(x) for lang in languages for x in (lang, int(1e9 * min(1.0, docs_per_language / totals[lang])))])
    sample = rows.where(F.pmod(F.xxhash64("id", F.lit("sample")), F.lit(1_000_000_000)) < F.element_at(share, F.col("lang")))
    counted = sample.select("lang", "text").mapInArrow(_count_grams, "lang string, size int, gram long, n long").groupBy("lang", "size", "gram").agg(F.sum("n").alias("n")).where("n > 1")
    counted = materialize(counted, "langid-grams")
    whole = counted.groupBy("lang", "size").agg(F.sum("n").alias("whole"))
    common = counted.join(F.broadcast(whole), ["lang", "size"]).where(F.col("n") >= F.greatest(F.lit(2.0), MIN_SHARE * F.col("whole"))).select("lang", "size", "gram").toArrow()
    langs, sizes, values = (common.column(c).to_numpy(zero_copy_only=False) if c != "lang" else np.array(common.column(c).to_pylist(), object) for c in ("lang", "size", "gram"))
    filters = [LanguageFilter.build(size, [np.sort(values[(langs == lang) & (sizes == size)].view(np.uint64)) for lang in languages]) for size in SIZES]
    return Identifier(languages, filters)


def identify(docs: DataFrame, model: Identifier, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, lang_pred, score) for every row.

    The id may be a struct that holds the text as well: a text column of the form
    id.field is then read out of it, so the text travels once.
    """
    inner = text_col.removeprefix(f"{id_col}.") if text_col.startswith(f"{id_col}.") else None
    rows = docs.select(F.col(id_col).alias("id"), *([] if inner else [F.col(text_col).alias("text")]))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = shared.value.predict
        for batch in batches:
            texts = batch.column(0).field(inner) if inner else batch.column(1)
            langs, scores = zip(*(predict(t.as_py()) for t in texts), strict=True) if batch.num_rows else ((), ())
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["id", "lang_pred", "score"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, lang_pred string, score double")


def fold(id_col: str, folds: int) -> Column:
    """The fold of a row, from its id alone."""
    return F.pmod(F.crc32(F.col(id_col).cast("string")), F.lit(folds))


def model_of(docs: DataFrame) -> Identifier:
    """The identifier that op10 and the pipeline use: learned from the folds that are not held out."""
    return learn(docs.where(fold("doc_id", 4) != 2))


def op10_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The predicted language of every document."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    out = identify(docs, model_of(docs)).withColumnRenamed("id", "doc_id")
    return out.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


QUERIES = {"op10_language": op10_language}
