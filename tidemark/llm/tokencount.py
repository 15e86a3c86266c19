"""Token counts of whole texts; huge documents in overlapping chunks that are spliced where both sides provably agree.

A document of more than `chunk` characters is cut into pieces that reach `overlap`
characters into their neighbours. Pieces are dealt out over the cluster, encoded
with offsets, and report the word starts in both overlaps. Two neighbours are
spliced at the first position that starts a word in both. That position is
stable, so that the text up to it and the text from it on are encoded apart:

* the pre-tokenizer reads from left to right, so what follows a start that both
  have is cut alike; what precedes it was cut with all that decides it in view,
  since the position is further from a piece's end than a match looks ahead;
* it is further from both ends than the longest added token is long, so none that
  a cut broke reaches it;
* normalization does not reach over it: its character combines with none before.

Where no such position exists the document is cut again with overlaps eight
times as wide, until one is found or a single piece holds the whole text, so every count
is that of the whole text. Files whose rules are not of the kinds above are
encoded text by text.

Texts of one piece are counted where they are read, without a shuffle. A piece
and its word starts are all that a task holds; what is gathered for a junction are
the starts in one overlap. A lost task cuts or encodes its pieces again in the same way.

A null or empty text has no bytes and no tokens. Repeated rows have a count each.
Other columns, whatever their names, are not read; empty tables give no rows.
"""

from __future__ import annotations

import hashlib
import json
import os
import unicodedata
from bisect import bisect_left
from collections.abc import Iterator
from functools import cache
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm.packing import default_tokenizer, encoder
from tidemark.session import materialize

#: Characters of a piece, and by how many it reaches into each neighbour at first.
CHUNK = 1 << 15
OVERLAP = 256
WIDER = 8
LIMIT = 2048

_STARTS = "array<struct<p:long,d:long>>"
_ARROW_STARTS = pa.list_(pa.struct([("p", pa.int64()), ("d", pa.int64())]))


@cache
def margin(path: str) -> int | None:
    """How far from a piece's ends a splice must stay; None if the file's rules are not known to work from left to right."""
    if not path.endswith(".json"):
        return None
    rules = json.loads(Path(path).read_text(encoding="utf-8"))
    steps = lambda rule, key: [] if not rule else rule.get(key, [rule])
    cleans = steps(rules["normalizer"], "normalizers")
    cuts = steps(rules["pre_tokenizer"], "pretokenizers")
    local = all(x["type"] in ("NFC", "Lowercase") or (x["type"] == "Replace" and x["pattern"] == {"Regex": r"\s+"} and x["content"] == " ") for x in cleans)
    onward = bool(cuts) and all((x["type"] == "ByteLevel" and not x["add_prefix_space"]) or (x["type"] == "Split" and "(?<" not in x["pattern"].get("Regex", "(?<")) for x in cuts) and any(x["type"] == "Split" or x.get("use_regex") for x in cuts)
    added = all(not (x["lstrip"] or x["rstrip"] or x["single_word"] or x["normalized"]) for x in rules["added_tokens"])
    plain = rules["model"]["type"] == "BPE" and not (rules["model"].get("dropout") or rules["truncation"] or rules["padding"]) and (rules["post_processor"] or {"type": "ByteLevel"})["type"] == "ByteLevel"
    return max([8, *(len(x["content"]) for x in rules["added_tokens"])]) if local and onward and added and plain else None


def combines_with_none(c: str) -> bool:
    """Whether a character surely starts a new unit of normalization: no mark, no inner jamo, nothing of the later planes."""
    return c < "̀" or (ord(c) < 0x10000 and unicodedata.category(c)[0] in "LNPSZ" and not 0x1100 <= ord(c) < 0x1200)


class PieceModel:
    """Counts by a sentencepiece model."""

    def __init__(self, path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=path)

    def counts(self, texts: list[str]) -> list[int]:
        return [len(x) for x in self.model.encode(texts, num_threads=1)]


class Counter:
    """Counts by a tokenizers file."""

    def __init__(self, path: str):
        self.encoder = encoder(path)

    def counts(self, texts: list[str]) -> list[int]:
        return [len(x) // 4 for x in self.encoder.encode(texts)]


@cache
def counter(path: str) -> Counter | PieceModel:
    return Counter(path) if path.endswith(".json") else PieceModel(path)


@cache
def _tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def cuts(length: int, chunk: int, overlap: int) -> Iterator[tuple[int, int, int]]:
    """(number, start, end) of the pieces of a text."""
    n = max(1, -(-length // chunk))
    for k in range(n):
        yield k, max(0, k * chunk - overlap), min(length, (k + 1) * chunk + overlap)


def encode_piece(path: str, text: str, start: int, junctions: tuple[int | None, int | None], overlap: int) -> tuple[int, list[dict], list[dict]]:
    """(tokens, starts at the left cut, starts at the right cut) of a piece; a start has its place p in the text and the tokens d beyond it, away from the piece's middle."""
    found = _tokenizer(path).encode(text, add_special_tokens=False)
    offsets, words, edge = found.offsets, found.word_ids, margin(path)
    sides = []
    for at, left in zip(junctions, (True, False), strict=True):
        held: dict[int, int] = {}
        if at is not None:
            low, high = max(at - overlap - start, 0) + edge, min(at + overlap - start, len(text)) - edge
            i = bisect_left(offsets, (low,))
            while i < len(offsets) and offsets[i][0] < high:
                p = offsets[i][0]
                if (i == 0 or words[i] is None or words[i] != words[i - 1]) and combines_with_none(text[p]):
                    held[p] = -1 if p in held else i  # two words from one character
                i += 1
        sides.append([{"p": p + start, "d": i if left else len(offsets) - i} for p, i in held.items() if i >= 0])
    return len(offsets), sides[0], sides[1]


def _pieces(rows: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """(id, n_bytes, key, k, n, start, piece) of every row; key tells rows of different ids or texts apart."""
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                text, name = batch.column(2)[i].as_py(), batch.column(0)[i]
                key = hashlib.blake2b(text.encode(), digest_size=20, key=repr(name.as_py()).encode()[:64]).digest()
                every = list(cuts(len(text), chunk, overlap))
                n = len(every)
                for j in range(0, n, 64):
                    part = every[j : j + 64]
                    m = len(part)
                    columns = [pa.repeat(name, m), pa.repeat(batch.column(1)[i], m), pa.array([key] * m, pa.binary()), pa.array([x[0] for x in part], pa.int64()), pa.array([n] * m, pa.int64()), pa.array([x[1] for x in part], pa.int64()), pa.array([text[x[1] : x[2]] for x in part], pa.string())]
                    yield pa.RecordBatch.from_arrays(columns, names=["id", "n_bytes", "key", "k", "n", "start", "piece"])

    return rows.mapInArrow(run, f"id {kind}, n_bytes long, key binary, k long, n long, start long, piece string")


def _encoded(pieces: DataFrame, tokenizer: str, chunk: int, overlap: int) -> DataFrame:
    """(id, n_bytes, key, k, n, tokens, left, right): each piece's tokens and the starts at its cuts."""
    kind = pieces.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            tokens, lefts, rights = [], [], []
            for i in range(batch.num_rows):
                k, n, start, text = (batch.column(c)[i].as_py() for c in range(3, 7))
                total, left, right = encode_piece(tokenizer, text, start, (k * chunk if k else None, (k + 1) * chunk if k + 1 < n else None), overlap)
                tokens.append(total)
                lefts.append(left)
                rights.append(right)
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in range(5)), pa.array(tokens, pa.int64()), pa.array(lefts, _ARROW_STARTS), pa.array(rights, _ARROW_STARTS)], names=["id", "n_bytes", "key", "k", "n", "tokens", "left", "right"])

    return pieces.mapInArrow(run, f"id {kind}, n_bytes long, key binary, k long, n long, tokens long, left {_STARTS}, right {_STARTS}")


def first_common(left: Column, right: Column) -> Column:
    """The tokens that two neighbours have twice, by the first start that both have; null if there is none."""
    other = F.map_from_entries(right)
    both = F.transform(left, lambda x: F.struct(x["p"].alias("p"), (x["d"] + F.element_at(other, x["p"])).alias("d")))
    return F.array_min(F.filter(both, lambda x: x["d"].isNotNull()))["d"]


def _spliced(encoded: DataFrame) -> DataFrame:
    """(id, n_bytes, key, n_tokens, copies): n_tokens is null where a junction has no common start."""
    none = F.lit(None).cast(_STARTS)
    side = lambda j, left, right: F.struct(j.alias("j"), left.alias("left"), right.alias("right"))
    sides = encoded.select("key", "n", F.explode(F.array(side(F.col("k"), F.col("left"), none), side(F.col("k") + 1, none, F.col("right")))).alias("s")).where("s.j > 0 and s.j < n")
    joints = sides.groupBy("key", "s.j").agg(F.max("s.left").alias("left"), F.max("s.right").alias("right")).select("key", first_common(F.col("left"), F.col("right")).alias("twice"))
    twice = joints.groupBy("key").agg(F.sum("twice").alias("twice"), F.count("twice").alias("joined"))
    whole = encoded.groupBy("key").agg(F.first("id").alias("id"), F.first("n_bytes").alias("n_bytes"), F.first("n").alias("n"), F.sum("tokens").alias("tokens"), F.sum(F.when(F.col("k") == 0, 1).otherwise(0)).alias("copies"))
    total = F.floor(F.col("tokens") / F.col("copies")) - F.coalesce("twice", F.lit(0))
    return whole.join(twice, "key", "left").select("id", "n_bytes", "key", F.when(F.coalesce("joined", F.lit(0)) == F.col("n") - 1, total).cast("long").alias("n_tokens"), "copies")


def _short(rows: DataFrame, tokenizer: str) -> DataFrame:
    kind = rows.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer).counts
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(count([x or "" for x in batch.column(2).to_pylist()]), pa.int64())], names=["id", "n_bytes", "n_tokens"])

    return rows.mapInArrow(run, f"id {kind}, n_bytes long, n_tokens long")


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(id, n_bytes, n_tokens) of every row, as the tokenizer gives them for the whole text."""
    rows = docs.select(F.col(id_col).alias("id"), F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long").alias("n_bytes"), F.col(text_col).alias("text"))
    if margin(tokenizer) is None:
        return _short(rows, tokenizer)
    huge = F.coalesce(F.length("text"), F.lit(0)) > chunk
    out, left = _short(rows.where(~huge), tokenizer), None
    while True:
        pieces = _pieces(rows.where(huge), chunk, overlap)
        pieces = pieces.join(left, "key", "left_semi").select(*pieces.columns) if left is not None else pieces
        found = materialize(_spliced(_encoded(pieces.repartition("key", "k"), tokenizer, chunk, overlap)), "spliced")
        out = out.unionByName(found.where("n_tokens is not null").select("id", "n_bytes", "n_tokens", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int")))).drop("col"))
        left = found.where("n_tokens is null").select("key")
        if left.isEmpty():
            return out
        overlap *= WIDER
        chunk = max(chunk, 4 * overlap)


def op11_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of every document, and whether they are more than 2048."""
    out = token_counts(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer())
    return out.select(F.col("id").alias("doc_id"), "n_bytes", "n_tokens", (F.col("n_tokens") > LIMIT).alias("over_limit"))


QUERIES = {"op11_tokens": op11_tokens}
