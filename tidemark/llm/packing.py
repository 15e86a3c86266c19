"""Packing tokenized documents into fixed windows by best-fit decreasing.

A document longer than the window is first cut into full windows; what is left,
and every shorter document, is placed in decreasing order of length into the
open window that it fills most tightly. A segment tree indexed by remaining
capacity finds that window in log2(window) steps.

Documents are packed in blocks of about `block_tokens` tokens within their input
partition: memory is one block whatever the input, no shuffle is needed, and a
lost task is packed again in the same way. Only the last windows of a block can
be less than full, so padding falls with the block size, not with the input.

A null or empty text is a document of the closing token alone. Repeated rows are
packed as often as they occur; ties go to the earlier row. Other columns of the
input, whatever their names, are not read.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Callable, Iterator, Sequence
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

WINDOW = 2048
END = 1
BLOCK_TOKENS = 1 << 21
#: White-space separated chunks whose ids a worker remembers, in each of two generations.
MEMO = 200_000
#: Texts are encoded in groups of so many characters.
_GROUP = 1 << 20
#: Sequences of one input partition are numbered from its index times this.
_STRIDE = 1 << 36

#: Latin letters, then punctuation without an apostrophe: two pre-tokens whatever stands around them.
_PLAIN = re.compile(r"([A-Za-z\u00C0-\u00D6\u00D8-\u00F6\u00F8-\u00FF]+)([!-&(-/:-@\[-`{-~]*)").fullmatch
#: Byte-level alphabets show bytes that do not print as characters from 256 on, in order.
_HIDDEN = [b for b in range(256) if not (33 <= b <= 126 or 161 <= b <= 172 or 174 <= b)]
_BYTE_CHARS = {b: 256 + i for i, b in enumerate(_HIDDEN)}


def _bytes_of(ids: Sequence[int]) -> bytes:
    return struct.pack(f"<{len(ids)}I", *ids)


class ChunkEncoder(dict):
    """Ids of whole texts as little-endian 32-bit bytes, remembering the ids of recent chunks.

    The tokenizer never joins across ASCII white space, so a text's ids are the
    ids of its chunks in order; most chunks recur, and are encoded once.
    """

    def __init__(self, path: str, memo: int = MEMO):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer, self.memo, self.old, self.pieces = Tokenizer.from_file(path), memo, {}, {}
        self.merge = self.tokenizer.model.tokenize

    def _piece(self, piece: str) -> bytes:
        """Ids of one pre-token of plain letters or plain punctuation, straight from the merge model."""
        found = self.pieces.get(piece)
        if found is None:
            if len(self.pieces) > self.memo:
                self.pieces.clear()
            shown = piece if piece.isascii() else piece.encode().decode("latin-1").translate(_BYTE_CHARS)
            found = self.pieces[piece] = _bytes_of([t.id for t in self.merge(shown)])
        return found

    def __missing__(self, chunk: bytes) -> bytes:
        found = self.old.get(chunk)
        if found is None:
            shown = chunk.decode()
            if plain := _PLAIN(shown):
                found = self._piece(plain[1].lower())
                if plain[2]:
                    found += self._piece(plain[2])
            else:
                found = _bytes_of(self.tokenizer.encode(shown, add_special_tokens=False).ids)
        self[chunk] = found
        return found

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        out, ids = [], self.__getitem__
        for text in texts:
            if len(self) > self.memo:
                self.old = dict(self)
                self.clear()
            out.append(b"".join(map(ids, text.encode().split())))
        return out


class PlainEncoder:
    """Ids of whole texts from any tokenizer file, as it gives them."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)

    def encode(self, texts: Sequence[str]) -> list[bytes]:
        return [_bytes_of(self.tokenizer.encode(text, add_special_tokens=False).ids) for text in texts]


def cuts_at_space(path: str) -> bool:
    """Whether a tokenizer file is of the kind that ChunkEncoder knows: white space dropped, lower case, byte-level pieces with word ends."""
    rules = json.loads(Path(path).read_text(encoding="utf-8"))
    kinds = lambda rule, key: [x["type"] for x in (rule or {}).get(key, [])]
    split = next((x for x in (rules["pre_tokenizer"] or {}).get("pretokenizers", []) if x["type"] == "Split"), {})
    level = next((x for x in (rules["pre_tokenizer"] or {}).get("pretokenizers", []) if x["type"] == "ByteLevel"), {})
    drops = split.get("behavior") == "Removed" and split.get("invert") and level.get("use_regex") is False and level.get("add_prefix_space") is False
    return bool(kinds(rules["normalizer"], "normalizers") == ["NFC", "Replace", "Lowercase"] and kinds(rules["pre_tokenizer"], "pretokenizers") == ["Split", "ByteLevel"] and drops and rules["model"]["type"] == "BPE" and rules["model"]["end_of_word_suffix"])


_ENCODERS: dict[str, ChunkEncoder | PlainEncoder] = {}


def encoder(path: str) -> ChunkEncoder | PlainEncoder:
    """One encoder for each worker and vocabulary; files of other rules than ChunkEncoder's are encoded text by text."""
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path) if cuts_at_space(path) else PlainEncoder(path)
    return _ENCODERS[path]


class OpenWindows:
    """Open windows in a segment tree over remaining capacity; each leaf stacks the windows with just that much left."""

    def __init__(self, capacity: int):
        self.size = 1 << (capacity + 1 - 1).bit_length()
        self.count = [0] * (2 * self.size)
        self.stack: list[list[int]] = [[] for _ in range(capacity + 1)]

    def add(self, left: int, window: int) -> None:
        self.stack[left].append(window)
        node = left + self.size
        while node:
            self.count[node] += 1
            node >>= 1

    def take(self, need: int) -> tuple[int, int] | None:
        """Remove a window with the least remaining capacity that is at least `need`."""
        count, node = self.count, need + self.size
        if not count[node]:
            while True:  # up to the first right sibling that holds a window, then down its left edge
                if node <= 1:
                    return None
                if not node & 1 and count[node + 1]:
                    node += 1
                    break
                node >>= 1
            while node < self.size:
                node *= 2
                if not count[node]:
                    node += 1
        left = node - self.size
        while node:
            count[node] -= 1
            node >>= 1
        return left, self.stack[left].pop()


def best_fit(lengths: Sequence[int], window: int = WINDOW) -> tuple[list[list[tuple[int, int, int]]], list[int]]:
    """Windows as lists of (item, start, length), and the tokens that each holds."""
    windows: list[list[tuple[int, int, int]]] = []
    rest = []
    for item, n in enumerate(lengths):
        whole = n // window
        windows.extend([(item, i * window, window)] for i in range(whole))
        if n > whole * window:
            rest.append((whole * window - n, item, whole * window))
    used = [window] * len(windows)
    rest.sort()
    tree = OpenWindows(window)
    for negative, item, start in rest:
        n = -negative
        if (found := tree.take(n)) is None:
            at, left = len(windows), window
            windows.append([])
            used.append(0)
        else:
            left, at = found
        windows[at].append((item, start, n))
        used[at] += n
        if left > n:
            tree.add(left - n, at)
    return windows, used


_FIELDS = "start long, length long, ids binary, doc_tokens long, sequence_id long, offset long"


def _pack(batches: Iterator[pa.RecordBatch], kind: pa.DataType, encode: Callable[[Sequence[str]], list[bytes]], window: int, end: int, block_tokens: int) -> Iterator[pa.RecordBatch]:
    closing = np.array([end], "<u4").tobytes()
    base = TaskContext.get().partitionId() * _STRIDE
    names, tokens, held = [], [], 0

    def flush() -> Iterator[pa.RecordBatch]:
        nonlocal base, names, tokens, held
        windows, _ = best_fit([len(t) // 4 for t in tokens], window)
        columns: list[list] = [[] for _ in range(7)]
        for at, pieces in enumerate(windows):
            offset = 0
            for item, start, n in pieces:
                row = (names[item], start, n, tokens[item][4 * start : 4 * (start + n)], len(tokens[item]) // 4, base + at, offset)
                for c, x in zip(columns, row, strict=True):
                    c.append(x)
                offset += n
            if len(columns[0]) >= 2048:
                yield batch_of(columns)
                columns = [[] for _ in range(7)]
        if columns[0]:
            yield batch_of(columns)
        base += len(windows)
        names, tokens, held = [], [], 0

    def batch_of(columns: list[list]) -> pa.RecordBatch:
        kinds = (kind, pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], names=["id", "start", "length", "ids", "doc_tokens", "sequence_id", "offset"])

    for batch in batches:
        texts, at = batch.column(1), 0
        while at < batch.num_rows:
            group, size, upto = [], 0, at
            while upto < batch.num_rows and (size < _GROUP):
                group.append(texts[upto].as_py() or "")
                size += len(group[-1])
                upto += 1
            for name, ids in zip(batch.column(0).slice(at, upto - at).to_pylist(), encode(group), strict=True):
                names.append(name)
                tokens.append(ids + closing)
                held += len(ids) // 4 + 1
                if held >= block_tokens:
                    yield from flush()
            at = upto
    if tokens:
        yield from flush()


def pack(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, end: int = END, block_tokens: int = BLOCK_TOKENS) -> DataFrame:
    """One row per piece: id, start, length, ids (little-endian 32-bit), doc_tokens, sequence_id, offset."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = rows.schema["id"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark.sql.pandas.types import to_arrow_type

        yield from _pack(batches, to_arrow_type(kind), encoder(tokenizer).encode, window, end, block_tokens)

    return rows.mapInArrow(run, f"id {kind.simpleString()}, {_FIELDS}")


def pieces(docs: DataFrame, tokenizer: str) -> DataFrame:
    """`pack` with the ids of each piece as their CRC-32."""
    return pack(docs, tokenizer).select(F.col("id").alias("doc_id"), "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")


def default_tokenizer() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document packed into windows of 2048 tokens."""
    return pieces(spark.read.parquet(f"{sf_dir}/documents.parquet"), default_tokenizer())


QUERIES = {"op8_packing": op8_packing}


def crc_of(ids: Sequence[int]) -> int:
    """The digest of a piece, for tests."""
    return zlib.crc32(np.array(ids, "<u4").tobytes())
