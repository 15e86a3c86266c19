"""Token counts by overlapping chunks against the library's counts of whole texts."""

import os
import random

import pandas as pd
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tests.conftest import DATA
from tidemark.llm import tokencount

os.environ["TOKENIZERS_PARALLELISM"] = "false"
WORDS, BYTES, PIECES = (str(public_tokenizers.path(x)) for x in ("word_bpe_49k.json", "byte_bpe_50k.json", "piece_bpe_32k.model"))
PARTS = ["the ", "don't ", "I'll've", "  ", "\n\n", "é", "́", "é", "Å", "각", "가", "한국어", "日本語", "1234", "!!!", "<|endoftext|>", "<|startoftext|>", "<|endof", "text|>", "a" * 30, "İ", "ẞ", "​", "ힰ", "़", "👩‍🚀", " ", "\t", "'s"]
TEXTS = st.lists(st.sampled_from(PARTS), min_size=5, max_size=120).map("".join)


def library(path, text):
    if path.endswith(".model"):
        import sentencepiece

        return len(sentencepiece.SentencePieceProcessor(model_file=path).encode(text))
    return len(tokencount._tokenizer(path).encode(text, add_special_tokens=False).ids)


def plain_splice(path, text, chunk, overlap):
    """The count by pieces, or None where a junction has no common start."""
    every = list(tokencount.cuts(len(text), chunk, overlap))
    got = [tokencount.encode_piece(path, text[a:b], a, (k * chunk if k else None, (k + 1) * chunk if k + 1 < len(every) else None), overlap) for k, a, b in every]
    total = sum(g[0] for g in got)
    for before, after in zip(got, got[1:]):
        right = {x["p"]: x["d"] for x in before[2]}
        common = [x["p"] for x in after[1] if x["p"] in right]
        if not common:
            return None
        total -= right[min(common)] + next(x["d"] for x in after[1] if x["p"] == min(common))
    return total


@pytest.mark.parametrize("path", [WORDS, BYTES])
@given(TEXTS, st.integers(20, 60), st.integers(18, 60))
@settings(max_examples=400, deadline=None)
def test_every_common_start_is_stable(path, text, chunk, overlap):
    got = plain_splice(path, text, max(chunk, 2 * overlap), overlap)
    assert got is None or got == library(path, text)


def test_kinds_of_files():
    assert tokencount.margin(WORDS) and tokencount.margin(BYTES) and tokencount.margin(PIECES) is None


@pytest.mark.parametrize("path", [WORDS, BYTES, PIECES])
def test_cases(spark, path):
    r = random.Random(3)
    mixed = "".join(r.choice(PARTS) for _ in range(3000))
    rows = [(1, None), (2, ""), (3, "one two"), (4, mixed), (4, mixed), (None, mixed), (5, "x" * 5000), (6, "日本語" * 900), (7, "a b " * 600 + "z" * 3000 + " end." * 400), (8, " " * 4000 + "tail"), (9, "<|endoftext|>" * 300)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("id", "key", "k", "n", "piece", "n_tokens")})
    got = tokencount.token_counts(docs, path, chunk=500, overlap=40).collect()
    want = [(i, len((t or "").encode()), library(path, t or "")) for i, t in rows]
    assert sorted(map(str, want)) == sorted(str((x["id"], x["n_bytes"], x["n_tokens"])) for x in got)
    assert tokencount.token_counts(docs.where("false"), path).count() == 0


def test_query(spark):
    docs = pd.read_parquet(f"{DATA}/documents.parquet").set_index("doc_id")
    got = tokencount.op11_tokens(spark, DATA).toPandas().set_index("doc_id").loc[docs.index]
    assert got.n_tokens.tolist() == [library(WORDS, t) for t in docs.text]
    assert got.over_limit.tolist() == [n > 2048 for n in got.n_tokens]
