"""Toxicity on few labels: held-out documents."""

import zlib

import numpy as np
import pandas as pd
import pytest

from tidemark.llm import toxicity


@pytest.mark.parametrize("scale, least", [("0.01", 0.93), ("0.1", 0.95)])
def test_held_out(scale, least):
    folder = f"/root/testdata/sf{scale}"
    docs = pd.read_parquet(f"{folder}/documents.parquet").drop_duplicates("doc_id")
    labels = pd.read_parquet(f"{folder}/labels.parquet").dropna(subset=["toxic"]).groupby("doc_id").toxic.max().reset_index()
    rows = docs.merge(labels, on="doc_id")
    held = np.array([zlib.crc32(str(i).encode()) % 5 == 0 for i in rows.doc_id])
    known, new = rows[~held], rows[held]
    model = toxicity.fit(known[known.toxic == 1].text.tolist()[:2000], known[known.toxic == 0].text.tolist()[:4000], known.toxic.mean())
    ranks = pd.Series([model.score(t) for t in new.text]).rank().to_numpy()
    toxic = (new.toxic == 1).to_numpy()
    n, rest = toxic.sum(), (~toxic).sum()
    assert (ranks[toxic].sum() - n * (n + 1) / 2) / (n * rest) >= least
