"""Toxicity by compression distance with Zstandard dictionaries.

Two dictionaries are trained by Zstandard: one on windows of ordinary text, one
on windows of toxic text, which is laid before the ordinary one so that ordinary
words cost the same under both. A window is compressed under either dictionary,
with a carrier that both know after it (a compressor never starts a match in its
last bytes), and the difference of the two lengths is the window's gain.

Most words of a toxic document are ordinary, so which of its windows are toxic is
learned too, by compression alone. The training documents are dealt into folds.
For each, a first toxic dictionary is trained on all windows of the other folds'
toxic documents; the fold's own toxic words that gain more under it than nearly
all ordinary words do are what the next dictionaries are trained on. A document
never chooses by a dictionary that it made itself.

There are two such pairs of dictionaries (`VIEWS`): one whose ordinary dictionary
holds every ordinary word that fits, so a gain means a word that ordinary text does not have, and one
whose smaller ordinary dictionary holds what is frequent in ordinary text, so a
gain also means a beginning or word that toxic text has far more often. The first is surer, the second
needs fewer examples.

A document is scored by windows of one word: longer ones blur a short word's gain
of two to four bytes (the README has the figures). Logistic regression on the
document's gains under both pairs (the largest, and the numbers of windows above several
thresholds), fitted on gains under the other fold's dictionary, calibrates the
thresholds; its output is the score.

Training takes a bounded sample of the labelled rows: about `TOXIC_DOCS` and
`ORDINARY_DOCS` documents, by a hash of their ids, one row of each id, of a long
one a stretch of `MAX_TRAINING_CHARS` at a place given by the hash. Documents
that repeat one before are left out of it, and so are passages that others have; dictionaries are
trained on about `SAMPLED` of their words (a trainer that finds too little leaves the samples as they are).
Scoring takes the whole of every text. A worker remembers the gains of `MEMO` words.

Null and empty texts have no windows and get the score of a text without gains;
so do all texts when a label is missing from the training rows (the score is
then the share of toxic labels, below one half if none is known). Repeated rows
each get their result; repeated or conflicting labels count as toxic if one
does. An empty table gives no rows. Other columns, whatever their names, are not
read.
"""

from __future__ import annotations

import math
import random
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TOXIC_DOCS = 2000
ORDINARY_DOCS = 4000
MAX_TRAINING_CHARS = 40_000
#: Words in a row that mark a passage as repeated in training.
COPY_WORDS = 6
#: Bytes of the later toxic dictionaries, and of the carrier.
TOXIC_BYTES = 65_536
CARRIER_BYTES = 48
#: Words of a window, and of the training windows of the first toxic dictionaries.
WINDOW = 1
FIRST_WINDOW = 12
#: Folds that training documents are dealt into.
FOLDS = 2
#: Windows that the ordinary dictionary is trained on, and words that thresholds are read from.
SAMPLED = 120_000
#: Rounds of choice.
ROUNDS = 2


@dataclass(frozen=True)
class View:
    """One pair of dictionaries.

    The ordinary one is trained on every word once (`words` 0), so what is not in it is unknown to ordinary text, or on
    windows of so many words as they come, so what is rare in ordinary text is not in it.
    """

    words: int
    ordinary_bytes: int
    first_bytes: int  # of the first toxic dictionaries
    quantile: float  # of ordinary words, the share that gains no more than a chosen one
    segment: int  # bytes of a segment of the later toxic dictionaries


#: Bytes that segments of dictionaries are counted by.
COUNTED = 6
VIEWS = (View(0, 262_144, 262_144, 0.998, 24), View(12, 32_768, 32_768, 0.99, 12))
GAINS = (1, 2, 3, 4, 5, 6)
MEMO = 300_000
_WORDS = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return _WORDS.findall(text.lower()) if text else []


def windows_of(words: list[str], width: int) -> list[bytes]:
    return [f" {' '.join(words[i : i + width])} ".encode() for i in range(0, len(words), width)]


def _trained(samples: list[bytes], size: int, **how: int) -> bytes:
    """Content of a dictionary trained on `samples`; of samples that fit as they are, or are too few, the samples."""
    if sum(map(len, samples)) > size:
        try:
            return zstandard.train_dictionary(size, samples, **how).as_bytes()
        except zstandard.ZstdError:
            pass
    return b"".join(samples)[-size:]


def distinct(texts: list[str]) -> list[list[str]]:
    """The words of each text that are in no run of COPY_WORDS words seen in one before; texts of which under half is left are copies and go."""
    seen: set[int] = set()
    out = []
    for words in map(words_of, texts):
        runs = [hash(tuple(words[i : i + COPY_WORDS])) for i in range(max(1, len(words) - COPY_WORDS + 1))]
        copied = {j for i, run in enumerate(runs) if run in seen for j in range(i, i + COPY_WORDS)}
        own = [w for j, w in enumerate(words) if j not in copied]
        if own and 2 * len(own) >= len(words):
            out.append(own)
        seen.update(runs)
    return out


def train_dictionaries(toxic: list[list[list[str]]], ordinary: list[list[list[str]]], view: View = VIEWS[0]) -> tuple[bytes, list[bytes], bytes]:
    """Of folds of documents: the ordinary dictionary, for each fold the toxic one of all others, and the toxic one of all."""
    draw = random.Random(0)
    sampled = lambda xs, n=SAMPLED // len(toxic): draw.sample(xs, min(len(xs), n))
    if view.words:
        windows = [x for fold in ordinary for x in sampled([w for words in fold for w in windows_of(words, view.words)], SAMPLED // len(toxic) // view.words)]
    else:
        windows = [x for fold in ordinary for x in sampled(sorted({w for words in fold for w in windows_of(words, WINDOW)}))]
    plain = _trained(windows, view.ordinary_bytes)
    common = sampled([w for fold in ordinary for words in fold for w in words])
    others = lambda xs, k: [x for j, fold in enumerate(xs) if j != k or len(xs) == 1 for x in fold]
    samples = [[w for words in fold for w in windows_of(words, FIRST_WINDOW)] for fold in toxic]
    content = [_trained(others(samples, k), view.first_bytes) for k in range(len(toxic))]
    how = {"k": view.segment, "d": COUNTED}
    for _ in range(ROUNDS):
        chosen = []
        for k, fold in enumerate(toxic):
            distance = Distance(plain, content[k])
            cut = max(1.0, float(np.quantile([distance.gain(w) for w in common], view.quantile))) if common else 1.0
            kept = (" ".join(w for w in dict.fromkeys(words) if distance.gain(w) > cut) for words in fold)
            chosen.append([f" {x} ".encode() for x in kept if len(x) > COUNTED])
        if not any(chosen):
            break
        samples, content = chosen, [_trained(others(chosen, k), TOXIC_BYTES, **how) for k in range(len(toxic))]
    return plain, content, _trained([x for fold in samples for x in fold], TOXIC_BYTES, **how)


class Distance:
    """Gains of windows: how many bytes the toxic dictionary, laid before the ordinary one, saves over that alone."""

    def __init__(self, ordinary: bytes, toxic: bytes):
        self.parts = ordinary, toxic
        self._open()

    def _open(self) -> None:
        ordinary, toxic = self.parts
        how = zstandard.ZstdCompressionParameters(window_log=18, chain_log=17, hash_log=17, search_log=9, min_match=4, target_length=64, strategy=zstandard.STRATEGY_BTLAZY2, write_content_size=False, write_checksum=False, write_dict_id=False)
        coders = []
        for content in (ordinary, toxic + ordinary):
            known = zstandard.ZstdCompressionDict(content, dict_type=zstandard.DICT_TYPE_RAWCONTENT) if content else None
            if known:
                known.precompute_compress(compression_params=how)
            coders.append(zstandard.ZstdCompressor(dict_data=known, compression_params=how))
        self.plain, self.toxic = (c.compress for c in coders)
        self.carrier, self.memo = ordinary[-CARRIER_BYTES:], {}

    def __getstate__(self) -> tuple[bytes, bytes]:
        return self.parts

    def __setstate__(self, parts: tuple[bytes, bytes]) -> None:
        self.parts = parts
        self._open()

    def gain(self, word: str) -> int:
        found = self.memo.get(word)
        if found is None:
            if len(self.memo) > MEMO:
                self.memo.clear()
            window = f" {word} ".encode() + self.carrier
            found = self.memo[word] = len(self.plain(window)) - len(self.toxic(window))
        return found

    def features_of(self, words: list[str]) -> list[float]:
        """The largest gain, and how many words gain at least so much."""
        gains = Counter(map(self.gain, words))
        above = [sum(n for g, n in gains.items() if g >= least) for least in GAINS]
        scale = 20 / max(len(words), 20)
        return [float(max(gains, default=0)), *map(math.log1p, above), *(scale * n for n in above)]


class ToxicityModel:
    """Distances and calibration."""

    def __init__(self, distances: list[Distance], weights: np.ndarray, share: float):
        self.distances, self.weights, self.share = distances, weights, share

    def score(self, text: str | None) -> float:
        if not len(self.weights):
            return self.share
        words = words_of(text)
        z = float(np.dot(self.weights, _row(words, [d.features_of(words) for d in self.distances])))
        return 1 / (1 + math.exp(-max(-60.0, min(60.0, z))))


def _row(words: list[str], parts: list[list[float]]) -> list[float]:
    return [1.0, *(x for p in parts for x in p), math.log1p(len(words))]


def _logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1.0, rounds: int = 60) -> np.ndarray:
    """Weights of ridge logistic regression, by Newton steps on standardised columns."""
    mean, scale = x.mean(axis=0), x.std(axis=0)
    mean[0], scale[scale == 0] = 0.0, 1.0
    z = (x - mean) / scale
    b = np.zeros(z.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(z @ b, -60, 60)))
        h = (z * (p * (1 - p) + 1e-9)[:, None]).T @ z + ridge * np.eye(len(b))
        step = np.linalg.solve(h, z.T @ (y - p) - ridge * b)
        b += step
        if abs(step).max() < 1e-9:
            break
    w = b / scale
    w[0] = b[0] - (b[1:] * mean[1:] / scale[1:]).sum()
    return w


def fit(toxic: list[str], ordinary: list[str], share: float | None = None) -> ToxicityModel:
    """A model of two samples; `share` is the share of toxic labels, that of the samples unless given."""
    total = len(toxic) + len(ordinary)
    share = (len(toxic) / total if total else 0.0) if share is None else share
    t, o = distinct(toxic), distinct(ordinary)
    if not t or not o:
        return ToxicityModel([], np.empty(0), min(share, 0.49))
    n = min(FOLDS, len(t), len(o))
    folds = [[x[k::n] for k in range(n)] for x in (t, o)]
    dealt = [(words, k, y) for k in range(n) for fold, y in zip(folds, (1.0, 0.0), strict=True) for words in fold[k]]
    parts, distances = [], []
    for view in VIEWS:
        plain, content, whole = train_dictionaries(*folds, view)
        under = [Distance(plain, c) for c in content]
        parts.append([under[k].features_of(words) for words, k, _ in dealt])
        distances.append(Distance(plain, whole))
    rows = [_row(words, list(held)) for (words, _, _), *held in zip(dealt, *parts, strict=True)]
    labels = [y for _, _, y in dealt]
    weights = _logistic(np.array(rows), np.array(labels))
    drawn = sum(labels) / len(labels)
    if 0 < share < 1:
        weights[0] += math.log(share / (1 - share)) - math.log(drawn / (1 - drawn))
    return ToxicityModel(distances, weights, share)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> ToxicityModel:
    """The model of a bounded sample of the labelled documents."""
    marked = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("toxic")).where("id is not null and toxic is not null").groupBy("id").agg(F.max("toxic").alias("toxic"))
    totals = {r["toxic"]: r["n"] for r in marked.groupBy("toxic").agg(F.count("*").alias("n")).where("toxic in (0, 1)").collect()}
    wanted = {1: TOXIC_DOCS, 0: ORDINARY_DOCS}
    share = F.lit(0)
    for y, n in totals.items():
        share = F.when(F.col("toxic") == y, F.lit(int(1e9 * min(1.0, wanted[y] / n)))).otherwise(share)
    place = F.xxhash64("id", F.lit("toxicity"))
    sample = marked.where(F.pmod(place, F.lit(1_000_000_000)) < share)
    stretch = F.substring(F.col("text"), (F.pmod(place, F.greatest(F.length("text") - MAX_TRAINING_CHARS, F.lit(0)) + 1) + 1).cast("int"), F.lit(MAX_TRAINING_CHARS))
    texts = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = texts.join(F.broadcast(sample), "id").groupBy("id", "toxic").agg(F.max(stretch).alias("text")).where("text is not null").collect()
    rows.sort(key=lambda r: str(r["id"]))
    labelled = sum(totals.values())
    return fit([r["text"] for r in rows if r["toxic"] == 1], [r["text"] for r in rows if r["toxic"] == 0], totals.get(1, 0) / labelled if labelled else 0.0)


def score(docs: DataFrame, model: ToxicityModel, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, score) for every row."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.fromiter((shared.value.score(t.as_py()) for t in batch.column(1)), np.float64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], names=["id", "score"])

    return rows.mapInArrow(run, f"id {rows.schema['id'].dataType.simpleString()}, score double")


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity score of every document."""
    docs, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    held_out = F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string")), F.lit(5)) == 0, F.lit(False))
    model = learn(docs, labels.where(~held_out))
    out = score(docs, model).withColumnRenamed("id", "doc_id")
    return out.select("doc_id", held_out.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


QUERIES = {"op3_toxicity": op3_toxicity}
