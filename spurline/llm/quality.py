"""Quality classifier: logistic regression on hashed word n-grams, trained by follow-the-regularised-leader."""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words and runs of other signs; a long text is read as a stream of these.
TOKEN = re.compile(r"\w+|[^\w\s]+")
#: Distinct tokens that a worker remembers the hash of.
REMEMBERED = 200_000
_hashes: dict[str, int] = {}
_MIX = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Settings:
    """alpha, beta, l1, l2: of the per-coordinate FTRL-proximal update. rows: about how many labelled rows
    are drawn for training, by hash of their id; shard_rows: how many of them one learner reads. orders: of the n-grams.
    again: distances at which two equal tokens are a feature, an n-gram with its words left open; () for n-grams alone."""

    bits: int = 18
    orders: tuple[int, ...] = (1, 2)
    again: tuple[int, ...] = (1, 2, 3)
    alpha: float = 2.0
    beta: float = 1.0
    l1: float = 0.0001
    l2: float = 0.00001
    passes: int = 4
    rows: int = 20_000
    shard_rows: int = 2_500


def _width(s: Settings) -> int:
    return 2**s.bits + 1 + len(s.again)


def features(text: str | None, s: Settings) -> tuple[np.ndarray, np.ndarray]:
    """Hashed n-grams of a text, with the square roots of their counts scaled to length 1.

    Feature 0 is always on. The next count the pairs of equal tokens at each distance of s.again:
    n-grams that say "the same word again" whichever word it is.
    """
    if len(_hashes) > REMEMBERED:
        _hashes.clear()
    codes = []
    for token in TOKEN.findall(text or ""):
        code = _hashes.get(token)
        if code is None:
            # the case of a word and the signs in it count; a digit stands for all
            code = _hashes[token] = zlib.crc32(re.sub(r"\d", "0", token).encode("utf-8", "surrogatepass")) * 0x9E3779B1 & (2**63 - 1)
        codes.append(code)
    one = np.array(codes, dtype=np.uint64)
    grams, rolled = [], one
    for n in range(1, max(s.orders) + 1):
        if n > 1:
            rolled = rolled[:-1] * _MIX + one[n - 1 :] if len(rolled) > 1 else rolled[:0]
        if n in s.orders:
            grams.append(((rolled * _MIX + np.uint64(n)) >> np.uint64(64 - s.bits)).astype(np.int64))
    index, count = np.unique(np.concatenate(grams), return_counts=True)
    repeats = [np.count_nonzero(one[d:] == one[:-d]) if len(one) > d else 0 for d in s.again]
    value = np.sqrt(np.concatenate([[1], repeats, count]))
    norm = np.sqrt((value[1:] ** 2).sum()) or 1.0
    value[1:] /= norm
    return np.concatenate([np.arange(1 + len(s.again)), index + 1 + len(s.again)]), value


def learn(texts: list[str], marks: list[int], s: Settings) -> np.ndarray:
    """Weights after FTRL-proximal passes over the rows in the order given."""
    z, n = np.zeros(_width(s)), np.zeros(_width(s))
    rows = [features(t, s) for t in texts]

    def weights(z: np.ndarray, n: np.ndarray) -> np.ndarray:
        return np.where(np.abs(z) <= s.l1, 0.0, -(z - np.sign(z) * s.l1) / ((s.beta + np.sqrt(n)) / s.alpha + s.l2))

    for _ in range(s.passes):
        for (i, x), mark in zip(rows, marks):
            w = weights(z[i], n[i])
            g = (1 / (1 + np.exp(-np.clip(w @ x, -35, 35))) - mark) * x
            z[i] += g - (np.sqrt(n[i] + g * g) - np.sqrt(n[i])) / s.alpha * w
            n[i] += g * g
    return weights(z, n)


def train(docs: DataFrame, labels: DataFrame, s: Settings = Settings()) -> np.ndarray:
    """Fits weights to docs (doc_id, text) by labels (doc_id, quality: 0 or 1).

    About s.rows labelled rows are drawn by hash of doc_id, so the model's cost is bounded; all
    are used where there are fewer. They are dealt by hash to learners of about s.shard_rows rows,
    each of which runs its own FTRL passes, and the weights are averaged. Only the averaged weights
    that are not 0 come to the driver: at most 2**bits + 1 + len(again). Labels other than 0 and 1, null ids, and
    ids without a document are left out; repeated labels of an id count once for each different one.
    Without any labelled row all weights are 0.
    """
    marks = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)").distinct()
    there = marks.count()
    if not there:
        return np.zeros(_width(s), dtype=np.float32)
    spread = F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000_007))
    drawn = marks.where(spread < 1_000_000_007 * min(1.0, s.rows / there)) if there > s.rows else marks
    shards = max(1, round(min(there, s.rows) / s.shard_rows))

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["order", "doc_id", "quality", "text"])
        w = learn(rows["text"].tolist(), rows["quality"].tolist(), s)
        at = np.flatnonzero(w)
        return pd.DataFrame({"at": at, "w": w[at]})

    learned = (
        docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
        .join(F.broadcast(drawn), "doc_id")  # about s.rows rows of two numbers
        .withColumns({"order": F.xxhash64("doc_id", F.lit(1)), "shard": F.pmod(F.xxhash64("doc_id", F.lit(2)), F.lit(shards))})
        .groupBy("shard").applyInPandas(fit, "at long, w double")
        .groupBy("at").agg((F.sum("w") / shards).cast("float").alias("w")).toArrow()
    )
    weights = np.zeros(_width(s), dtype=np.float32)
    weights[learned["at"].to_numpy()] = learned["w"].to_numpy()
    return weights


def score(docs: DataFrame, weights: np.ndarray, s: Settings = Settings()) -> DataFrame:
    """Per row of docs (doc_id, text): doc_id and score, the chance of label 1, from the whole text alone.

    A null text is an empty one, which gets the score of the constant feature. Ids may be null or repeat.
    """
    sent = docs.sparkSession.sparkContext.broadcast(weights)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = sent.value
        for batch in batches:
            dots = np.empty(batch.num_rows)
            for k, text in enumerate(batch.column("text")):
                i, x = features(text.as_py(), s)
                dots[k] = w[i] @ x
            scores = 1 / (1 + np.exp(-np.clip(dots, -35, 35)))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(scores)], ["doc_id", "score"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, "doc_id long, score double")
