"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.textcore import STEP, U, WordHashes, as_bytes, chunks, mixed

#: Labelled rows that the fit reads, at most: those with the smallest hash of doc_id.
FIT_ROWS = 6000
BITS, EPOCHS = 20, 12
#: Per-coordinate rate alpha / (beta + sqrt(sum of squared gradients)), and the two penalties.
ALPHA, BETA, L1, L2 = 4.0, 1.0, 8.0, 0.01
#: Rows of the fit that a feature must occur in: what one or two texts hold is chance.
LEAST_ROWS = 3
#: Marks at a word's edge mean nothing here: they count as white space.
EDGES = bytes.maketrans(b".,;:!?|#$%&*<>()[]\"", b" " * 19)
BIGRAM, SKIPGRAM = U(0xD1B54A32D192ED03), U(0x8CB92BA72F3D8DD7)


def hashed(hashes: WordHashes, texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Feature numbers of all words, pairs of neighbours and pairs one word apart; and the text that each belongs to."""
    docs = [t.lower().translate(EDGES).split() for t in texts]
    flat, bounds = hashes.flat(docs)
    owner = np.repeat(np.arange(len(docs)), np.diff(bounds))
    parts, owners = [mixed(flat)], [owner]
    for gap, salt in ((1, BIGRAM), (2, SKIPGRAM)):
        inside = owner[gap:] == owner[:-gap] if len(flat) > gap else np.zeros(0, bool)
        parts.append(mixed((flat[:-gap] * STEP + flat[gap:] * salt)[inside]) if len(inside) else np.zeros(0, U))
        owners.append(owner[gap:][inside] if len(inside) else np.zeros(0, np.int64))
    return (np.concatenate(parts) >> U(64 - BITS)).astype(np.int64), np.concatenate(owners)


class Ftrl:
    """FTRL-proximal over binary features. ``z`` and ``n`` are a coordinate's state; its weight is 0 while \\|z\\| <= L1."""

    def __init__(self) -> None:
        self.z, self.n = np.zeros((1 << BITS) + 1), np.zeros((1 << BITS) + 1)

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z = self.z[at]
        free = np.sign(z) * np.maximum(np.abs(z) - L1, 0)
        return -free / ((BETA + np.sqrt(self.n[at])) / ALPHA + L2)

    def learn(self, at: np.ndarray, y: float) -> None:
        w = self.weights(at)
        g = 1 / (1 + np.exp(-np.clip(w.sum(), -35, 35))) - y
        before = self.n[at]
        self.n[at] = before + g * g
        self.z[at] += g - (np.sqrt(before + g * g) - np.sqrt(before)) / ALPHA * w


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    rows = []
    for b in batches:
        rows += zip(b.column("h").to_pylist(), as_bytes(b.column("text")), b.column("y").to_pylist(), strict=True)
    rows.sort()  # one order, however the rows came
    hashes, model = WordHashes(), Ftrl()
    each, seen = [], np.zeros((1 << BITS) + 1, np.int32)
    for _, text, y in rows:
        hashes.trim()
        each.append((np.append(np.unique(hashed(hashes, [text])[0]), 1 << BITS).astype(np.int32), float(y)))
        seen[each[-1][0]] += 1
    each = [(at[seen[at] >= min(LEAST_ROWS, len(rows))], y) for at, y in each]
    for _ in range(EPOCHS):
        for at, y in each:
            model.learn(at, y)
    w = model.weights()
    at = np.flatnonzero(w)
    yield pa.RecordBatch.from_arrays([pa.array(at, pa.int64()), pa.array(w[at])], names=["at", "w"])


def held_out(folds: int = 5, test: int = 0):
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == test, F.lit(False))


def fitted(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> tuple[np.ndarray, np.ndarray]:
    """Numbers and values of the weights that are not 0, learned from at most ``most`` labelled rows outside the held-out fold.

    The rows are those with the smallest hash of doc_id, so that any size of input gives a sample of the whole; the sample is what one
    task can learn from in seconds, as FTRL goes row by row.
    """
    known = labels.where("toxic in (0, 1) and doc_id is not null").where(~held_out())
    known = known.groupBy("doc_id").agg(F.max("toxic").cast("int").alias("y")).withColumn("h", F.xxhash64("doc_id"))
    picked = known.orderBy("h", "doc_id").limit(most).select(F.col("doc_id").alias("__id"), "h", "y")
    rows = docs.select("doc_id", "text").join(F.broadcast(picked), F.col("doc_id") == F.col("__id")).select("h", "text", "y")
    found = rows.repartition(1).mapInArrow(_fit, "at long, w double").toPandas()
    order = np.argsort(found["at"].to_numpy())
    return found["at"].to_numpy()[order], found["w"].to_numpy()[order]


def scored(docs: DataFrame, model: tuple[np.ndarray, np.ndarray]) -> DataFrame:
    """docs(doc_id, text) -> (doc_id, score), over whole texts."""
    at, w = model

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hashes, table = WordHashes(), np.zeros((1 << BITS) + 1)
        table[at] = w
        for b in batches:
            texts, out = as_bytes(b.column("text")), []
            for i, j in chunks(texts):
                found, owner = hashed(hashes, texts[i:j])
                live = table[found] != 0
                pairs = np.unique(owner[live].astype(np.int64) << 32 | found[live])  # a feature counts once in a text
                out.append(np.bincount(pairs >> 32, table[pairs & 0xFFFFFFFF], j - i) + table[1 << BITS])
            total = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(1 / (1 + np.exp(-np.clip(total, -700, 700))))], names=["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, score double")


def classified(docs: DataFrame, labels: DataFrame, most: int = FIT_ROWS) -> DataFrame:
    """docs(doc_id, text), labels(doc_id, toxic) -> (doc_id, held_out, score, predicted), one row for every row of docs.

    A null text counts as empty and gets the score of no features; a null doc_id is scored and never learned from; a doc_id labelled
    more than once counts as toxic if any label says so. Without labels every score is 1/2; an empty table gives an empty result.
    """
    out = scored(docs, fitted(docs, labels, most))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
