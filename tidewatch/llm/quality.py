"""Quality rules by compression bands, and a quality classifier by regularised quadratic discriminant analysis."""

from __future__ import annotations

import functools
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidewatch.llm.storage import written
from tidewatch.llm.textcore import WordHashes, chunks, forget, portions, trimmed, windows

SPACES = (b" ", b"\t", b"\n", b"\v", b"\f", b"\r")
SYMBOLS, UPPER, DIGITS, MARKS = b"#*$%&|<>", bytes(range(65, 91)), bytes(range(48, 58)), b".,;:!?'\"()-"
CONTINUATION = bytes(range(0x80, 0xC0))

#: Base rule.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: zstandard level, bytes in a chunk. What is left over at the end belongs to the last chunk, which then has up to twice as many.
LEVEL, CHUNK = 3, 2048
#: Fixed values: (texts of up to so many bytes, lowest and highest ratio of raw to compressed size). Longer texts hold more that recurs,
#: so prose of any language compresses better with length; the highest ratio leaves a few hundredths above prose.
BANDS = (
    (256, 0.90, 1.90),
    (512, 1.10, 2.00),
    (1024, 1.20, 2.12),
    (2048, 1.30, 2.24),
    (4096, 1.40, 2.36),
    (8192, 1.45, 2.44),
    (16384, 1.50, 2.52),
    (32768, 1.50, 2.60),
    (65536, 1.50, 2.70),
    (math.inf, 1.50, 2.80),
)
#: Fixed values of the same kind for chunks, wider than for texts, as a chunk may be a list or a title page.
CHUNK_BANDS = ((2048, 1.15, 2.30), (3072, 1.18, 2.36), (4096, 1.20, 2.42))


def without(text: bytes, some: bytes) -> int:
    """How many bytes of ``text`` are in ``some``."""
    return len(text) - len(text.translate(None, some))


def repeat_words(value: np.ndarray) -> int:
    """Words in windows of three that occur twice or more, from the windows' hashes in order."""
    s = np.sort(value)
    again = s[1:][s[1:] == s[:-1]]
    if not len(again):
        return 0
    at = np.flatnonzero(np.isin(value, again))
    marked = np.zeros(len(value) + 2, bool)
    for k in range(3):
        marked[at + k] = True
    return int(marked.sum())


def dup_lines(text: bytes) -> int:
    """Lines with a word that equal an earlier line."""
    lines = [x for x in text.split(b"\n") if x.split()]
    return len(lines) - len(set(lines))


def counted(texts: list[bytes], hashes: WordHashes) -> Iterator[tuple[list[bytes], int]]:
    """For each text its words and n_repeat_words."""
    for a, b in chunks(texts):
        docs = [t.split() for t in texts[a:b]]
        value, at = windows(*hashes.flat(docs), 3)
        for i, words in enumerate(docs):
            yield words, repeat_words(value[at[i] : at[i + 1]])


def ratios(text: bytes, press: zstandard.ZstdCompressor) -> tuple[float, list[tuple[int, float]]]:
    """Raw to compressed size of the whole text, and (bytes, ratio) of its chunks if it is longer than one: all of the text is in them."""
    if not text:
        return 1.0, []
    whole = len(text) / len(press.compress(text))
    if len(text) <= CHUNK:
        return whole, []
    edges = [*range(0, len(text) - CHUNK + 1, CHUNK), len(text)]
    parts = [text[a:b] for a, b in zip(edges[:-1], edges[1:], strict=True)]
    return whole, [(len(x), len(x) / len(press.compress(x))) for x in parts]


def spread(whole: float, chunks_: list[tuple[int, float]]) -> tuple[float, float]:
    """Lowest and highest ratio of the chunks; the whole's without chunks."""
    return min((r for _, r in chunks_), default=whole), max((r for _, r in chunks_), default=whole)


def inside(bands: tuple, size: int, ratio: float) -> bool:
    _, least, most = next(b for b in bands if size <= b[0])
    return least <= ratio <= most


def in_bands(size: int, whole: float, chunks_: list[tuple[int, float]]) -> bool:
    """The method's verdict on a text of ``size`` bytes: it and every chunk lie in the band for their length."""
    return inside(BANDS, size, whole) and all(inside(CHUNK_BANDS, n, r) for n, r in chunks_)


RULE_SCHEMA = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, ratio double, chunk_low double, chunk_high double, base_failed boolean, kept boolean"


@trimmed
def _rules(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """``column``: where the text is. All columns but __text are passed on."""
    forget()
    hashes, press = WordHashes(), zstandard.ZstdCompressor(level=LEVEL)
    for batch, texts in portions(batches, column):
        rows = []
        for text, (words, repeats) in zip(texts, counted(texts, hashes), strict=True):
            n = len(words)
            chars = len(text) - without(text, CONTINUATION) - sum(map(text.count, SPACES))
            whole, parts = ratios(text, press)
            failed = n < MIN_WORDS or 100 * repeats > MAX_REPEAT_PERCENT * n
            rows.append((n, chars, without(text, SYMBOLS), dup_lines(text), repeats, whole, *spread(whole, parts), failed, not failed and in_bands(len(text), whole, parts)))
        made = list(zip(*rows, strict=True)) or [()] * 10
        kinds = [pa.int64()] * 5 + [pa.float64()] * 3 + [pa.bool_()] * 2
        names = [x.split()[0] for x in RULE_SCHEMA.split(", ")]
        rest = [(n, batch.column(n)) for n in batch.schema.names if n != "__text"]
        yield pa.RecordBatch.from_arrays([c for _, c in rest] + [pa.array(v, k) for v, k in zip(made, kinds, strict=True)], names=[n for n, _ in rest] + names)


def rules(docs: DataFrame, text: str = "text", carry: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """docs -> the ``carry`` columns, counts of words, characters, symbols, repeated lines and words, ratios, base_failed and kept.

    A null or empty text has no words, so it fails the base rule; one row for every row, repeated or not; an empty table gives an
    empty result. Columns that are not asked for are not read, so their names can't clash; a carried column must not bear the name
    of a result (ValueError).
    """
    if clash := {c.lower() for c in carry} & {x.split()[0] for x in RULE_SCHEMA.split(", ")}:
        raise ValueError(f"carried columns bear names of results: {sorted(clash)}")
    picked, column = _with_text(docs, carry, text)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema if f.name != "__text"] + [RULE_SCHEMA])
    return picked.mapInArrow(functools.partial(_rules, column=column), schema)


def _with_text(docs: DataFrame, carry: tuple[str, ...], text: str = "text") -> tuple[DataFrame, str]:
    """The ``carry`` columns and the text, and the name of the column that has it: a carried text goes to the workers once."""
    if text in carry:
        return docs.select(*[F.col(c) for c in carry]), text
    return docs.select(*[F.col(c) for c in carry], F.col(text).alias("__text")), "__text"


#: Statistics of a document, all about unit scale.
FEATURES = ("log_words", "word_length", "symbols", "pipes", "upper", "digits", "marks", "exclaims", "accents", "distinct", "repeats", "dup_lines", "line_length", "ratio", "chunk_spread")


def features(text: bytes, words: list[bytes], repeats: int, press: zstandard.ZstdCompressor) -> list[float]:
    """Transformed statistics: logarithms of counts, square roots of shares (which evens out their spread)."""
    n, size = len(words), max(1, len(text))
    share = lambda k, of: math.sqrt(k / max(1, of))
    whole, parts = ratios(text, press)
    low, high = spread(whole, parts)
    lines = text.count(b"\n") + 1
    return [
        math.log1p(n) / 3,
        math.log1p(size / max(1, n)),
        share(without(text, SYMBOLS), size) * 3,
        share(text.count(b"|"), size) * 3,
        share(without(text, UPPER), size) * 3,
        share(without(text, DIGITS), size) * 3,
        share(without(text, MARKS), size) * 3,
        share(text.count(b"!"), size) * 3,
        share(without(text, CONTINUATION), size) * 3,
        math.log1p(len(set(words))) / max(1.0, math.log1p(n)) * 3,
        share(repeats, n) * 2,
        share(dup_lines(text), lines) * 2,
        math.log1p(n / lines) / 2,
        whole - math.log1p(size) / 8,
        (high - low) * 2,
    ]


@trimmed
def _features(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[pa.RecordBatch]:
    """``column``: where the text is. All columns but __text are passed on."""
    forget()
    hashes, press = WordHashes(), zstandard.ZstdCompressor(level=LEVEL)
    for batch, texts in portions(batches, column):
        x = [features(t, w, r, press) for t, (w, r) in zip(texts, counted(texts, hashes), strict=True)]
        rest = [(n, batch.column(n)) for n in batch.schema.names if n != "__text"]
        yield pa.RecordBatch.from_arrays([c for _, c in rest] + [pa.array(x, pa.list_(pa.float64()))], names=[n for n, _ in rest] + ["x"])


def with_features(docs: DataFrame, carry: tuple[str, ...] = ("doc_id",), keep_text: bool = False) -> DataFrame:
    """docs -> the ``carry`` columns (and text), x ARRAY<DOUBLE>. A null text counts as empty; one row for every row, repeated or not."""
    picked, column = _with_text(docs, (*carry, *["text"] * keep_text))
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in picked.schema if f.name != "__text"] + ["x array<double>"])
    return picked.mapInArrow(functools.partial(_features, column=column), schema)


def _moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each class and partition: n, sums, sums of products."""
    d, total = len(FEATURES), {}
    for batch in batches:
        y = batch.column("y").to_numpy(zero_copy_only=False)
        x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, d)
        for k in np.unique(y):
            part = x[y == k]
            total[int(k)] = total.get(int(k), 0) + np.concatenate([[len(part)], part.sum(0), (part.T @ part).ravel()])
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([v.tolist() for v in total.values()], pa.list_(pa.float64()))], names=["y", "m"])


class Discriminant:
    """Two Gaussians with shrunken covariances; the score compares their Mahalanobis log-densities.

    A class covariance is mixed with the pooled one (``to_pooled``) and that with its mean variance on the diagonal (``to_ball``).
    The Cholesky factors' inverses are kept, so a score costs two products of a triangular matrix and a vector.
    """

    def __init__(self, moments: dict[int, np.ndarray], to_pooled: float = 0.1, to_ball: float = 0.02):
        d = len(FEATURES)
        self.classes = {}
        n = {k: m[0] for k, m in moments.items()}
        mean = {k: m[1 : d + 1] / m[0] for k, m in moments.items()}
        cov = {k: m[d + 1 :].reshape(d, d) / m[0] - np.outer(mean[k], mean[k]) for k, m in moments.items()}
        pooled = sum(cov[k] * n[k] for k in cov) / sum(n.values()) if n else None
        for k in cov:
            c = (1 - to_pooled) * cov[k] + to_pooled * pooled
            c = (1 - to_ball) * c + (to_ball * np.trace(c) / d + 1e-6) * np.eye(d)
            low = np.linalg.cholesky(c)
            self.classes[k] = (mean[k], np.linalg.inv(low), math.log(n[k] / sum(n.values())) - np.log(np.diag(low)).sum())

        self.threshold = 0.0

    def evidence(self, x: np.ndarray) -> np.ndarray:
        """Difference of the log-densities (class 1 over class 0), drawn in by asinh as far from the means it is huge."""
        density = {}
        for k, (mean, inverse, log) in self.classes.items():
            z = (x - mean) @ inverse.T
            density[k] = log - 0.5 * (z * z).sum(1)
        return np.arcsinh(density[1] - density[0])

    def scores(self, x: np.ndarray) -> np.ndarray:
        """Probability of class 1. With one class in the training rows: that class; with none: 1/2."""
        if set(self.classes) != {0, 1}:
            return np.full(len(x), next(iter(self.classes), 0.5), float)
        return 1 / (1 + np.exp(np.clip(2 * (self.threshold - self.evidence(x)), -700, 700)))

    def calibrate(self, counts: dict[tuple[int, int], int]) -> None:
        """Set the threshold to the middle of the range where the training rows' error is least. counts: (class, bin of evidence) -> rows."""
        at = range(min(b for _, b in counts), max(b for _, b in counts) + 2)
        ones_below, zeros_above = 0, sum(n for (y, _), n in counts.items() if y == 0)
        errors = {}
        for b in at:  # errors if everything from bin b on counts as class 1
            errors[b] = ones_below + zeros_above
            ones_below += counts.get((1, b), 0)
            zeros_above -= counts.get((0, b), 0)
        least = min(errors.values())
        best = [b for b in at if errors[b] == least]
        self.threshold = (best[0] + best[-1]) / 2 / BINS_PER_UNIT


#: Bins of evidence a unit; evidence is an asinh, so of any data some hundred bins are in use.
BINS_PER_UNIT = 16


def held_out(fold: str = "doc_id", folds: int = 3, test: int = 1):
    return F.coalesce(F.crc32(F.col(fold).cast("string").cast("binary")) % folds == test, F.lit(False))


def fitted(featured: DataFrame, labels: DataFrame) -> Discriminant:
    """Fit on every labelled row outside the held-out fold. Rows whose label is null or not 0 or 1 are left out."""
    known = labels.where("quality in (0, 1)").where(~held_out()).select(F.col("doc_id").alias("__id"), F.col("quality").cast("int").alias("y"))
    rows = featured.join(known, F.col("doc_id") == F.col("__id")).select("y", "x")
    rows = written(rows, "quality-learned")
    sums = rows.mapInArrow(_moments, "y int, m array<double>").select("y", F.posexplode("m").alias("i", "v")).groupBy("y", "i").agg(F.sum("v").alias("v"))
    moments: dict[int, dict[int, float]] = {}
    for y, i, v in sums.collect():  # two classes of 1 + d + d * d numbers
        moments.setdefault(y, {})[i] = v
    model = Discriminant({y: np.array([v for _, v in sorted(m.items())]) for y, m in moments.items()})
    if set(model.classes) != {0, 1}:
        return model

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([b.column("y"), pa.array(np.floor(model.evidence(x) * BINS_PER_UNIT).astype(np.int64))], names=["y", "bin"])

    counts = rows.mapInArrow(bins, "y int, bin long").groupBy("y", "bin").count().collect()
    model.calibrate({(y, b): n for y, b, n in counts})
    return model


def accepted(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs(doc_id, text, ...) that score at least 1/2, with all their columns, whatever these are called."""
    own = {c: f"c{k}" for k, c in enumerate(docs.columns) if c not in ("doc_id", "text")}
    featured = written(with_features(docs.withColumnsRenamed(own), ("doc_id", *own.values()), keep_text=True), "quality-features")
    kept = scored(featured, fitted(featured, labels)).where("score >= 0.5")
    return kept.drop("score").withColumnsRenamed({v: k for k, v in own.items()}).select(docs.columns)


def scored(featured: DataFrame, model: Discriminant) -> DataFrame:
    """featured(..., x) -> the other columns and score."""
    rest = [f for f in featured.schema if f.name != "x"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column("x").flatten().to_numpy(zero_copy_only=False).reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([*[b.column(f.name) for f in rest], pa.array(model.scores(x))], names=[*[f.name for f in rest], "score"])

    return featured.mapInArrow(run, ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in rest] + ["score double"]))


def classified(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs(doc_id, text), labels(doc_id, quality) -> (doc_id, held_out, score, predicted), one row for every row of docs.

    A null text counts as empty and is scored like any other; a null doc_id is scored and never learned from. An empty table gives an
    empty result. Texts are gone through once: their statistics are written, the fit and the scores read those.
    """
    featured = written(with_features(docs), "quality-features")
    out = scored(featured, fitted(featured, labels))
    return out.select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
