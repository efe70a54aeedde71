"""Quality classifier: regularised quadratic discriminant analysis over document statistics.

Statistics of the whole text are counted by vectorised passes, transformed to be roughly normal (logarithms and
logits), and standardised. Each class has a mean and a covariance that is shrunk towards the pooled covariance and
its diagonal; Cholesky factors of the covariances are computed once and go to the workers. The score is the
logistic of the difference of the classes' log-densities, calibrated on the fitting rows.

The fit uses at most ``fit_rows`` labelled rows, those of smallest id hash; statistics, scores and everything else
cover every row. Ids, languages, sources and labels are no inputs of a score.

Defined cases: null or empty text has all counts zero and gets the score of such a text; rows without a label are
scored only; a label outside 0 and 1 or null is no label; repeated labels of an id all count; repeated documents
are scored alike; without labelled rows of both classes every score is the share of label 1 (0.5 without any).
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import keys
from . import textvec as tv

#: Labelled rows that a fit uses at most.
FIT_ROWS = 50_000
#: A score from here on predicts label 1.
THRESHOLD = 0.3
FOLDS = 5


def _mask(characters: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(characters)] = True
    return out


_UPPER, _DIGIT = _mask(bytes(range(65, 91))), _mask(bytes(range(48, 58)))
_STOP, _COMMA, _SHOUT, _PIPE, _SYMBOL = _mask(b"."), _mask(b",;:"), _mask(b"!?"), _mask(b"|"), _mask(b"#*$%&<>@~^=+_{}[]\\/")
_WIDE = np.arange(256) >= 128
NAMES = ("words", "word_bytes", "word_spread", "short", "upper", "digit", "stop", "comma", "shout", "pipe", "symbol", "wide", "distinct", "adjacent", "repeats", "line_words", "dup_lines")


def _per(texts: tv.Texts, table: np.ndarray) -> np.ndarray:
    sums = np.concatenate([[0], np.cumsum(table[texts.data])])
    return sums[texts.offsets[1:]] - sums[texts.offsets[:-1]]


def _distinct(document: np.ndarray, hashes: np.ndarray, n: int) -> np.ndarray:
    order = np.lexsort((hashes, document))
    d, h = document[order], hashes[order]
    new = np.ones(len(d), bool)
    new[1:] = (d[1:] != d[:-1]) | (h[1:] != h[:-1])
    return np.bincount(d[new], minlength=n)


def statistics(texts: tv.Texts) -> np.ndarray:
    """One row of transformed statistics per document."""
    n = len(texts)
    starts, ends, first = tv.words(texts)
    length = (ends - starts).astype(np.float64)
    words = np.diff(first).astype(np.float64)
    document = np.repeat(np.arange(n), np.diff(first))
    total = np.bincount(document, length, n)
    square = np.bincount(document, length**2, n)
    hashes = tv.span_hashes(texts.data, starts, ends)
    adjacent = np.zeros(len(hashes), bool)
    adjacent[1:] = (hashes[1:] == hashes[:-1]) & (document[1:] == document[:-1])
    triples = tv.windows(hashes, 3)
    inside = document[2:] == document[:-2] if len(hashes) > 2 else np.zeros(0, bool)
    n_triples = np.maximum(words - 2, 0)
    lines = tv.Texts(texts.data, texts.offsets)
    line_starts, line_ends, line_first = tv.words(lines, _mask(b"\n"))
    line_document = np.repeat(np.arange(n), np.diff(line_first))
    n_lines = np.diff(line_first).astype(np.float64)
    distinct_lines = _distinct(line_document, tv.span_hashes(texts.data, line_starts, line_ends), n)
    w, c = np.maximum(words, 1), np.maximum(total, 1)
    mean = total / w
    share = lambda x, of: np.log((x + 0.5) / (np.maximum(of - x, 0) + of * 0.02 + 0.5))
    return np.stack(
        [
            np.log1p(words), np.log1p(mean), np.log1p(np.sqrt(np.maximum(square / w - mean**2, 0))), share(np.bincount(document, length <= 3, n), w),
            share(_per(texts, _UPPER), c), share(_per(texts, _DIGIT), c), share(_per(texts, _STOP), w), share(_per(texts, _COMMA), w), share(_per(texts, _SHOUT), w), share(_per(texts, _PIPE), w), share(_per(texts, _SYMBOL), w), share(_per(texts, _WIDE), c),
            np.log((_distinct(document, hashes, n) + 1) / (words + 1)), share(np.bincount(document, adjacent, n), w), np.log((_distinct(document[: len(triples)][inside], triples[inside], n) + 1) / (n_triples + 1)),
            np.log1p(words / np.maximum(n_lines, 1)), share(n_lines - distinct_lines, np.maximum(n_lines, 1)),
        ],
        axis=1,
    )


@dataclass
class Discriminant:
    """Fitted model; ``inverse`` holds inverse Cholesky factors, class 0 first."""

    center: np.ndarray
    scale: np.ndarray
    means: np.ndarray
    inverse: np.ndarray
    log_det: np.ndarray
    slope: float
    intercept: float
    constant: float | None = None

    @staticmethod
    def fit(x: np.ndarray, y: np.ndarray, shrinkage: float = 0.1, to_diagonal: float = 0.1, floor: float = 0.05) -> "Discriminant":
        share = float(y.mean()) if len(y) else 0.5
        width = len(NAMES)
        if len(y) == 0 or share in (0.0, 1.0):
            zero = np.zeros(width)
            return Discriminant(zero, zero + 1, np.zeros((2, width)), np.stack([np.eye(width)] * 2), np.zeros(2), 1.0, 0.0, share)
        center, scale = x.mean(axis=0), np.maximum(x.std(axis=0), 1e-3)
        z = (x - center) / scale
        parts = [z[y == k] for k in (0, 1)]
        means = np.stack([p.mean(axis=0) for p in parts])
        scatter = [(p - m).T @ (p - m) for p, m in zip(parts, means, strict=True)]
        pooled = sum(scatter) / len(y)
        inverse, log_det = [], []
        for p, s in zip(parts, scatter, strict=True):
            # Few rows lean on the pooled covariance, many on their own.
            own = shrinkage + (1 - shrinkage) * width / (width + len(p))
            cov = (1 - own) * s / len(p) + own * pooled
            cov = (1 - to_diagonal) * cov + to_diagonal * np.diag(np.diag(cov)) + floor * np.eye(width)
            factor = np.linalg.cholesky(cov)
            inverse.append(np.linalg.inv(factor))
            log_det.append(2 * np.log(np.diag(factor)).sum())
        model = Discriminant(center, scale, means, np.stack(inverse), np.array(log_det), 1.0, 0.0)
        margin = model.margin(x)
        # Calibration: logistic regression of the label on the damped margin, a little ridge on the slope.
        slope, intercept = 1.0, 0.0
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(slope * margin + intercept, -30, 30)))
            v = np.maximum(p * (1 - p), 1e-9)
            g = np.array([margin @ (y - p) - 0.1 * (slope - 1), (y - p).sum()])
            h = np.array([[v @ margin**2 + 0.1, v @ margin], [v @ margin, v.sum() + 1e-6]])
            step = np.linalg.solve(h, g)
            slope, intercept = slope + float(step[0]), intercept + float(step[1])
            if np.abs(step).max() < 1e-8:
                break
        model.slope, model.intercept = max(slope, 1e-3), intercept
        return model

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Damped difference of the log-densities of class 1 and class 0: signed logarithm, so that far tails stay finite and ordered."""
        z = (x - self.center) / self.scale
        density = [-0.5 * (((z - m) @ inv.T) ** 2).sum(axis=1) - 0.5 * d for m, inv, d in zip(self.means, self.inverse, self.log_det, strict=True)]
        difference = density[1] - density[0]
        return np.sign(difference) * np.log1p(np.abs(difference))

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.constant is not None:
            return np.full(len(x), self.constant)
        return 1 / (1 + np.exp(-np.clip(self.slope * self.margin(x) + self.intercept, -30, 30)))


def with_statistics(documents: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, x): transformed statistics of every row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, texts in tv.slices(batch.column(1)):
                x = statistics(texts)
                values = pa.FixedSizeListArray.from_arrays(pa.array(x.reshape(-1)), x.shape[1]).cast(pa.list_(pa.float64()))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(texts)), values], names=["id", "x"])

    return documents.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "id long, x array<double>")


def held_out(identity: Column) -> Column:
    return F.coalesce(F.crc32(identity.cast("string").cast("binary")) % FOLDS == 0, F.lit(False))


def fit(features: DataFrame, labels: DataFrame, *, label_id: str, label_col: str, fit_rows: int = FIT_ROWS) -> Discriminant:
    """Fit on the labelled rows outside the held-out fold, at most ``fit_rows`` of them by id hash."""
    known = labels.select(F.col(label_id).cast("long").alias("id"), F.col(label_col).cast("int").alias("y")).filter("y in (0, 1)").filter(~held_out(F.col("id")))
    sample = known.orderBy(F.xxhash64("id"), "id", "y").limit(fit_rows)
    rows = features.join(sample, "id").select("x", "y").toPandas()
    return Discriminant.fit(np.array(rows["x"].tolist()).reshape(-1, len(NAMES)), rows["y"].to_numpy(dtype=np.float64))


def quality_scores(spark: SparkSession, documents: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "quality", threshold: float = THRESHOLD, fit_rows: int = FIT_ROWS) -> DataFrame:
    """One row per document row: id, held_out, score, predicted."""
    features = keys.stored(spark, with_statistics(documents, id_col, text_col))
    model = spark.sparkContext.broadcast(fit(features, labels, label_id=label_id, label_col=label_col, fit_rows=fit_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, len(NAMES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.value.score(x))], names=["id", "score"])

    scored = features.mapInArrow(run, "id long, score double")
    return scored.select("id", held_out(F.col("id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents, labels = (spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("documents", "labels"))
    return quality_scores(spark, documents, labels).withColumnRenamed("id", "doc_id")
