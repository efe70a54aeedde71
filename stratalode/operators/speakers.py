"""Speakers of a recording: average-linkage clustering of segment vectors, centroids, assignment. One recording a group."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: Similarity below which clusters stay apart, shortest segments to embed and to cluster, most segments clustered.
MERGE_AT, EMBED_MS, CLUSTER_MS, MOST, SPEAKER_MS, CROP_MS = 0.45, 500, 1500, 500, 40_000, 10_000


def clustered(vectors: np.ndarray, merge_at: float = MERGE_AT) -> np.ndarray:
    """Labels by average linkage: the most similar pair merges into its earlier member while similarity lasts."""
    n = len(vectors)
    similar = vectors.astype(np.float64) @ vectors.astype(np.float64).T
    similar[np.tril_indices(n)] = -np.inf
    full = np.where(np.isfinite(similar), similar, similar.T)
    sizes, labels = np.ones(n), np.arange(n)
    while n > 1:
        at = int(np.argmax(similar))
        i, j = divmod(at, n)
        if not similar[i, j] >= merge_at:
            break
        mean = (sizes[i] * full[i] + sizes[j] * full[j]) / (sizes[i] + sizes[j])
        full[i, :], full[:, i] = mean, mean
        sizes[i] += sizes[j]
        labels[labels == j] = i
        similar[j, :], similar[:, j] = -np.inf, -np.inf
        alive = np.isfinite(similar[i]) | np.isfinite(similar[:, i])
        similar[i, i + 1 :] = np.where(alive[i + 1 :], mean[i + 1 :], -np.inf)
        similar[:i, i] = np.where(alive[:i], mean[:i], -np.inf)
    return labels


def centroids(vectors: np.ndarray, durations: np.ndarray) -> np.ndarray:
    """Unit centroids of the clusters that speak long enough, of an even sample of the longer segments."""
    long = np.flatnonzero(durations >= CLUSTER_MS)
    if len(long) < 2:
        return np.zeros((0, vectors.shape[1]))
    count = min(len(long), MOST)
    step = len(long) / count
    sample = long[np.floor(np.arange(count) * step).astype(int)]
    labels = clustered(vectors[sample])
    least = min(SPEAKER_MS / step, 0.1 * durations[sample].sum())
    out = []
    for label in dict.fromkeys(labels.tolist()):
        members = sample[labels == label]
        if durations[members].sum() >= least:
            total = vectors[members].astype(np.float64).sum(axis=0)
            out.append(total / (np.linalg.norm(total) or 1.0))
    return np.array(out).reshape(-1, vectors.shape[1])


def labelled(pdf: pd.DataFrame) -> pd.DataFrame:
    """Speaker numbers of one recording's segments (pos, start_ms, end_ms, embedding); null if fewer than two speak."""
    pdf = pdf.sort_values("pos").reset_index(drop=True)
    pdf["speaker"] = pd.array([None] * len(pdf), dtype="Int64")
    durations = (pdf["end_ms"] - pdf["start_ms"]).to_numpy()
    usable = np.flatnonzero((durations >= EMBED_MS) & pdf["embedding"].notna().to_numpy())
    if len(pdf) < 2 or len(usable) == 0:
        return pdf
    vectors = np.stack([np.asarray(pdf["embedding"][i], np.float32) for i in usable])
    centers = centroids(vectors, durations[usable])
    if len(centers) < 2:
        return pdf
    nearest = dict(zip(usable.tolist(), (vectors.astype(np.float64) @ centers.T).argmax(axis=1).tolist(), strict=True))
    current, numbers, out = nearest[int(usable[0])], {}, []
    for i in range(len(pdf)):
        current = nearest.get(i, current)
        out.append(numbers.setdefault(current, len(numbers) + 1))
    if len(numbers) > 1:
        pdf["speaker"] = pd.array(out, dtype="Int64")
    return pdf


def label_speakers(segments: DataFrame, *, by: str = "recording") -> DataFrame:
    """``segments`` with ``speaker``, each recording on its own; a recording is at most two hours of segments."""
    names = [*segments.columns, "speaker"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in segments.schema) + ", speaker long"

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        return labelled(pdf)[names]

    return segments.groupBy(by).applyInPandas(run, schema)


def crop(start_ms: int, end_ms: int) -> tuple[int, int] | None:
    """The middle of a segment, at most CROP_MS long; None if it is too short to embed."""
    length = end_ms - start_ms
    if length < EMBED_MS:
        return None
    cut = max(0, length - CROP_MS) / 2
    return round(start_ms + cut), round(end_ms - cut)
