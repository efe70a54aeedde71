"""Contracts of models, and deterministic stand-ins that are no substitute for one and say so in their key."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

#: What texts are prefixed with by task; fixed values.
PREFIXES = {"document": "search_document: ", "query": "search_query: "}
BATCH = 16


class Embedder(Protocol):
    key: str

    def embed(self, texts: list[str]) -> np.ndarray: ...


class CrossEncoder(Protocol):
    def predict(self, query: str, passages: list[str]) -> list[float]: ...


class HashedWords:
    """Stand-in embedder: signed hashed counts of words, normalised."""

    def __init__(self, dimension: int = 64):
        self.dimension, self.key = dimension, f"stand-in/{dimension}"

    def embed(self, texts: list[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.dimension), np.float64)
        for row, text in enumerate(texts):
            for word in text.lower().split():
                h = 2166136261
                for byte in word.encode():
                    h = (h ^ byte) * 16777619 & 0xFFFFFFFF
                out[row, h % self.dimension] += 1.0 if h >> 31 else -1.0
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return np.where(norm > 0, out / np.where(norm > 0, norm, 1), 0).astype(np.float32)


def embedded(rows: DataFrame, make: Callable[[], Embedder], *, key: str, id_col: str, text_col: str, task: str = "document") -> DataFrame:
    """(id, embedding, embedding_model): the model is made once a task, texts go in small batches, counts are checked."""
    kind = rows.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for pdf in batches:
            vectors = []
            for at in range(0, len(pdf), BATCH):
                texts = [PREFIXES[task] + (t or "") for t in pdf[text_col].iloc[at : at + BATCH]]
                got = model.embed(texts)
                if len(got) != len(texts):
                    raise ValueError("a model must return one vector per text")
                vectors += [v.tolist() for v in got]
            yield pd.DataFrame({id_col: pdf[id_col], "embedding": vectors, "embedding_model": key})

    return rows.select(id_col, text_col).mapInPandas(run, f"{id_col} {kind}, embedding array<float>, embedding_model string")


def cross_encoded(pairs: DataFrame, make: Callable[[], CrossEncoder], query: str, *, id_col: str = "chunk_id", text_col: str = "content") -> DataFrame:
    """(id, relevance): scores of a cross-encoder, which must be finite and in [0, 1]."""
    kind = pairs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = make()
        for pdf in batches:
            scores = np.asarray(model.predict(query, pdf[text_col].tolist()), np.float64)
            if len(scores) != len(pdf) or not (np.isfinite(scores) & (scores >= 0) & (scores <= 1)).all():
                raise ValueError("relevance must be one finite number in [0, 1] per passage")
            yield pd.DataFrame({id_col: pdf[id_col], "relevance": scores})

    return pairs.select(id_col, text_col).mapInPandas(run, f"{id_col} {kind}, relevance double")


class RemoteEmbedder:
    """Embeddings over HTTP from a server with the common ``/embeddings`` shape; answers are put in the order of the texts."""

    def __init__(self, base_url: str, model: str, api_key: str = "", timeout: float = 60.0):
        self.base_url, self.model, self.api_key, self.timeout = base_url.rstrip("/"), model, api_key, timeout
        self.key = f"remote/{model}"

    def embed(self, texts: list[str]) -> np.ndarray:
        import json
        from urllib.request import Request, urlopen

        headers = {"Content-Type": "application/json"} | ({"Authorization": f"Bearer {self.api_key}"} if self.api_key else {})
        body = json.dumps({"model": self.model, "input": texts}).encode()
        with urlopen(Request(f"{self.base_url}/embeddings", body, headers), timeout=self.timeout) as answer:
            data = sorted(json.load(answer)["data"], key=lambda x: x["index"])
        if len(data) != len(texts):
            raise ValueError("a model must return one vector per text")
        out = np.array([x["embedding"] for x in data], np.float32)
        norm = np.linalg.norm(out, axis=1, keepdims=True)
        return out / np.where(norm > 0, norm, 1)
