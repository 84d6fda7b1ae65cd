"""Embedding sources: the stable hash embedding as an expression, services through a provider in Arrow batches."""

from __future__ import annotations

import json
import urllib.request
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from typing import Protocol

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphweft.functions import text, vector


#: Provider, model and schema version of the hash embedding (fixed values).
HASH_EMBEDDING = ("hash", "deterministic-hash", "v1")


class Provider(Protocol):
    """Turns texts into vectors; pickled to the workers, so it must not hold connections."""

    name: str
    model: str
    schema_version: str

    def embed(self, texts: list[str]) -> list[list[float]]: ...


def hash_vector(c: Column) -> Column:
    return vector.hash_embedding(text.hash_tokens(c))


def embed_nodes_hashed(nodes: DataFrame, keep_empty: bool = False) -> DataFrame:
    """Embedding columns of the eligible kinds by the hash embedding; others get nulls. No Python worker."""
    eligible = F.col("kind").isin(*text.EMBEDDABLE)
    source = text.embedding_text_keeping_empty() if keep_empty else text.embedding_text()
    out = nodes.withColumn("embedding_text", F.when(eligible, source))
    fixed = dict(zip(("embedding_provider", "embedding_model", "embedding_schema_version"), HASH_EMBEDDING, strict=True))
    return out.withColumns({"embedding": F.when(eligible, hash_vector(F.col("embedding_text"))), "embedding_dimensions": F.when(eligible, F.lit(vector.DIMENSIONS)), **{k: F.when(eligible, F.lit(v)) for k, v in fixed.items()}})


def embed_with(nodes: DataFrame, provider: Provider, batch: int = 64) -> DataFrame:
    """``node_id, embedding, embedding_text`` of the eligible nodes through a provider, ``batch`` texts a call."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, batch):
                part = b.slice(at, batch)
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(provider.embed(part.column(1).to_pylist()), pa.list_(pa.float64())), part.column(1)], ["node_id", "embedding", "embedding_text"])

    rows = nodes.where(F.col("kind").isin(*text.EMBEDDABLE)).select("node_id", text.embedding_text().alias("t"))
    return rows.mapInArrow(run, "node_id string, embedding array<double>, embedding_text string")


def _post(url: str, body: dict, headers: dict[str, str], timeout: float) -> dict:
    request = urllib.request.Request(url, json.dumps(body).encode(), {"Content-Type": "application/json", **headers})
    with urllib.request.urlopen(request, timeout=timeout) as answer:
        return json.load(answer)


@dataclass
class HttpProvider:
    """A service: where to post, how to say a text, where the vector stands in the answer."""

    name: str
    model: str
    url: str
    body: Callable[[str, str], dict]
    read: Callable[[dict], list[float]]
    headers: dict[str, str] = field(default_factory=dict)
    timeout: float = 30.0
    schema_version: str = "v1"
    post: Callable[..., dict] = _post

    def embed(self, texts: list[str]) -> list[list[float]]:
        return [[float(x) for x in self.read(self.post(self.url.rstrip("/"), self.body(self.model, t), self.headers, self.timeout))] for t in texts]


def provider(kind: str, *, url: str = "", model: str = "", key: str = "") -> HttpProvider:
    """The three kinds of services: ``local`` (model and input), ``data`` (bearer key) and ``content`` (key header)."""
    if kind in ("data", "content") and not key:
        raise ValueError("this provider needs a key")
    if kind == "local":
        return HttpProvider(kind, model, f"{url.rstrip('/')}/api/embed", lambda m, t: {"model": m, "input": t}, lambda a: a["embeddings"][0])
    if kind == "data":
        return HttpProvider(kind, model, f"{url.rstrip('/')}/v1/embeddings", lambda m, t: {"model": m, "input": t}, lambda a: a["data"][0]["embedding"], {"Authorization": f"Bearer {key}"})
    if kind == "content":
        return HttpProvider(kind, model, f"{url.rstrip('/')}/models/{model}:embedContent", lambda m, t: {"model": f"models/{m}", "content": {"parts": [{"text": t}]}}, lambda a: a["embedding"]["values"], {"x-goog-api-key": key})
    raise ValueError(f"unknown provider {kind}")
