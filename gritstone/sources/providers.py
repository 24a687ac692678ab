"""Embedding providers: a protocol, a registry, batching with retries, and one provider that needs no network."""

from __future__ import annotations

import time
import warnings
from collections.abc import Callable, Iterator
from importlib.metadata import entry_points
from typing import Protocol, runtime_checkable

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ATTEMPTS, DELAYS = 3, (1.0, 2.0, 4.0)


@runtime_checkable
class Provider(Protocol):
    name: str
    model_id: str
    schema_version: str
    max_tokens: int
    batch_size: int

    def embed(self, texts: list[str]) -> list[list[float]]: ...

    def is_configured(self) -> bool: ...


class HashingProvider:
    """Signed hashed words, normalised: the same vector for the same text everywhere, without a model."""

    name, model_id, schema_version, max_tokens, batch_size = "hashing", "hashing-64", "1", 8191, 100

    def __init__(self, dim: int = 64) -> None:
        self.dim = dim

    def is_configured(self) -> bool:
        return True

    def embed(self, texts: list[str]) -> list[list[float]]:
        out = np.zeros((len(texts), self.dim))
        for i, text in enumerate(texts):
            for word in text.lower().split():
                h = xxhash.xxh64_intdigest(word)
                out[i, h % self.dim] += 1 if h >> 63 else -1
        n = np.linalg.norm(out, axis=1, keepdims=True)
        return (out / np.where(n > 0, n, 1)).tolist()


class Registry:
    """Providers by name; the first that is registered under a name stays."""

    def __init__(self) -> None:
        self._by: dict[str, Provider] = {}

    def register(self, provider: Provider) -> None:
        self._by.setdefault(provider.name, provider)

    def discover(self, makers: list[Callable[[], Provider]]) -> None:
        """Registers what the makers give; one that fails is left out with a warning."""
        for make in makers:
            try:
                self.register(make())
            except Exception as e:  # any plugin may fail in any way
                warnings.warn(f"a provider could not be loaded: {e}", stacklevel=2)

    def discover_installed(self, group: str = "gritstone.providers") -> None:
        """Registers the providers of installed packages, by their entry points."""
        self.discover([lambda e=e: e.load()() for e in entry_points(group=group)])

    def get(self, name: str) -> Provider:
        return self._by[name]

    def names(self) -> list[str]:
        return sorted(self._by)


def truncate(text: str, limit: int, encode: Callable[[str], list[int]], decode: Callable[[list[int]], str]) -> str:
    """The first ``limit`` tokens."""
    ids = encode(text)
    return text if len(ids) <= limit else decode(ids[:limit])


def embed_batches(provider: Provider, texts: list[str], attempts: int = ATTEMPTS, delays: tuple[float, ...] = DELAYS, transient: Callable[[Exception], bool] = lambda e: True, sleep: Callable[[float], None] = time.sleep) -> list[list[float]]:
    """Vectors in the order of the texts, a request a batch; transient failures are tried again after growing delays.

    A provider with ``encode`` and ``decode`` gets at most ``max_tokens`` of a text's tokens, which is what its model can take.
    """
    if hasattr(provider, "encode") and hasattr(provider, "decode"):
        texts = [truncate(x, provider.max_tokens, provider.encode, provider.decode) for x in texts]
    out: list[list[float]] = []
    for i in range(0, len(texts), provider.batch_size):
        part = texts[i : i + provider.batch_size]
        for k in range(attempts):
            try:
                out += provider.embed(part)
                break
            except Exception as e:  # transports raise what they like
                if k + 1 == attempts or not transient(e):
                    raise
                sleep(delays[min(k, len(delays) - 1)])
    return out


def embedded(text: Column, provider: Provider) -> Column:
    """Vector of a text; null for null."""

    @F.arrow_udf("array<float>")
    def f(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for arr in batches:
            texts = arr.to_pylist()
            known = [t for t in texts if t is not None]
            found = iter(embed_batches(provider, known))
            yield pa.array([None if t is None else next(found) for t in texts], pa.list_(pa.float32()))

    return f(text)


def populate(functions: DataFrame, cache: DataFrame, provider: Provider, cache_key: str, hash_col: str, text_col: str) -> DataFrame:
    """The cache with the vectors that ``functions`` lacked: each distinct text is embedded once."""
    from gritstone.operators.cache import upsert

    own = cache.where(F.col("cache_key") == cache_key).select(F.col("content_hash").alias(hash_col))
    missing = functions.where(F.col(hash_col).isNotNull()).groupBy(hash_col).agg(F.min(text_col).alias("t")).join(own, hash_col, "left_anti")
    new = missing.select(F.lit(cache_key).alias("cache_key"), F.col(hash_col).alias("content_hash"), embedded(F.col("t"), provider).alias("vec"))
    return upsert(cache, new, ["cache_key", "content_hash"])
