"""Schemas of the engine's relations, and the dimension of embedding providers."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

FUNCTIONS = "ord bigint, file string, name string, kind string, start_line int, end_line int, loc int, hash string, text string, text_for_embedding string, text_hash string, ast_text string, docstring string"
CACHE = "cache_key string, content_hash string, vec array<float>"
HASHES = "file string, name string, start_line int, hash string, text_hash string"
DIAGNOSTICS = "tool string, file string, line int, col int, code string, message string, severity string"
BASELINE = "kind string, path array<string>, value double"


@dataclass(frozen=True)
class Provider:
    name: str
    hash_type: str
    pair: float | None
    neighbour: float | None
    kind: str
    pca_variance: float = 0.99

    @property
    def hash_column(self) -> str:
        return "text_hash" if self.hash_type == "TEXT" else "hash"

    @property
    def cache(self) -> str:
        return f"{self.name}_embeddings"


def _cosine(family: str, pair: float, neighbour: float) -> list[Provider]:
    return [Provider(f"{family}_{h.lower()}", h, pair, neighbour, "cosine") for h in ("TEXT", "AST")]


PROVIDERS: list[Provider] = [
    *_cosine("openai", 0.86, 0.80),
    *_cosine("codestral", 0.97, 0.93),
    *_cosine("voyage", 0.95, 0.90),
    *_cosine("gemini", 0.90, 0.85),
    *_cosine("qwen", 0.90, 0.85),
    *[Provider(f"jina_{h.lower()}_{side}", h, None, None, "member") for h in ("TEXT", "AST") for side in ("query", "passage")],
    Provider("combined", "TEXT", 0.88, 0.82, "derived"),
    *[Provider(f"jina_{h.lower()}", h, 0.90, 0.85, "symmetrized") for h in ("TEXT", "AST")],
]
#: what the combined vector is made of, in order
MEMBERS = [p.name for p in PROVIDERS if p.kind in ("cosine", "member")]
#: tokens, seconds and texts that one request may have
LIMITS = {"openai": (8191, 30, 2048), "codestral": (8000, 120, 128), "voyage": (31000, 120, 128), "gemini": (2000, 120, 100), "qwen": (32000, 120, 32), "jina": (512, 120, 32)}
DEFAULT_PAIR, DEFAULT_NEIGHBOUR, DEFAULT_REFACTOR = 0.86, 0.80, 12.0


def providers(spark: SparkSession) -> DataFrame:
    rows = [(p.name, p.cache, p.hash_type, p.pair, p.neighbour, p.kind, p.pca_variance) for p in PROVIDERS]
    return spark.createDataFrame(rows, "name string, cache string, hash_type string, pair double, neighbour double, kind string, pca_variance double")


def threshold(config: dict[str, float], provider: str, which: str) -> float:
    """Of a provider's own setting, the general one and the provider's default, the first that is there."""
    default = next((getattr(p, which) for p in PROVIDERS if p.name == provider), None)
    for key in (f"{provider}_similarity_threshold_{which}", f"similarity_threshold_{which}"):
        if key in config:
            return float(config[key])
    return default if default is not None else (DEFAULT_PAIR if which == "pair" else DEFAULT_NEIGHBOUR)
