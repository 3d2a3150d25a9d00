"""Configuration: defaults, overridden by spark.conf entries named tessera.<field>."""

from __future__ import annotations

from dataclasses import dataclass, fields, replace

from pyspark.sql import SparkSession


@dataclass(frozen=True)
class Settings:
    chunk_size: int = 1000
    chunk_tolerance: int = 80
    table_tolerance: int = 300
    vector_top_k: int = 15
    bm25_top_k: int = 15
    fusion_top_k: int = 30
    rerank_min: int = 5
    rerank_max: int = 10
    rerank_ratio: float = 0.85
    rrf_k: int = 60
    bm25_k1: float = 1.5
    bm25_b: float = 0.75
    cache_threshold: float = 0.93
    cache_recent: int = 1000
    dictionary_coverage: float = 0.5

    @classmethod
    def load(cls, spark: SparkSession, required: tuple[str, ...] = ()) -> Settings:
        """Values of spark.conf over the defaults; a missing required entry raises ValueError."""
        got = {f.name: v for f in fields(cls) if (v := spark.conf.get(f"tessera.{f.name}", None)) is not None}
        missing = [k for k in required if spark.conf.get(f"tessera.{k}", None) is None]
        if missing:
            raise ValueError(f"missing settings: {', '.join(missing)}")
        base = cls()
        return replace(base, **{k: type(getattr(base, k))(v) for k, v in got.items()})
