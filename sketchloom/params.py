"""Parameters of the sketch pipeline."""

from __future__ import annotations

from dataclasses import dataclass


@dataclass(frozen=True)
class Params:
    k: int = 21
    base_scaled: int = 20
    embed_scaled: int = 50
    bin_bp: int = 100_000
    pairwise_bin_bp: int = 1_000_000
    min_df: int = 2
    svd_dims: int = 128
    umap_neighbors: int = 30
    umap_min_dist: float = 0.08
    min_cluster_size: int = 25
    min_samples: int = 10
    seed: int = 42
    exclude: tuple[str, ...] = ("chrM",)

    def __post_init__(self) -> None:
        if not 4 <= self.k <= 31:
            raise ValueError("k must lie in 4 .. 31")
        if self.embed_scaled < self.base_scaled:
            raise ValueError("embed_scaled is finer than the store's base_scaled")
