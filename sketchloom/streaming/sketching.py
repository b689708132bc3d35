"""The sketch store as a stream: contigs arrive as rows, counts by bin and hash are kept as state."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators import sketch as K


def stream_store(contigs: DataFrame, k: int, scaled: int, bin_bp: int) -> DataFrame:
    """As operators.sketch.store over a streaming DataFrame (contig, seq); for update or complete output."""
    return K.store(K.hits(contigs, k, scaled), bin_bp)
