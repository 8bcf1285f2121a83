"""Queries and SQL of the training-data operators, for registration."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .byte_bpe import op7_byte_bpe
from .chat_format import OP6_SQL, op6_chat_blocks
from .filter_audit import OP11_SQL, op11_filter_audit
from .language_id import op1_language_id
from .line_dedup import OP9_SQL, op9_line_windows
from .media import op4_jpeg_media
from .merkle import OP12_SQL, op12_merkle_manifest
from .mixing import OP10_SQL, op10_poisson_mix
from .sharding import op2_histogram_shards
from .simhash import op3_simhash_components
from .substring_dedup import OP13_SQL, op13_substring_dedup
from .top_k import OP8_SQL, op8_norm_buckets
from .toxicity import op5_toxicity

OPERATORS = (
    op1_language_id, op2_histogram_shards, op3_simhash_components, op4_jpeg_media, op5_toxicity,
    op6_chat_blocks, op7_byte_bpe, op8_norm_buckets, op9_line_windows, op10_poisson_mix,
    op11_filter_audit, op12_merkle_manifest, op13_substring_dedup,
)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in OPERATORS}
ORACLE_SQL: dict[str, str] = {
    "op6_chat_blocks": OP6_SQL, "op8_norm_buckets": OP8_SQL, "op9_line_windows": OP9_SQL, "op10_poisson_mix": OP10_SQL,
    "op11_filter_audit": OP11_SQL, "op12_merkle_manifest": OP12_SQL, "op13_substring_dedup": OP13_SQL,
}
