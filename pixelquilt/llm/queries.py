"""All queries of the subpackage, for the driver contract."""

from pixelquilt.llm import bpe, chunk_dedup, classifier, filter_audit, hard_negatives, jaccard_join, near_vectors, packing, pii, quality_rules, token_counts, token_files, top_k  # noqa: F401
from pixelquilt.llm.registry import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
