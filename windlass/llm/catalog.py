"""Importing this module registers the queries of the package."""

from windlass.llm import (  # noqa: F401
    byte_bpe, decontamination, jaccard_join, line_quality, quality_rules, shard_shuffle,
    source_audit, suffix_dedup, token_counts, toxicity, url_filters, vector_codes, warc,
)
from windlass.llm.common import ORACLES, QUERIES  # noqa: F401
