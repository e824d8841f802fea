"""All queries of the numbered operators and the pipeline: importing this module registers them."""

from __future__ import annotations

import corpus_pipeline
from pathwise.llm import (  # noqa: F401
    chat, langid, manifest, mixing, ngram_join, packing, quality, secrets, sharding, spelling, topk, toxicity, urlfilter,
)
from pathwise.llm.registry import ORACLES, QUERIES, register  # noqa: F401

register("pipeline", corpus_pipeline.ORACLE_SQL)(corpus_pipeline.run)
