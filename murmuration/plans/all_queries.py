"""Importing a plan module registers its queries."""

from murmuration.plans import etl_queries, model_queries, moment_queries, text_queries, topic_queries, vocab_queries  # noqa: F401
from murmuration.plans.registry import ORACLES, QUERIES  # noqa: F401
