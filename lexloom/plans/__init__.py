"""lexloom.plans: named queries over a folder of tables."""

from . import corpus_queries, feature_queries, format_queries, registry, table_queries, text_queries, word_queries  # noqa: F401
