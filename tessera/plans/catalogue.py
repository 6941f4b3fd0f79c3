"""All catalogue queries and their SQL twins."""

from tessera.plans import aggregate_queries, code_queries, finding_queries, flow_queries, graph_queries, import_queries, join_queries, relation_queries, rule_queries, schema_queries, similarity_queries, slice_queries, source_queries, structure_queries, taint_queries, text_queries  # noqa: F401  (they register themselves)
from tessera.plans.registry import oracle_sql, queries

__all__ = ["oracle_sql", "queries"]
