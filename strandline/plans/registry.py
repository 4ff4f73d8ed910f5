"""All queries of the library by name, and their DuckDB equivalents."""

from __future__ import annotations

from strandline.plans import codon_queries, direction_queries, everyday_queries, figure_queries, gapped_queries, grid_queries, numeric_queries, paired_queries, panel_queries, sequence_queries, site_queries, source_queries, vector_queries

_MODULES = [sequence_queries, vector_queries, paired_queries, panel_queries, numeric_queries, site_queries, everyday_queries, figure_queries, codon_queries, gapped_queries, source_queries, direction_queries, grid_queries]
QUERIES = {name: f for m in _MODULES for name, f in m.Q.items()}
ORACLE_SQL = {name: sql for m in _MODULES for name, sql in m.SQL.items()}
FLAGSHIP = "within_family_spearman"
