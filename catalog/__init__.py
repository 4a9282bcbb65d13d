"""Queries over the given tables, one per operator, with oracle SQL."""

from catalog import analysis_queries, cleaning_queries, profile_queries, quality_queries, report_queries

MODULES = (analysis_queries, profile_queries, quality_queries, cleaning_queries, report_queries)
