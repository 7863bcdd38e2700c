"""Explicit schemas; nothing in this package infers one."""

SEARCH_QUERY_DDL = """
  terms array<struct<id: string, value: string, operator: string, exact: boolean>>,
  sources array<string>, countries array<string>, languages array<string>,
  sentiments array<string>, dateRange string, dateFrom string, dateTo string
"""

ALERT_CONDITIONS_DDL = """
  keywords array<string>, sentiments array<string>, sources array<string>, countries array<string>
"""

RUN_METADATA_DDL = "sources array<struct<source: string, count: bigint, error: string>>, elapsed_seconds string"

SCORE_DDL = """
  id string, relevance_score double, relevance_label string, relevance_reason string,
  sentiment string, sentiment_score double, key_themes array<string>
"""

