"""shelfscope: retail-offer and news analytics as Spark DataFrame jobs.

Subpackages:
  functions  - Column-level helpers and fixed rule tables
  sources    - readers/parsers (driver tables, page JSON, HTML cards, feed XML,
               legacy JSON maps, social API JSON) and sinks
  operators  - DataFrame -> DataFrame jobs (radar, selection, news, ...)
  plans      - the registered query catalogue and its DuckDB oracle SQL
  streaming  - Structured Streaming variants of the batch jobs
"""

from shelfscope.session import get_spark, checkpoint_dir  # noqa: F401
