"""assay: data-quality checks and run-lineage analytics on Spark.

Entry points:
  assay.session.get_session                 session defaults, shared checkpoint folder
  assay.operators.checks / records           table, record and message checks
  assay.operators.suite                      rule registry, batch and record runners, dq_log
  assay.operators.catalog.rule_catalog       the catalog variants
  assay.operators.monitor / runs             monitor views, recursion, timeliness, run boundaries
  assay.operators.events                     run events: build, parse, validate, filter, shred
  assay.operators.schedule                   cron, due tasks, task queue
  assay.operators.profile                    column metrics, output statistics, schema rows
  assay.streaming.checks                     Structured Streaming checks and consumer
  assay.plans.registry                       named queries with DuckDB oracles
"""
