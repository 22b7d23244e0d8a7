"""ripplekit — event-effect analytics expressed as Spark DataFrame jobs.

Layers (see README):
  sources/    table scans, file readers, fixture views
  functions/  column-expression helpers (text, dates, geo)
  operators/  filters, joins, aggregates, windows, reshaping, sampling, corpus jobs
  estimators/ Gram-based linear estimators, IV, propensity, synthetic control, ML
  plans/      registered query plans and their SQL oracles
  streaming/  incremental variants of the daily aggregates
"""

__version__ = "0.1.0"
