"""skyrisk: asteroid close-approach analytics as composable PySpark DataFrame operators.

Layout
------
sources/    fact-table adapters, feed flattening, table sinks, model registry
functions/  column expressions, the chi-square tail UDF, distributed exact quantiles
operators/  explore, physics, features, risk, drift, alerts, mlops, metrics, ml
plans/      end-to-end jobs (risk, drift, training, prediction, alert, ingest)
streaming/  Structured Streaming new-id detector and feed ingest
"""

__version__ = "0.1.0"
