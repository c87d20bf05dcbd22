"""tranche: Spark-native analytics for tax-debt instalment agreements.

Every operator is a function ``DataFrame(s) -> DataFrame`` built from
built-in Spark expressions, so Catalyst can prune, push down and pick the
physical plan.  Nothing here triggers an action except the explicit sinks
in ``tranche.sources.store`` and the model fit in ``tranche.operators.model``.
"""

__version__ = "0.1.0"
