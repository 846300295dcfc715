"""docquill: corpus annotation on Spark.

Select text records by path and pattern, extract named units, shrink texts
to a token budget, prompt a user-supplied model in Arrow batches, clean the
answers and apply them as edits, in batch or as a stream. See the README for
the operator inventory and ``docquill.plans.commands`` for the high-level
``find``/``generate``/``pos``/``minify`` calls.
"""

__version__ = "0.1.0"
