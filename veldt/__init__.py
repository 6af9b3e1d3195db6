"""veldt — Spark-native entity-by-day panel analytics.

Daily panels keyed ``(entity, day)``: source fusion onto a date spine,
rolling/lagged/seasonal features, forward event labels, data-quality
profiles, classifier evaluation and calibration, batch and streaming
scoring, read-model queries and exact budget-constrained allocation plans.
Every public function is ``DataFrame -> DataFrame`` and plans lazily.
"""

__version__ = "0.1.0"
