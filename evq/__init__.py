"""Weighted-event analytics as Spark DataFrame transformations.

``evq.sources``    readers, file-name classification, sinks
``evq.functions``  column expressions and driver-side helpers (no Spark job of their own)
``evq.operators``  DataFrame-in / DataFrame-out operators
``evq.plans``      the registered queries and their SQL counterparts
"""

from evq import config

__all__ = ["config"]
