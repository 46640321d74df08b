"""skylag — delay analytics on Spark.

Subpackages: ``sources`` (readers, stand-in inputs), ``functions`` (column
expressions), ``operators`` (DataFrame operators: cleaning, features,
statistics, lookups, encoding, metrics, models, search, sessions),
``plans`` (registered queries and their SQL oracles), ``streaming``
(Structured Streaming jobs).
"""

__version__ = "0.1.0"
