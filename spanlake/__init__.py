"""spanlake: Spark analytics for model-call telemetry.

Subpackages: ``sources`` (table scans, JSON events, fact table, price catalog),
``functions`` (column expressions), ``operators`` (``DataFrame -> DataFrame``
operators), ``streaming`` (Structured Streaming jobs), ``plans`` (registered
queries and their SQL twins).  ``session`` holds session settings and the
shared checkpoint folder.
"""

__version__ = "0.1.0"
