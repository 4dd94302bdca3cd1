"""Deep data profiling over Spark DataFrames: discovery and validation of structural patterns.

operators/ holds one module per family of patterns, plans/ what they share,
functions/ measures and column expressions, sources/ loaders and writers,
streaming/ incremental variants. llm/ is independent of all of these.
"""

from .plans.options import ConfigError

__all__ = ["ConfigError"]
