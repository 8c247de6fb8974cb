"""demesne: historical place, person and event analytics as Spark DataFrames.

Layers: ``sources`` (readers and writers), ``functions`` (column functions),
``operators`` (DataFrame -> DataFrame operators), ``plans`` (metric compiler,
question router, registered queries) and ``streaming``.  Training-data
operators live in the optional subpackage ``llm``, which nothing here imports.
"""

__version__ = "0.1.0"
