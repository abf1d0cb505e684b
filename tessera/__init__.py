"""tessera: a Spark-first tabular analytics engine.

Every operator is a plain function over DataFrames and Columns, so Catalyst
sees the whole plan.  Sub-packages: ``operators`` (relational operators),
``functions`` (column-level coercion, parsing and formatting), ``sources``
(CSV, Parquet and spreadsheet input/output), ``plans`` (schemas, field
selection, registered queries) and ``streaming``.
"""

__version__ = "0.1.0"
