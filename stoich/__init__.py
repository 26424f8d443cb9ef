"""stoich: composition and corpus analytics as lazy Spark DataFrame operators.

Every operator takes DataFrames (plus plain parameters) and returns a lazy
DataFrame.  Work runs in Spark SQL expressions first, ``pyspark.ml`` second,
and Arrow batches (``mapInPandas`` / ``applyInPandas``) only where no
expression exists.
"""

__version__ = "0.1.0"
