"""rankweave: long-document dense retrieval as lazy Spark DataFrame operators.

Sub-packages:
  functions  - column expressions (vector arithmetic) and Arrow helpers
  sources    - file readers/writers and the fixture views over the driver tables
  operators  - passages, pooling, search, rerank, metrics, analysis, training, embed, partitioning
  plans      - the end-to-end chains and the query catalogue used by __spark_entry__
  streaming  - the stateless passage split on a streaming DataFrame
"""

__version__ = "0.1.0"


def _pickle_by_value() -> None:
    """Functions of this package that run inside Spark tasks (mapInArrow,
    applyInPandas) are serialised by value, so executors need not have the
    package installed or on their path."""
    try:
        from pyspark import cloudpickle
    except ImportError:  # pragma: no cover
        return
    import sys
    cloudpickle.register_pickle_by_value(sys.modules[__name__])


_pickle_by_value()
