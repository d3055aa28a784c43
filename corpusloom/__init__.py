"""Spark-native operators for document corpora, scoped retrieval, catalogs and telemetry.

Every operator is a function from DataFrames (or Columns) to DataFrames (or Columns).
Operators never create a session and never collect data; rule violations come back as
reject tables next to the good rows.
"""

import sys

from pyspark import cloudpickle

# Task functions travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
