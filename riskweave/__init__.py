"""Spark-native analytics for cross-domain risk correlation and corpus preparation."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel by value, so that executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
