"""Spark-native preparation, profiling and modelling of versioned tables."""

import sys

from pyspark import cloudpickle

# Functions sent to executors travel by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
