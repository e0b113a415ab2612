"""Spark-native analytics over ranked retrieval runs and collections that change in time."""

import sys

from pyspark import cloudpickle

# Functions for Python workers travel by value: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
