"""tabprep: Spark-native preparation, profiling, testing and modelling of tables."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel by value, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
