"""A PySpark-native engine for pipe queries over tables, JSON, graphs and time series."""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# Functions that run in Python workers travel by value, so a worker needs no copy of the package.
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
