"""Incidence analytics on Spark: which items occur in which elements of which containers."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel by value: workers need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
