"""Sensitive-data compliance on Spark: detect, mask, decide, clean, evaluate."""

import sys

from pyspark import cloudpickle

# Functions of this package that run in Python workers travel with the task, so executors
# need no copy of the package and the working folder does not matter.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.2.0"
