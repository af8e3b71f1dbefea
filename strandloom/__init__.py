"""Interval, read and sequence analytics on Spark DataFrames.

Functions that run on executors are pickled by value, so executors need the
libraries that they use but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
