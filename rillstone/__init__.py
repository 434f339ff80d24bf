"""Stream analytics on Spark DataFrames: variable tolling, call scoring, filter chains and run statistics."""

import sys

from pyspark import cloudpickle

# Functions and processors of this package travel to Python workers by value: executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
