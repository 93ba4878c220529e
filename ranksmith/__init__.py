"""Recommendation lists from rating tables, on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# The few functions that run in Python tasks travel with the job, so executors do not
# need this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
