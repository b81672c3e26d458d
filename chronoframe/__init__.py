"""Timed-record analytics on Spark: plain functions from DataFrame to DataFrame."""

import sys

from pyspark import cloudpickle

# Functions of this package that run inside tasks travel with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
