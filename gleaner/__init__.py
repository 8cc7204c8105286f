"""Gleaner: data profiling, text analysis and ranked findings on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Helpers that run inside Arrow functions travel with the job, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
