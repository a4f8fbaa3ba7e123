"""Comparative RNA structure analysis and corpus processing on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with the job, so that a session needs no installed copy there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
