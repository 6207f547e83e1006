"""Trajectory map matching and analytics, written as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors with their code, so that they need not have it installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
