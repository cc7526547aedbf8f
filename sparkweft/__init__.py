"""Spark-native operators for feature files, logs, tables and vectors."""

import sys

from pyspark import cloudpickle

from sparkweft.session import build_session

# Functions sent to Python workers carry their code along, so executors need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session"]
