"""Spark-first analytics for long-form text."""

import sys

from pyspark import cloudpickle

# Executors may not have this package installed, so its functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
