"""Multi-model analytics expressed as Spark DataFrame operations."""

import sys

from pyspark import cloudpickle

# Functions travel to the executors by value, so these need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
