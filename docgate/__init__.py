"""docgate: a Spark-native document quality and delivery engine."""

import sys

from pyspark import cloudpickle

# Functions shipped to executors travel by value, so a worker needs no copy of this package on its path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
