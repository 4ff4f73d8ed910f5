"""A Spark-native analytics library for sequence and embedding studies."""

import sys

from pyspark import cloudpickle

# Functions travel to the executors by value: a cluster needs no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
