"""A Spark-native engine: text join queries, snapshot registers, an ordered index and log boundaries."""

import sys

from pyspark import cloudpickle

# executors get the functions themselves, so that they need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
