"""Spark-native extraction of structured data from web pages, and training-data operators.

The package's functions travel to the executors by value, so a cluster needs
no copy of it on its machines.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
