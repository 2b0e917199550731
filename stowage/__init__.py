"""Stowage: compressed archives as Spark DataFrames.

The package is pickled by value, so that functions shipped to executors work
whatever folder the driver was started from.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
