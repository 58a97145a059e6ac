"""Arterial: road-network resilience and raster analytics as Spark DataFrames.

Arrow kernels of this package travel to the executors by value, so a cluster
needs nothing but PySpark, pyarrow and numpy installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
