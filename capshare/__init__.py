"""Shared-capacity telemetry analytics on PySpark.

Sub-packages
------------
functions   column expressions (scalars, quantile functions, demand rates)
operators   DataFrame -> DataFrame operators (series, allocation, replay, statistics, ...)
sources     readers, dimensions and sinks
streaming   Structured Streaming twins of the keyed operators
plans       bindings of the operators to the driver's tables, with their DuckDB checks
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

# kernels travel with their tasks by value, so executors need no copy of this package
_cloudpickle.register_pickle_by_value(_sys.modules[__name__])
