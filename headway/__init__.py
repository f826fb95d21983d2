"""headway: transit-trajectory analytics on Spark DataFrames and Structured Streaming.

Functions that run inside tasks are pickled by value, so a cluster whose
executors lack this package on their path still runs them.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
