"""Ledgerloom: on-chain event analytics as Spark DataFrame jobs.

Functions that run inside Python workers are pickled by value, so executors
need PySpark, pyarrow, pandas and numpy but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
