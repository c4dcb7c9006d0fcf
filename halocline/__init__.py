"""Air-sea flux data work on Spark DataFrames.

Operators take DataFrames and column names and return DataFrames; nothing is collected
except small, bounded results such as chunk edges, axis values or fitted parameters.
"""

import sys

from pyspark import cloudpickle

# Functions shipped to Python workers travel by value, so executors do not need the
# package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
