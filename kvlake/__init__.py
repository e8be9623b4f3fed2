"""kvlake: versioned, ordered key-value data as Spark DataFrames.

The package's code travels to Python workers by value, so executors need no copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
