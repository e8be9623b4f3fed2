"""Training-data operators: scans, filters, de-duplication, packing.

Nothing else in the library imports this package.  Its code travels to Python
workers by value, so executors need no copy of the library on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
