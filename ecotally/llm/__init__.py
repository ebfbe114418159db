"""Training-data operators: one module per operator, ``catalog`` registers them.

The functions that run in Spark's Python workers are pickled by value, so the
workers need no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
