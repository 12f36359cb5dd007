"""Operators of a training-data pipeline: one module per operator, general helpers beside them.

Functions that run inside Python workers are pickled by value, so the workers need only numpy,
pyarrow and zstandard, not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
