"""Operators for training-data preparation. Nothing outside this subpackage imports it.

Functions of this package travel to the Python workers by value, so workers need no
copy of the repository on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
