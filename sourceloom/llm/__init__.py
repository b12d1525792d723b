"""Operators for preparing language-model training data.

Nothing else in the library imports this package. Functions that run in Python workers
travel by value, so executors need not have it on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
