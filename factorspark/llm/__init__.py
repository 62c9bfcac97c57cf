"""Operators of a training-data pipeline. Nothing else in the library imports this package.

What runs in Python workers is shipped by value: executors need the libraries, not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
