"""Operators of a training-data pipeline; nothing else in the library imports this package.

Functions that run on executors travel by value, so that a cluster needs no installed copy of the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
