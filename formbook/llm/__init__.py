"""Operators of a training-data pipeline; nothing else in the library imports them.

Functions of this package travel to the executors by value, so a cluster
needs no copy of the package on its workers.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
