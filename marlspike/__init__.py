"""Marlspike: schema-driven validation and normalisation of delimited text on Spark.

Functions of this package that run in Python workers are pickled by value, so executors need no
copy of the package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
