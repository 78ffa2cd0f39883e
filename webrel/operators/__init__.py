"""Operators over tables.

The functions that run inside tasks are shipped by value, so executors need only
the packages that Spark itself needs, not this one.
"""

import sys

from pyspark import cloudpickle

import webrel.functions.text

for _module in (__name__, "webrel.functions.text"):
    cloudpickle.register_pickle_by_value(sys.modules[_module])
