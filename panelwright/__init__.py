"""Panelwright: cross-sectional panel analytics on PySpark DataFrames.

Functions of this package travel to executors by value, so executors need PySpark, NumPy and PyArrow but not the package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
