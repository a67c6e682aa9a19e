"""Operators for preparing training text. Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Functions travel to the Python workers whole, so a session whose workers cannot import the library still runs them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
