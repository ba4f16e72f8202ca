"""Operators for preparing training text. Nothing else in the library imports them."""

import sys

from pyspark import cloudpickle

# Functions sent to tasks carry their code along: executors need not have this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
