"""Operators for preparing training text. Nothing outside this folder imports them."""

import sys

from pyspark import cloudpickle

# Functions of this folder travel to the executors with their code, which need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
