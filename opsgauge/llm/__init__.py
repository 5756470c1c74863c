"""Operators that prepare text for the training of language models."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with their job, so that executors
# need not have this package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
