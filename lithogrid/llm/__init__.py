"""Corpus operators for training-data pipelines; nothing else in the library imports this."""

import sys

from pyspark import cloudpickle

# Functions of this package travel inside the closures, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
