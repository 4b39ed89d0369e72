"""Corpus analytics on Spark: sources, column functions, operators and plans over speech and text corpora."""

import sys

from pyspark import cloudpickle

# Python workers get this package's functions with each job, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
