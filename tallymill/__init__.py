"""Tallymill: spending questions, grounding checks and retrieval as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions that run in Python tasks travel with the job; executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
