"""Queries over the test tables, each with the SQL it must agree with."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
