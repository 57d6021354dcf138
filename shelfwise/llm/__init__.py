"""Operators for preparing training text: archives, licences, deduplication, scoring, mixing, quality, search and packing."""
import sys

from pyspark import cloudpickle

# functions that run in tasks travel with the plan, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
