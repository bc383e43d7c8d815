"""Operators of a training-data pipeline: scoring, filtering, near-duplicates, pseudonyms, mixing, packing."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors by value: nothing need be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
