"""Operators of a training-data pipeline: cleaning, deduplication, mixing and packing of documents."""

import sys

from pyspark import cloudpickle

# Ship these modules with their functions, so executors need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
