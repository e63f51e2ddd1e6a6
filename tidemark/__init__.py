"""Tidemark: recommendation features and ranking evaluation as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions that run inside Python workers travel with the job, so executors need no installed copy.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
