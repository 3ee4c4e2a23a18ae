"""Spark-native curation, temporal planning, embedding analytics and evaluation of audio-visual clips."""

__version__ = "0.1.0"

import sys

from pyspark import cloudpickle

# Python functions travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
