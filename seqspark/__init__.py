"""Spark-native analytics for non-B DNA structure motifs."""

import sys

from pyspark import cloudpickle

# The few Python steps travel inside the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
