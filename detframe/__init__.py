"""Detection-data analytics on Spark DataFrames: ingest, pair, match, score, profile and configure."""

import sys

from pyspark import cloudpickle

# Executors get the functions of this package with each job, so they need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
