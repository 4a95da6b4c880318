"""Web-mining analytics on Spark: text, retrieval, near-duplicates, recommendation, crawling and graphs as DataFrames."""

import sys

from pyspark.cloudpickle import register_pickle_by_value

# Functions of this package travel to the executors whole, so that it need not be installed there.
register_pickle_by_value(sys.modules[__name__])
