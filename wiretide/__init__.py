"""Attack patterns in network packet tables and streams, as Spark DataFrame operators."""

import sys

from pyspark import cloudpickle

# The few functions that run in Python workers travel with the query, so executors need no installation.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
