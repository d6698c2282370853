"""Training-data operators: formatting, deduplication, filtering and mixing."""

import sys

from pyspark import cloudpickle

# Executors get the functions themselves: they need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
