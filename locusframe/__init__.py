"""PySpark-native search over genomic annotation files."""

import sys

from pyspark import cloudpickle

# Executors get Python functions and data sources themselves: they need no copy of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
