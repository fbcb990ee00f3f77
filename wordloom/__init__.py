"""Text cleaning, preparation and classification of tables, and operators for training data, on Spark."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with them, so executors need numpy and pyarrow but not this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
