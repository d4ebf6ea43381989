"""Collections analytics on Spark: quality, statistics, preparation and models for payment panels."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# functions sent to executors carry their code, so workers need not have the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])
