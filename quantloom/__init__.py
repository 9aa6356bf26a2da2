"""quantloom: Spark-first analytics for panels of market-style time series."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# functions sent to executors travel with their code: no installed copy is needed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
