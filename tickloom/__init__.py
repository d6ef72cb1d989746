"""Technical analysis of OHLCV series, and training-data operators, as Spark jobs."""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with the job, so workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
