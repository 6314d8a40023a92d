"""Dense hourly demand panels on Spark: event log -> panel -> features -> models -> error reports."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions that run in Python workers travel with the job: the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
