"""Storm-radar and weather-alert analytics as Spark DataFrame functions."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions sent to Python workers carry the package's own code, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
