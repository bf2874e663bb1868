"""A PySpark engine for pose time series."""

import sys

from pyspark import cloudpickle

# Functions of this package travel with the job, so executors need no copy of it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
