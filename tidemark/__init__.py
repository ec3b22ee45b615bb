"""Many-series time-series analytics as PySpark DataFrame operators."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Helper functions travel inside the tasks that use them; executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
