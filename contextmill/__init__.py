"""contextmill: batched context retrieval and usage analytics on PySpark."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Python functions travel to the tasks by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
