"""galley: a PySpark-native engine for newsletter pipelines.

Everything is expressed as DataFrame/SQL plans; Python runs only in Arrow
batches where the built-in operators cannot state the semantics.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions travel to the executors by value, so the package need not be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
