"""Training-data operators. Nothing outside this folder imports it."""

import sys

from pyspark import cloudpickle

# Executors need no copy of this package: what they run travels with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
