"""Evidence retrieval, agent-run evaluation and post-training data as DataFrame functions."""

import sys

from pyspark import cloudpickle

# Functions sent to Python workers travel by value: executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
