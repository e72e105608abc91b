"""Operators for preparing language-model training data. Nothing outside this subpackage imports it."""

import sys

from pyspark import cloudpickle

# Executors get these functions by value, so they need no copy of the repository on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
