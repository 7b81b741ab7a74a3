"""Operators for preparing training data. Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# functions of this package go to the workers as they are, so that it need not be installed there
cloudpickle.register_pickle_by_value(sys.modules[__name__])
