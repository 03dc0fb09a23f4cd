"""Operators for preparing training corpora.  Nothing else in the library imports this subpackage."""

import sys

from pyspark import cloudpickle

# Executors need no copy of the package: what tasks use of it travels with them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
