"""Operators for preparing language-model training data.

Nothing else in the library imports this subpackage. Its modules are pickled by value,
so Spark's Python workers need no copy of the package on their path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
