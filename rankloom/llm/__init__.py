"""Operators for large training-data pipelines; nothing else in the library imports this subpackage.

Worker functions are pickled by value, so executors need neither this package on their path nor a zip of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
