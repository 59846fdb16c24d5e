"""Operators of a training-data pipeline: one module each, queries in ``queries``.

Their Python functions travel to the executors by value, so executors need numpy, pyarrow and xxhash,
but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
