"""Training-data operators. Nothing outside this subpackage imports it.

Functions that run inside Spark's Python workers are shipped by value, so
executors need numpy and pyarrow but no installed copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
