"""Vector analytics and corpus operators expressed as Spark DataFrame plans.

Python kernels that Spark ships to executors are pickled by value, so a
cluster needs numpy and pyarrow on its nodes but not this package.
"""

import sys as _sys

from pyspark import cloudpickle as _cloudpickle

_cloudpickle.register_pickle_by_value(_sys.modules[__name__])

__version__ = "0.1.0"
