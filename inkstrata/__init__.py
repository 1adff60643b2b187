"""inkstrata: text forensics and corpus analytics as Spark DataFrame transforms.

Functions that run on executors are shipped by value, so a cluster needs only
PySpark, Arrow and numpy on its workers, not a copy of this package.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

cloudpickle.register_pickle_by_value(sys.modules[__name__])
