"""Order-independent multiset digests, table reconciliation and training-data preparation on PySpark."""

import sys

from pyspark import cloudpickle

# Functions travel to the executors with their code, so that workers need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
