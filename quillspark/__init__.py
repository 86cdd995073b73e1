"""Analytics over documents, conversations, vectors and graphs as plain Spark jobs.

Functions of this package reach Python workers by value, so a cluster needs no
copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
