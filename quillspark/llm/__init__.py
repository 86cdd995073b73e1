"""Operators for preparing training text at scale.

Nothing outside this package (and ``corpus_pipeline.py``) imports it.  Its
functions are shipped to Python workers by value, so executors need no copy
of the repository.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
