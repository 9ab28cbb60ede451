"""Operators for training-data pipelines over large text tables.

Each operator lives in a module of its own and takes and returns DataFrames. `queries` registers
one query for each. Helper code that runs in Python workers is shipped with the job, so workers
need not have this package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
