"""netweave: network-flow preparation, balancing, modelling and evaluation on Spark.

Every operator takes and returns DataFrames.  Fitted state (bounds, scalers,
vocabularies, weights) lives in small tables whose size does not depend on the
number of rows, so a fit ends in a short driver hop and an apply is one lazy
projection.
"""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Functions that run in Python workers travel with the job, so executors need no
# installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
