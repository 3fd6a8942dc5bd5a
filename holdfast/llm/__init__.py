"""Training-data operators: sharding, scoring, packing, mixing, filtering, search and dedup.

One module per operator, each with its general interface and its registered query. Functions that
run in tasks are sent with their code, so executors need no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
