"""Training-data operators: deduplication, packing, tokenizing, scoring, classifying, archiving, vector search.

Functions of this package travel to the workers by value, so that no worker needs a copy of it.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
