"""Training-data operators: mixing, near duplicates, scoring, filtering, packing and sharding.

Nothing else in the library imports this subpackage. Its Python functions travel to executors by
value, so executors need not have the package installed.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
