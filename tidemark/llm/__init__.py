"""Training-data operators: each module holds one operator, ``queries`` the registered queries."""

import sys

from pyspark import cloudpickle

# Executors need not have this package installed: its functions travel by value.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
