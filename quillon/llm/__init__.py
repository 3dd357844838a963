"""Training-data operators: near duplicates, filters, mixing, formatting and tokens.

Nothing outside this folder imports it; ``registry`` names its queries.
"""

import sys

from pyspark import cloudpickle

# functions of this folder travel to the workers by value, so that executors need no copy of it
cloudpickle.register_pickle_by_value(sys.modules[__name__])
