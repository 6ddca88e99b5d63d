"""waymark: constrained path queries and table pipelines as Spark plans.

The package is shipped to Python workers by value, so executors need no
copy of it on their own path.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
