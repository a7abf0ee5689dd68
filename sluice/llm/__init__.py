"""Training-data operators.  Nothing outside this subpackage imports it.

Python functions that run on executors are pickled by value, so a cluster
needs only the public libraries on its executors, not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
