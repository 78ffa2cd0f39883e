"""Operators for large text collections used as training data.

One module per operator; ``queries`` registers a query for each.  Nothing else
in the library imports this package, and it imports only general helpers.
"""

import sys

from pyspark import cloudpickle

# Functions of this package travel to the executors whole, so a cluster needs the
# libraries they use but no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
