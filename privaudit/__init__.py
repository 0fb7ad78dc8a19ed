"""Privacy-behaviour and policy-compliance analytics as Spark DataFrame operators.

Every public operator is a plain function from DataFrames (and a few options) to a DataFrame, keyed
by ``package`` so that one job covers a whole fleet of apps.
"""

import sys

from pyspark import cloudpickle

# Python tasks carry their functions along, so executors need no copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
