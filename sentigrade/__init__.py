"""Review sentiment and outcome analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# The few Python functions that run in tasks travel with the plan, so executors need no install.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
