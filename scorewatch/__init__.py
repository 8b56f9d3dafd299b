"""Rule discovery, validation, scorecards and drift monitoring on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Functions used inside tasks travel with the job, so workers need not import
# this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
