"""Spark analytics for distributed training jobs and the fleets that run them.

Every operator takes and returns DataFrames (or builds a Column); Spark plans,
shuffles and runs the work.
"""

import sys

from pyspark.cloudpickle import register_pickle_by_value

__version__ = "0.1.0"

# Functions that run in Python workers travel with the job, so executors need
# only the usual libraries and not this package.
register_pickle_by_value(sys.modules[__name__])
