"""cohortlab: clinical-cohort and training-data operators on Spark DataFrames."""

import sys

from pyspark import cloudpickle

# Python functions travel to the executors by value: they need not have the package installed.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
