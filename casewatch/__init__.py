"""Drug-safety signal detection, review triage and evaluation as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

# Functions for Python workers travel by value: only the driver needs this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
