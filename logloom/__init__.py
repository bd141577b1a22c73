"""Event-log analytics for business processes, expressed as Spark plans."""

import sys

from pyspark import cloudpickle

from logloom.schema import LogSchema

__all__ = ["LogSchema"]

# Functions that run in Python workers travel with their code, so the workers need
# not have the package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
