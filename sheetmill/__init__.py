"""Specimen analytics on Spark: DataFrame operators, sources, plans and streams."""

import sys

from pyspark import cloudpickle

# functions travel to the executors by value, so that no executor needs this package on its path
cloudpickle.register_pickle_by_value(sys.modules[__name__])
