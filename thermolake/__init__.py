"""Sensor-telemetry analytics on Spark."""

import sys

from pyspark import cloudpickle

# Python workers get the few functions they run by value, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
