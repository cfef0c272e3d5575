"""Vehicle-bus security analytics as ordinary Spark DataFrame functions."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# The few Python helpers that run in tasks travel with the job, so workers need no installed package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
