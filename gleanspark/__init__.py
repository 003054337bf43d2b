"""gleanspark: file, event and text analytics expressed as Spark plans."""

import sys

from pyspark import cloudpickle

# Functions of this package travel to executors by value, so a cluster needs no
# copy of it on its workers' import path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
