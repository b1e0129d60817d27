"""Record quality on Spark: normalise, check, compare, score, review and report on extracted document records."""

import sys

from pyspark import cloudpickle

# Functions of this package travel inside the jobs that use them, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
