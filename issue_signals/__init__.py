"""Issue-text analytics on Spark: assemble issue texts, match them to quality
attributes, attach sentiment, evaluate classifiers and report."""

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel with the job; workers need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
