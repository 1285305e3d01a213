"""Structural analytics over trees of embedded units, expressed as Spark plans.

Functions that run on executors travel with their code, so executors need no copy of this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
