"""Catalog governance on Spark: normalise, version, score, check and report on metadata items.

Every operator takes DataFrames and explicit parameters (``as_of``, ``run_id``, ...) and returns a
DataFrame without running an action; only :mod:`lorekeep.sources` and :mod:`lorekeep.plans` write.
"""

import sys

from pyspark import cloudpickle

# The one Python task (URL probing) carries its code along, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
