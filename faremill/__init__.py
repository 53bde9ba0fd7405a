"""faremill: price-observation analytics as lazy DataFrame transformations."""

from __future__ import annotations

import sys

from pyspark import cloudpickle

# Functions that run in Python workers travel by value, so executors need no copy
# of this package on their path.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
