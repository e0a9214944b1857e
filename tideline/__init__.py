"""tideline: market-microstructure analytics on Spark DataFrames.

Functions of this package that run inside Arrow stages are shipped to the
executors by value, so the workers need no installation of the package.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
