"""Change-data extraction on Spark: snapshots, change ranges, chunks and ledgers."""

import sys

from pyspark import cloudpickle

from driftline.session import session, shared_dir

# Functions sent to Python workers carry the package's code with them, so that
# a worker needs no path to it.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["session", "shared_dir"]
