"""sylva: forest-survey and drone-imagery analytics on Spark DataFrames."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Tile kernels travel to the executors with the job, so that these need no
# installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
