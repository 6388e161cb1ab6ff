"""pointlake: analysis of labelled 3-D point clouds as Spark jobs."""

import sys

from pyspark import cloudpickle

from pointlake.schema import IGNORE, ClassSplit

# functions that run in tasks travel with the job, so workers need not have the package installed
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["IGNORE", "ClassSplit"]
