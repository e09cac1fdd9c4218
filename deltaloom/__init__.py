"""deltaloom: structured change analytics expressed as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

# Functions that run on executors travel with the plan, so no package has to be installed there.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
