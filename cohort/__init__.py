"""Analytics for labelled cohort tables, expressed as Spark DataFrame jobs."""

import sys

from pyspark import cloudpickle

__version__ = "0.1.0"

# Executors receive the package's UDFs by value, so it need not be installed on them.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
