"""Evidence-grounded retrieval and auditable answer analytics on Spark."""

import sys

from pyspark import cloudpickle

# Task functions travel with the job, so executors need no installed copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
