"""Column functions. Python parts travel with the job, so executors need no installed copy."""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules["tickforge"])
