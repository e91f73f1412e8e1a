"""Tidemill: procurement analytics and corpus preparation as Spark jobs.

Functions that run in tasks are shipped with the job itself, so executors need
Spark's Python libraries but not this package.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
