"""attestry: evidence retrieval and answer audit as Spark jobs."""

import sys

from pyspark import cloudpickle

from attestry.params import Params
from attestry.session import get_session, load_table

# Task functions travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["Params", "get_session", "load_table"]
