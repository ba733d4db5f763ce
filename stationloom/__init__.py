"""Station and grid data fusion expressed as Spark DataFrame plans."""

import sys

from pyspark import cloudpickle

from stationloom.session import build_session, ensure_checkpoint_dir

# vectorised helpers travel with the task, so executors need no installed copy of this package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["build_session", "ensure_checkpoint_dir"]
