"""Time-series and energy-telemetry analytics as Spark DataFrame operators."""

import sys

from pyspark.cloudpickle import cloudpickle

from tidewatt.spec import SeriesSpec
from tidewatt.session import get_session

# Functions sent to Python workers carry their code, so executors need no copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__all__ = ["SeriesSpec", "get_session"]
