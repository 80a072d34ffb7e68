"""Nearest-neighbour imputation of mixed numeric and categorical tables on Spark."""

from __future__ import annotations

import sys

from pyspark import cloudpickle

# Executors need no installed copy: functions of this package travel with the task.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

from lacuna.roles import Roles  # noqa: E402

__all__ = ["Roles"]
