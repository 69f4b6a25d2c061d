"""riskspark: binary-outcome risk analytics as Spark DataFrame operators."""

import sys as _sys

__version__ = "0.1.0"

# Functions that run inside Python workers (Arrow batch operators) are shipped
# by value, so executors do not need this package installed or on their path.
try:  # pragma: no cover - depends on the PySpark build
    from pyspark import cloudpickle as _cp

    _cp.register_pickle_by_value(_sys.modules[__name__])
except Exception:  # noqa: BLE001
    pass
