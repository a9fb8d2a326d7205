"""weftline: data-curation operators expressed on the Spark DataFrame API."""

import sys

try:
    from pyspark import cloudpickle

    # Functions sent to Python workers travel by value, so executors need no copy of this package.
    cloudpickle.register_pickle_by_value(sys.modules[__name__])
except (ImportError, AttributeError):  # pragma: no cover - an unusual pyspark build
    pass
