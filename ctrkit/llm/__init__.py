"""Operators of a training-data pipeline: one module per operator, queries in ``queries``.

The Python that runs inside tasks is shipped with the job (pickled by value), so that
executors need the public libraries but no copy of this package.
"""

from __future__ import annotations

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
