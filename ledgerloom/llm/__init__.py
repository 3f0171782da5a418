"""Operators of a training-data pipeline. Nothing else in the library imports this subpackage.

Functions for the workers travel with their code, so that executors need no
copy of this package.
"""

from pyspark import cloudpickle

import ledgerloom

cloudpickle.register_pickle_by_value(ledgerloom)
