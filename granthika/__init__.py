"""Spark-native engine for grounded retrieval, corpus analytics and training-data preparation.

Operators are functions ``DataFrame -> DataFrame``. Python functions that run on executors are
pickled by value, so the package needs no installation on a cluster's workers.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
