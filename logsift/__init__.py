"""logsift: Spark-native log reduction and log search.

Every public operator is a function ``fn(df, **params) -> DataFrame`` or a
column builder ``fn(col, ...) -> Column`` built from Spark SQL built-ins.
Python runs inside tasks only where Spark has no built-in (NFC
normalization, Drain leaf clustering, the per-key EMA scan and the kNN
partial top-k), always through Arrow batches.
"""

import sys

from pyspark import cloudpickle

# Functions that run in tasks travel with the job, so executors need no
# installed copy of the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])

__version__ = "0.1.0"
