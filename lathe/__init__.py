"""lathe: a Spark-native engine for language-model post-training data.

Every operator is ``DataFrame -> DataFrame`` or ``Column -> Column``; plans stay
lazy and Catalyst picks the physical strategy.
"""

import sys

from pyspark import cloudpickle

# Python functions travel by value, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])
