"""Training-data operators: corpus stages written for Spark. Of the rest of the library they use the session helpers only;
nothing there uses them.

Functions that run inside Spark's Python workers are shipped by value, so executors need only the interpreter's own
packages and not a copy of this one.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
