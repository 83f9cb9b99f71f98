"""attestry: retrieval-evaluation and corpus preparation on PySpark.

Python functions of this package travel to the executors by value, so that no
package has to be installed on the workers of a cluster.
"""

import sys

from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])
