"""basketlens: webshop order-line analytics as Spark DataFrame transforms.

Every operator is a pure ``DataFrame -> DataFrame`` function built from the
public PySpark API. Nothing here creates a SparkSession; callers own it.
"""

from basketlens.schema import Params

__all__ = ["Params"]
__version__ = "0.1.0"
