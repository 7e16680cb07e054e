"""actlens: Spark-native analytics over public-sector action records.

Every operator is a plain ``DataFrame -> DataFrame`` function (use with
``df.transform``); nothing collects rows to the driver.
"""

from actlens.session import get_spark, checkpoint_dir

__all__ = ["get_spark", "checkpoint_dir"]
