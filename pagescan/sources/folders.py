"""Where what is written on the way goes."""

import re
import tempfile

from pyspark.sql import SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder that driver and executors share, from ``spark.checkpoint.dir``.

    Without that setting a session whose tasks run inside the driver gets a folder of its own; on a
    cluster it is an error, since executors would not see a local folder.
    """
    context = spark.sparkContext
    if context.getCheckpointDir() is None:
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if folder is None:
            if not re.fullmatch(r"local(\[[^,\]]*(,[^,\]]*)?\])?", context.master):
                raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="pagescan-")
        context.setCheckpointDir(folder)
    return context.getCheckpointDir()
