"""The folder all executors of a cluster can reach."""

from __future__ import annotations

import atexit
import re
import shutil
import tempfile

from pyspark.sql import SparkSession

SETTING = "spark.checkpoint.dir"


def shared_folder(spark: SparkSession) -> str:
    """Folder the session names in ``spark.checkpoint.dir``.

    A cluster has to name one; what is stored there stays until its owner empties it. A
    local session without the setting, as in tests, gets a fresh folder of this machine,
    which is the only one it runs on, for as long as the process lives.
    """
    named = spark.conf.get(SETTING, None)
    if named:
        return named
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError(f"{SETTING} must name a folder that all executors share")
    folder = tempfile.mkdtemp(prefix="sluicewatch-")
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    return folder
