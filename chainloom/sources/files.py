"""Names of files as the engine reports them: whole paths, so that files of one name in different folders stay apart."""

from __future__ import annotations

import logging
import re

from pyspark.sql import SparkSession

#: Beginning of a local name, which the engine spells with one slash or three.
LOCAL = "^file:/+"
log = logging.getLogger(__name__)


def located(spark: SparkSession, paths: list[str]) -> dict[str, str]:
    """The full name of each path as it stands in ``file_name`` columns. Paths that do not exist are left out, with a warning."""
    hadoop, conf = spark._jvm.org.apache.hadoop.fs, spark._jsc.hadoopConfiguration()
    out = {}
    for path in dict.fromkeys(paths):
        p = hadoop.Path(path)
        fs = p.getFileSystem(conf)
        if fs.exists(p):
            name = spark._jvm.org.apache.spark.paths.SparkPath.fromPath(fs.getFileStatus(p).getPath()).urlEncoded()
            out[path] = re.sub(LOCAL, "file:/", name)
        else:
            log.warning("%s: no such file, skipped", path)
    return out


def base_name(path: str) -> str:
    return path.rsplit("/", 1)[-1]
