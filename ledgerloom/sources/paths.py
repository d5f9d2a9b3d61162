"""Path rules on qualified Hadoop paths, checked on the driver before anything is written."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


class ProtectedPath(Exception):
    """A write would touch the observed logs."""


def qualified(path: str, spark: SparkSession | None = None) -> tuple[str, str]:
    """File system and absolute path; links of the local file system are resolved, also where the end does not exist."""
    spark = spark or SparkSession.getActiveSession()
    scheme, rest = "file", path
    if spark is not None:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        uri = where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).makeQualified(where).toUri()
        scheme, rest = f"{uri.getScheme()}://{uri.getAuthority() or ''}", uri.getPath()
    local = scheme.startswith("file")
    return ("file", os.path.realpath(rest.removeprefix("file://").removeprefix("file:"))) if local else (scheme, os.path.normpath(rest))


def assert_writable(candidate: str, *protected: str, spark: SparkSession | None = None) -> str:
    """candidate's absolute path, unless it is, contains or lies in a protected folder once links are resolved."""
    system, real = qualified(candidate, spark)
    for other, root in (qualified(p, spark) for p in protected):
        if other == system and os.path.commonpath([real, root]) in (real, root):
            raise ProtectedPath(candidate)
    return real


def is_observed(path: str, *roots: str) -> bool:
    """Whether a local file lies below a root and neither it nor a folder on the way is a link."""
    absolute = os.path.abspath(path)
    below = [os.path.abspath(r) for r in roots if absolute.startswith(os.path.abspath(r) + os.sep)]
    return any(os.path.realpath(absolute) == os.path.join(os.path.realpath(r), os.path.relpath(absolute, r)) for r in below)
