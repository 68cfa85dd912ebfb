"""Send this package to the Python workers of a session."""

from __future__ import annotations

import os
import shutil
import tempfile

from pyspark.sql import SparkSession

import fleetlens


def ship_code(spark: SparkSession) -> SparkSession:
    """Make the package importable in every Python worker, once per application.

    As ``--py-files`` would, for sessions that were started without it.
    """
    sc = spark.sparkContext
    if _SHIPPED.get("application") != sc.applicationId:
        package = os.path.dirname(os.path.abspath(fleetlens.__file__))
        base = os.path.join(tempfile.mkdtemp(prefix="fleetlens-code-"), "fleetlens")
        sc.addPyFile(shutil.make_archive(base, "zip", os.path.dirname(package), os.path.basename(package)))
        _SHIPPED["application"] = sc.applicationId
    return spark


_SHIPPED: dict[str, str] = {}
