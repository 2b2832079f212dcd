"""tidemark: time-series analytics expressed as Spark DataFrame plans."""

import os

__version__ = "0.1.0"


def version() -> str:
    """The version of this library."""
    return __version__


def reachable(spark) -> None:
    """Let Python workers of this machine import the library from where the driver did.

    On a cluster the library is shipped or installed; a path that is not there does no harm.
    """
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    environment = spark.sparkContext.environment
    paths = [p for p in environment.get("PYTHONPATH", "").split(os.pathsep) if p]
    if root not in paths:
        environment["PYTHONPATH"] = os.pathsep.join([root, *paths])
