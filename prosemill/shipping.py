"""The package on workers that cannot import it by themselves: installed nowhere, and not on their path."""

from __future__ import annotations

import os
import sys
import tempfile
import zipfile

from pyspark.sql import SparkSession

_shipped: set[str] = set()


def importable() -> bool:
    """Whether workers find the package where the driver found it: installed, or on PYTHONPATH."""
    home = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    on_path = [os.path.abspath(p) for p in os.environ.get("PYTHONPATH", "").split(os.pathsep) if p]
    return home in on_path or any(part in ("site-packages", "dist-packages") for part in home.split(os.sep))


def ship(spark: SparkSession) -> None:
    """Send the package, once a session, as an archive that workers import from."""
    context = spark.sparkContext
    if importable() or context.applicationId in _shipped:
        return
    here = os.path.dirname(os.path.abspath(__file__))
    archive = os.path.join(tempfile.mkdtemp(prefix="prosemill-ship-"), "prosemill.zip")  # the driver serves it
    with zipfile.ZipFile(archive, "w", zipfile.ZIP_DEFLATED) as held:
        for folder, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    path = os.path.join(folder, name)
                    held.write(path, os.path.relpath(path, os.path.dirname(here)))
    context.addPyFile(archive)
    sys.path[:] = [p for p in sys.path if p != archive]
    _shipped.add(context.applicationId)
