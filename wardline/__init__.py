"""Auditing of agent tool-call traffic, and training-data operators, as Spark jobs."""

from __future__ import annotations

import os
import tempfile
import zipfile


def ship(spark) -> None:
    """Send the package to the workers of a session, so that it need not be installed on their machines."""
    here = os.path.dirname(os.path.abspath(__file__))
    path = os.path.join(tempfile.mkdtemp(prefix="wardline-"), "wardline.zip")
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        for folder, _, names in os.walk(here):
            for name in names:
                if name.endswith(".py"):
                    full = os.path.join(folder, name)
                    z.write(full, os.path.relpath(full, os.path.dirname(here)))
    spark.sparkContext.addPyFile(path)
