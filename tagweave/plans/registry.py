"""All registered queries of the core, and their SQL."""

from __future__ import annotations

import atexit
import io
import os
import shutil
import tempfile
import zipfile
from pathlib import Path

from pyspark import SparkContext

from tagweave.plans import general, pages, tagging

QUERIES = {**general.QUERIES, **tagging.QUERIES, **pages.QUERIES}
SQL = {**general.SQL, **tagging.SQL, **pages.SQL}


def ship_package(sc: SparkContext) -> None:
    """Zip the package and add it to the session's Python files."""
    root = Path(__file__).resolve().parents[1]
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w", zipfile.ZIP_DEFLATED) as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, f"{root.name}/{p.relative_to(root)}")
    folder = tempfile.mkdtemp(prefix="tagweave-py-")  # on the driver, which serves it as long as it runs
    atexit.register(shutil.rmtree, folder, ignore_errors=True)
    path = os.path.join(folder, "tagweave.zip")
    Path(path).write_bytes(data.getvalue())
    sc.addPyFile(path)
