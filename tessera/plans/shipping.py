"""Making this package importable on the executors of a session."""

from __future__ import annotations

import pathlib
import tempfile
import zipfile

import tessera

_sent: set[str] = set()


def ship(spark) -> None:
    """Send the package to the executors once for each application, so that functions
    in tasks can import it however the cluster was started."""
    context = spark.sparkContext
    if context.applicationId in _sent:
        return
    root = pathlib.Path(tessera.__file__).parent
    target = pathlib.Path(tempfile.mkdtemp(prefix="tessera-ship-")) / "tessera_package.zip"
    with zipfile.ZipFile(target, "w") as archive:
        for file in sorted(root.rglob("*.py")):
            archive.write(file, file.relative_to(root.parent))
    context.addPyFile(str(target))
    _sent.add(context.applicationId)
