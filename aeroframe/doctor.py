"""Report on the environment."""

from __future__ import annotations

import importlib.metadata
import platform
import shutil
import sys

PACKAGES = ("pyspark", "numpy", "pandas", "pyarrow", "duckdb", "tiktoken", "tokenizers", "pyahocorasick", "xxhash")


def environment_report() -> dict:
    """Versions of what the engine uses; None where a package is missing."""
    versions = {}
    for name in PACKAGES:
        try:
            versions[name] = importlib.metadata.version(name)
        except importlib.metadata.PackageNotFoundError:
            versions[name] = None
    return {"python": sys.version.split()[0], "platform": platform.platform(), "java": shutil.which("java"), "packages": versions}
