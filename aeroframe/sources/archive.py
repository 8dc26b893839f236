"""Copies of output files."""

from __future__ import annotations

import shutil
from pathlib import Path


def archive_outputs(paths: list[str], directory: str, overwrite: bool = False) -> list[Path]:
    """Copy files; existing targets are refused unless ``overwrite``; sources stay."""
    target = Path(directory)
    target.mkdir(parents=True, exist_ok=True)
    copies = [target / Path(p).name for p in paths]
    taken = [str(c) for c in copies if c.exists()]
    if taken and not overwrite:
        raise FileExistsError(", ".join(taken))
    for source, copy in zip(paths, copies):
        shutil.copy2(source, copy)
    return copies
