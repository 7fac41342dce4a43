"""Project folders as paths and as names of transcript folders. These act on the driver's file system."""

from __future__ import annotations

from pathlib import Path


def resolve_project(typed: str | Path) -> Path:
    """The absolute path of a folder as it is spelled on disk, without links, ``~`` or ``..``.

    Names that no entry matches, whatever its case, stay as typed.
    """
    path = Path(typed).expanduser().resolve()
    spelled = Path(path.anchor)
    for name in path.parts[1:]:
        here = [e.name for e in spelled.iterdir()] if spelled.is_dir() else []
        alike = [e for e in here if e.lower() == name.lower()]
        spelled /= name if name in alike or not alike else sorted(alike)[0]
    return spelled


def encode_project(typed: str | Path) -> str:
    """The name of a project's transcript folder: its path with a dash for each slash."""
    return str(resolve_project(typed)).replace("/", "-")
