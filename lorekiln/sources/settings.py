"""Settings of a store: a JSON file on the driver, checked when it is read, replaced as a whole when it is written.

Keys that aren't in KEYS are left out. A value of another type, or a folder with a `..` in it, gives way to the default; so does a
truth value where a number is asked for. A missing file has all defaults; one that holds no JSON object is an error.
"""

from __future__ import annotations

import copy
import json
import os
import tempfile
from collections.abc import Mapping
from pathlib import Path, PurePath
from typing import Any

#: Key: the types it may have, and its default.
KEYS: dict[str, tuple[tuple[type, ...], Any]] = {
    "store_dir": ((str,), "~/.lorekiln"),
    "index_dir": ((str,), "~/.lorekiln/index"),
    "collection": ((str,), "chunks"),
    "notes_dir": ((str, type(None)), None),
    "readers": ((dict,), {}),
    "auto_sync": ((bool,), False),
    "auto_inject": ((bool,), True),
    "chunk_max_tokens": ((int,), 800),
    "last_ingest": ((dict,), {}),
}
FOLDERS = ("store_dir", "index_dir", "notes_dir")


def _sound(key: str, value: Any) -> bool:
    kinds, _ = KEYS[key]
    if not isinstance(value, kinds) or (isinstance(value, bool) and bool not in kinds):
        return False
    return key not in FOLDERS or value is None or ".." not in PurePath(value).parts


def checked(given: Mapping[str, Any]) -> dict[str, Any]:
    """Every key of KEYS, with the given value where that is sound."""
    return {key: given[key] if key in given and _sound(key, given[key]) else copy.deepcopy(default) for key, (_, default) in KEYS.items()}


def read(path: str | os.PathLike) -> dict[str, Any]:
    try:
        given = json.loads(Path(path).read_text(encoding="utf-8"))
    except FileNotFoundError:
        given = {}
    if not isinstance(given, dict):
        raise ValueError(f"{path} holds no JSON object")
    return checked(given)


def write(settings: Mapping[str, Any], path: str | os.PathLike) -> None:
    """Readers see the old file or the new one, never part of it; only its owner may read it."""
    path = Path(path)
    path.parent.mkdir(parents=True, exist_ok=True)
    handle, made = tempfile.mkstemp(dir=path.parent, prefix=f".{path.name}.")  # of mode 0600
    try:
        with open(handle, "w", encoding="utf-8") as out:
            json.dump(dict(settings), out, indent=2)
            out.flush()
            os.fsync(out.fileno())
        os.replace(made, path)
    except BaseException:
        os.unlink(made)
        raise
