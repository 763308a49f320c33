"""Paths that users give: relative, inside the allowed folders, without control characters or steps upwards."""

from __future__ import annotations

import posixpath
import re
from urllib.parse import unquote

from nearfield.errors import error

#: Folders in which indexes may be kept, and how often an encoded path is decoded.
ALLOWED, DECODINGS = (".", "data", "models", "indices", "tmp"), 4


def checked(path: str, root: str = "", allowed: tuple[str, ...] = ALLOWED) -> str:
    """The path in normal form, below the root (without one: below the file system's working folder), or an error that
    says what is wrong with it."""
    seen = path
    for _ in range(DECODINGS + 1):
        _plain(seen)
        decoded = unquote(seen)
        if decoded == seen:
            break
        seen = decoded
    else:
        raise error("Path Error", "the path is encoded too often")
    normal = posixpath.normpath(seen)
    if "/" in normal and normal.split("/")[0] not in allowed:
        raise error("Path Error", f"only {', '.join(allowed)} hold indexes")
    return f"{root.rstrip('/')}/{normal}" if root else normal


def _plain(path: str) -> None:
    if not path or not path.strip():
        raise error("Path Error", "the path is empty")
    if re.search(r"[\x00-\x1f\x7f]", path):
        raise error("Path Error", "the path has control characters")
    if path.startswith(("/", "\\", "~")) or re.match(r"[A-Za-z]:|[A-Za-z][A-Za-z0-9+.-]*://", path):
        raise error("Path Error", "the path is absolute")
    if ".." in re.split(r"[/\\]", path) or "\\" in path:
        raise error("Path Error", "the path leads upwards")
