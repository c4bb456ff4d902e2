"""Limits that a file must keep before it is parsed."""

from __future__ import annotations

import io
import zipfile

#: Limits of archives: members, expansion, bytes in all.
MEMBERS, EXPANSION, TOTAL = 20_000, 200, 1 << 30


def unsafe_archive(content: bytes) -> str | None:
    """Why an archive must not be unpacked, or None."""
    try:
        infos = zipfile.ZipFile(io.BytesIO(content)).infolist()
    except zipfile.BadZipFile:
        return "damaged archive"
    if len(infos) > MEMBERS:
        return "too many members"
    total = sum(i.file_size for i in infos)
    if total > TOTAL or any(i.file_size > EXPANSION * max(1, i.compress_size) for i in infos if i.file_size > 1 << 20):
        return "expands too far"
    return "unsafe path" if any(i.filename.startswith(("/", "\\")) or ".." in i.filename.split("/") for i in infos) else None
