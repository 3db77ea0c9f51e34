"""Files on the driver: archives, folders, and what the machine is."""

from __future__ import annotations

import os
import platform
import shutil
import sys
import zipfile
from pathlib import Path

MARKER = ".unpacked"


def unpack_once(archive: str, folder: str) -> bool:
    """Unpack a ZIP archive into a folder, unless that was done before; whether it was unpacked now. A marker file is written last."""
    marker = Path(folder) / MARKER
    if marker.exists():
        return False
    with zipfile.ZipFile(archive) as z:
        z.extractall(folder)
    marker.write_text(Path(archive).name, encoding="utf-8")
    return True


def copy_in_parts(source: str, target: str, part: int = 64 << 20) -> int:
    """Copy a file part by part under another name, which is moved at the end; the number of bytes."""
    done, writing = 0, f"{target}.writing"
    with open(source, "rb") as a, open(writing, "wb") as b:
        while data := a.read(part):
            b.write(data)
            done += len(data)
    os.replace(writing, target)
    return done


def review_archive(root: str, out: str, leave_out: tuple[str, ...] = (".joblib", ".pyc")) -> list[str]:
    """A ZIP archive of a folder's files but those of some endings and itself; their names, in order."""
    base, target = Path(root), Path(out).resolve()
    names = sorted(str(p.relative_to(base)) for p in base.rglob("*") if p.is_file() and p.suffix not in leave_out and p.resolve() != target)
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name in names:
            z.write(base / name, name)
    return names


def environment(folder: str = ".") -> dict:
    """Python, machine, processors, memory and free disk, where the system tells."""
    try:
        memory = os.sysconf("SC_PAGE_SIZE") * os.sysconf("SC_PHYS_PAGES")
    except (AttributeError, OSError, ValueError):
        memory = None
    disk = shutil.disk_usage(folder)
    return {"python": sys.version.split()[0], "system": platform.system(), "machine": platform.machine(), "cpus": os.cpu_count(), "memory_bytes": memory, "disk_bytes": disk.total, "disk_free_bytes": disk.free}
