"""Files that tasks open themselves: paths and URIs through ``pyarrow.fs`` (local folders, object stores, HDFS)."""

from __future__ import annotations

from pyarrow import fs as pa_fs


def system_of(path: str) -> tuple[pa_fs.FileSystem, str]:
    """The file system of a path or URI, and the path within it."""
    if "://" in path or path.startswith("file:"):
        return pa_fs.FileSystem.from_uri(path)
    return pa_fs.LocalFileSystem(), path


def segment_name(label: str) -> str:
    return f"disk.{label}.log"


def label_of_name(name: str) -> str:
    return name.removesuffix(".tmp").removesuffix(".log").removeprefix("disk.")


def list_segment_files(folder: str, include_tmp: bool = False) -> list[tuple[str, str, int]]:
    """Label, path and bytes of each segment file of a folder, in label order; none where there is no folder."""
    system, root = system_of(folder)
    found = system.get_file_info(pa_fs.FileSelector(root.rstrip("/"), allow_not_found=True))
    kept = [i for i in found if i.type == pa_fs.FileType.File and (i.base_name.endswith(".log") or include_tmp and i.base_name.endswith(".log.tmp"))]
    return sorted((label_of_name(i.base_name), i.path, i.size) for i in kept)
