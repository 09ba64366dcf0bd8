"""Archives as rows: members of zip files and of tar files, with the members that must not be unpacked left out."""

from __future__ import annotations

import io
import posixpath
import re
import tarfile
import zipfile

import pyarrow as pa
from pyspark.sql import DataFrame


def zip_members(raw: bytes) -> dict[str, bytes]:
    """Names and contents of a zip file; empty if it is none."""
    try:
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            return {n: z.read(n) for n in z.namelist() if not n.endswith("/")}
    except (zipfile.BadZipFile, OSError, RuntimeError, EOFError):
        return {}


def _escapes(path: str) -> bool:
    flat = path.replace("\\", "/")
    return flat.startswith("/") or bool(re.match(r"^[A-Za-z]:", flat)) or posixpath.normpath(flat).split("/")[0] == ".."


def refusal(name: str, kind: str, link: str) -> str | None:
    """Why a tar member must not be unpacked: it, or what it links to, leaves the folder, or it is a device."""
    if kind not in ("file", "folder", "symlink", "hardlink"):
        return "special file"
    if not name or _escapes(name) or ".." in name.replace("\\", "/").split("/"):
        return "path outside the folder"
    if kind == "symlink" and (_escapes(link) and not link.startswith("..") or _escapes(posixpath.join(posixpath.dirname(name), link))):
        return "link outside the folder"
    if kind == "hardlink" and _escapes(link):
        return "link outside the folder"
    return None


def _kind(m: tarfile.TarInfo) -> str:
    return "file" if m.isfile() else "folder" if m.isdir() else "symlink" if m.issym() else "hardlink" if m.islnk() else "special"


def tar_members(files: DataFrame, id_col: str, content: str, most_bytes: int = 1_000_000) -> DataFrame:
    """(id, name, kind, link, content, reason): members of tar files; refused ones have a reason and no content."""

    def run(batches):
        for b in batches:
            for i, raw in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                rows = []
                try:
                    with tarfile.open(fileobj=io.BytesIO(raw.as_py() or b""), mode="r:*") as t:
                        for m in t:
                            why = refusal(m.name, _kind(m), m.linkname)
                            body = t.extractfile(m).read() if why is None and m.isfile() and m.size <= most_bytes else None
                            rows.append((m.name, _kind(m), m.linkname, body, why or ("over size cap" if m.isfile() and body is None else None)))
                except (tarfile.TarError, OSError, EOFError):
                    rows.append(("", "special", "", None, "not a tar file"))
                cols = list(zip(*rows, strict=True)) or [[]] * 5
                kinds = (pa.string(), pa.string(), pa.string(), pa.binary(), pa.string())
                yield pa.RecordBatch.from_arrays([pa.array([i] * len(rows), b.column(0).type), *[pa.array(c, k) for c, k in zip(cols, kinds, strict=True)]], [id_col, "name", "kind", "link", "content", "reason"])

    return files.select(id_col, content).mapInArrow(run, f"{id_col} {dict(files.dtypes)[id_col]}, name string, kind string, link string, content binary, reason string")


def without_wrapper(members: DataFrame, by: str, name: str = "name") -> DataFrame:
    """Names without the one folder that holds all members of an archive, if one does."""
    from pyspark.sql import functions as F

    top = F.split(name, "/")[0]
    tops = members.groupBy(by).agg((F.countDistinct(top) == 1).alias("__one"), F.min((F.instr(name, "/") > 0).cast("int")).alias("__all"))
    bare = F.regexp_replace(name, "^[^/]*/", "")
    return members.join(tops, by).withColumn(name, F.when(F.col("__one") & (F.col("__all") == 1), bare).otherwise(F.col(name))).drop("__one", "__all")
