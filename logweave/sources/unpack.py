"""Archives inside file trees: members of zip, tar, gz, bz2 and xz files, nested to any depth."""

from __future__ import annotations

import bz2
import gzip
import io
import lzma
import posixpath
import shutil
import tarfile
import tempfile
import zipfile
import zlib
from collections.abc import Callable, Iterator
from functools import partial
from typing import IO

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweave.functions.batches import ROWS_PER_BATCH

MAX_ROUNDS = 50
#: Bytes of a member that are held and handed on at once; a larger member comes in several parts.
PART = 64 << 20
_SINGLE = {".gz": gzip.open, ".bz2": bz2.open, ".xz": lzma.open}
_ARCHIVES = (".zip", ".tar", ".tgz", *_SINGLE)


def safe_member(name: str) -> str | None:
    """The path of a member inside its archive, None where it would lie outside."""
    name = name.replace("\\", "/")
    tidy = posixpath.normpath(name)
    if name.startswith("/") or tidy.startswith("..") or tidy in (".", "") or (len(tidy) > 1 and tidy[1] == ":"):
        return None
    return tidy


_BROKEN = (zipfile.BadZipFile, tarfile.TarError, OSError, EOFError, ValueError, RuntimeError, lzma.LZMAError, zlib.error)


def members(name: str, data: bytes | IO[bytes], depth: int = 0) -> Iterator[tuple[str, int, bytes, str]]:
    """(path, part, bytes, status) of everything inside a file; status is ``file``, ``refused``, ``broken`` or ``too deep``.

    A file that is no archive is itself its only member.  Links and members
    that would lie outside the archive are refused.  A member of more than
    ``PART`` bytes has several parts, numbered from 0.  What was read before
    damage stays; ``broken`` follows for the member or archive that is
    damaged, and other members of a zip are read on.
    """
    low = name.lower()
    if depth >= MAX_ROUNDS:
        yield name, 0, b"", "too deep"
        return
    stream = io.BytesIO(data) if isinstance(data, bytes) else data
    part = 0
    try:
        if low.endswith(".zip"):
            inner = _zip(stream)
        elif low.endswith((".tar", ".tar.gz", ".tgz", ".tar.bz2", ".tar.xz")):
            inner = _tar(stream)
        elif low.endswith(tuple(_SINGLE)):
            opener = next(o for end, o in _SINGLE.items() if low.endswith(end))
            inner = iter([(posixpath.basename(name).rpartition(".")[0], lambda: opener(stream))])
        else:
            while (piece := stream.read(PART)) or part == 0:
                yield name, part, piece, "file"
                part += 1
            return
        for member, opened in inner:
            tidy = safe_member(member)
            if tidy is None or opened is None:
                yield f"{name}!/{member}", 0, b"", "refused"
                continue
            yield from _member(f"{name}!/{tidy}", opened, depth + 1)
    except _BROKEN as error:
        _raise_if_local(error)
        yield name, part, b"", "broken"


def _member(path: str, opened: Callable[[], IO[bytes]], depth: int) -> Iterator[tuple[str, int, bytes, str]]:
    """What a member holds.  An archive is laid on disk first where it is large, since zip and tar are read by position."""
    try:
        with opened() as stream:
            if not path.lower().endswith(_ARCHIVES):
                yield from members(path, stream, depth)
                return
            with tempfile.SpooledTemporaryFile(max_size=PART) as copy:
                shutil.copyfileobj(stream, copy)
                copy.seek(0)
                yield from members(path, copy, depth)
    except _BROKEN as error:
        _raise_if_local(error)
        yield path, 0, b"", "broken"


def _raise_if_local(error: Exception) -> None:
    """A full disk and the like are no damage of the archive."""
    if isinstance(error, OSError) and error.errno is not None:
        raise error


def _zip(stream: IO[bytes]) -> Iterator[tuple[str, Callable[[], IO[bytes]] | None]]:
    with zipfile.ZipFile(stream) as archive:
        for info in archive.infolist():
            if not info.is_dir():
                link = (info.external_attr >> 16) & 0o170000 == 0o120000
                yield info.filename, None if link else partial(archive.open, info)


def _tar(stream: IO[bytes]) -> Iterator[tuple[str, Callable[[], IO[bytes]] | None]]:
    with tarfile.open(fileobj=stream, mode="r:*") as archive:
        for info in archive:
            if not info.isdir():
                yield info.name, partial(archive.extractfile, info) if info.isreg() else None


def unpacked_files(spark: SparkSession, root: str) -> DataFrame:
    """Every file below ``root`` with archives unpacked: path, inner_path, part, content, status; large members have several parts."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path", "content")
    columns = ["path", "inner_path", "part", "content", "status"]

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"], strict=True):
                rows, held = [], 0
                for inner, part, data, status in members(posixpath.basename(path), content):
                    rows.append((path, inner, part, data, status))
                    held += len(data)
                    if held >= PART or len(rows) >= ROWS_PER_BATCH:
                        yield pd.DataFrame(rows, columns=columns)
                        rows, held = [], 0
                yield pd.DataFrame(rows, columns=columns)

    return files.mapInPandas(read, "path string, inner_path string, part int, content binary, status string")


def manifest(unpacked: DataFrame) -> DataFrame:
    """Per status: members and bytes; a member that breaks off counts as broken too."""
    return unpacked.groupBy("status").agg(F.count_if((F.col("part") == 0) | (F.col("status") != "file")).alias("n"), F.sum(F.length("content")).alias("n_bytes"))
