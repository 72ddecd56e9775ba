"""Previews that need a parser: office documents, archives, EXIF, similar names."""

from __future__ import annotations

import difflib
import io
import lzma
import re
import struct
import tarfile
import zipfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Members of an office file that hold its text, in the order in which they are tried; bytes read of one, characters and entries shown.
OFFICE_MEMBERS, OFFICE_BYTES, OFFICE_CHARS, ARCHIVE_ENTRIES = ("word/document.xml", "content.xml", "ppt/slides/slide1.xml"), 1 << 18, 6000, 200
#: What damaged, encrypted and unknown archives raise.
DAMAGED = (zipfile.BadZipFile, tarfile.TarError, zlib.error, lzma.LZMAError, OSError, EOFError, KeyError, ValueError, RuntimeError, NotImplementedError, struct.error)
#: Of an entry of a zip directory: signature, version needed, flags, lengths of name, extra fields and comment.
_ZIP_ENTRY = "<4s2xB1xH18x3H12x"
#: Of a tar header: mode, owners, size, time, check sum and the kind of a file; device numbers and the start of an empty prefix.
_TAR_NUMBERS = re.compile(rb"(?:[0-7]{7}\x00){3}([0-7]{11})\x00[0-7]{11}\x00([0-7]{6})\x00 0")
_TAR_DEVICE = re.compile(rb"(?:[0-7]{7}\x00|\x00{8}){2}\x00")
_TYPE_SIZE = {1: 1, 2: 1, 3: 2, 4: 4}


def office_text(content: bytes) -> str | None:
    """Text in the first OFFICE_BYTES of an office file's main member, without markup; else the number of its sheets; null if it has neither or is damaged."""
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            names = z.namelist()
            for member in OFFICE_MEMBERS:
                if member in names:
                    with z.open(member) as f:
                        text = re.sub(r"<[^>]+>", " ", f.read(OFFICE_BYTES).decode("utf-8", "replace"))
                    return " ".join(text.split())[:OFFICE_CHARS]
            sheets = sum(n.startswith("xl/worksheets/") for n in names)
            return f"{sheets} sheets" if sheets else None
    except DAMAGED:
        return None


def _zip_names(content: bytes) -> list[str] | None:
    """Names in a zip archive whose directory holds nothing but plain entries with ASCII names; null for all other content."""
    if len(content) < 22 or content[-22:-18] != b"PK\x05\x06":
        return None
    disk, first, here, n, size, at, comment = struct.unpack("<4H2LH", content[-18:])
    if disk or first or comment or here != n or n == 0xFFFF or at + size != len(content) - 22 or content[-42:-38] == b"PK\x06\x07":
        return None
    names, end = [], at + size
    for _ in range(n):
        if at + 46 > end:
            return None
        sign, needed, _, length, extra, note = struct.unpack_from(_ZIP_ENTRY, content, at)
        name = content[at + 46 : at + 46 + length]
        if sign != b"PK\x01\x02" or needed > 20 or extra or note or at + 46 + length > end or not name.isascii() or b"\x00" in name:
            return None
        names.append(name.decode())
        at += 46 + length
    return names if at == end else None


def _tar_names(content: bytes) -> list[str] | None:
    """Names in a tar archive of nothing but files with plain headers and ASCII names; null for all other content."""
    blocks = len(content) // 512
    # a zip archive that ends in the last 64 KiB, as that of the last file, comes first
    if not blocks or not _TAR_NUMBERS.match(content, 100) or content.rfind(b"PK\x05\x06", max(0, len(content) - 65557)) >= 0:
        return None
    sums = np.frombuffer(content, np.uint8, blocks * 512).reshape(blocks, 512).sum(axis=1, dtype=np.int64).tolist()
    names, at = [], 0
    while at < blocks:
        start = 512 * at
        if not sums[at]:
            return names
        found = _TAR_NUMBERS.match(content, start + 100)
        name = content[start : start + 100].split(b"\x00", 1)[0]
        if not found or not _TAR_DEVICE.match(content, start + 329) or not name.isascii() or int(found[2], 8) != sums[at] - sum(content[start + 148 : start + 156]) + 256:
            return None
        names.append(name.decode())
        at += 1 - -int(found[1], 8) // 512
    return None


def archive_entries(content: bytes) -> list[str] | None:
    """Names in a zip or tar archive; null if it is neither. Plain archives are read by their headers alone, all others by the standard library."""
    for plain in (_zip_names, _tar_names):
        names = plain(content)
        if names is not None:
            return names
    try:
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            return z.namelist()
    except DAMAGED:
        pass
    try:
        with tarfile.open(fileobj=io.BytesIO(content)) as t:
            return t.getnames()
    except DAMAGED:
        return None


def archive_text(content: bytes) -> str | None:
    """Number of entries and the first names."""
    names = archive_entries(content)
    return None if names is None else "\n".join([f"{len(names)} entries", *names[:ARCHIVE_ENTRIES]])


def exif_fields(content: bytes) -> tuple[str | None, str | None]:
    """(the first DateTime or DateTimeOriginal in the order of the tags, camera model) from a JPEG's EXIF block; null where there is none."""
    at = content.find(b"Exif\x00\x00")
    if at < 0:
        return None, None
    tiff = content[at + 6 :]
    order = {b"II": "<", b"MM": ">"}.get(tiff[:2])
    found: dict[int, str] = {}
    if order is None:
        return None, None

    def read(offset: int, depth: int = 0) -> None:
        (count,) = struct.unpack_from(f"{order}H", tiff, offset)
        for i in range(count):
            tag, kind, n, value = struct.unpack_from(f"{order}HHI4s", tiff, offset + 2 + 12 * i)
            if kind == 2:
                start = struct.unpack(f"{order}I", value)[0]
                raw = value[:n] if n <= 4 else tiff[start : start + n]
                found.setdefault(tag, raw.split(b"\x00")[0].decode("ascii", "replace"))
            elif tag == 0x8769 and depth == 0:
                read(struct.unpack(f"{order}I", value)[0], 1)

    try:
        read(struct.unpack_from(f"{order}I", tiff, 4)[0])
    except struct.error:
        pass
    model = found.get(0x0110, "").strip() or None
    return next((found[tag] for tag in found if tag in (0x0132, 0x9003)), None), model


def name_similarity(a: str, b: str) -> float:
    """Ratio of matching blocks of two lower-case stems."""
    stem = lambda name: name.rsplit("/", 1)[-1].rsplit(".", 1)[0].lower()
    return difflib.SequenceMatcher(None, stem(a), stem(b)).ratio()


def with_name_similarity(pairs: DataFrame, name: str = "similarity") -> DataFrame:
    """``pairs`` (a, b: paths) with name_similarity in the column ``name``; null where a path is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [None if a is None or b is None else name_similarity(a, b) for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.float64())], names=["a", "b", name])

    return pairs.select("a", "b").mapInArrow(run, f"a string, b string, {name} double")


def with_parsed(files: DataFrame, parser, name: str) -> DataFrame:
    """(path, name) where the column ``name`` is ``parser`` (bytes to str or None) of each file's content."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = pa.array([parser(c.as_py() or b"") for c in batch.column(1)], pa.string())
            yield pa.RecordBatch.from_arrays([batch.column(0), found], names=["path", name])

    return files.select("path", "content").mapInArrow(run, f"path string, {name} string")
