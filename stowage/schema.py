"""The data model: entry types, permissions, versions and the catalog's columns. Fixed values of the archive format."""

from __future__ import annotations

from pyspark.sql import types as T

VERSION = (0, 1, 1)
HEADER = "<IQBBHH"  # version, content size, method, level, attributes, path length
HEADER_BYTES = 18
MAX_PATH = 65535

NO_TYPE, FILE, DIRECTORY, SYMLINK = 0, 1, 2, 3
TYPE_LETTERS = {NO_TYPE: "?", FILE: "-", DIRECTORY: "d", SYMLINK: "l"}
TYPE_NAMES = {"none": NO_TYPE, "regular file": FILE, "directory": DIRECTORY, "symlink": SYMLINK}
PERMISSIONS = 0o777

#: One row per entry; ``ord`` orders the entries of an archive, ``pos`` is the byte at which one begins.
CATALOG = T.StructType(
    [
        T.StructField("archive", T.StringType()),
        T.StructField("ord", T.LongType()),
        T.StructField("pos", T.LongType()),
        T.StructField("version", T.LongType()),
        T.StructField("content_size", T.LongType()),
        T.StructField("method", T.ByteType()),
        T.StructField("level", T.ByteType()),
        T.StructField("entry_type", T.ByteType()),
        T.StructField("permissions", T.ShortType()),
        T.StructField("path", T.StringType()),
    ]
)
#: The catalog with each entry's encoded content.
ENTRIES = T.StructType([*CATALOG.fields, T.StructField("payload", T.BinaryType())])


def pack_version(version: tuple[int, int, int] = VERSION) -> int:
    major, minor, patch = version
    return (major & 0xFFF) << 20 | (minor & 0x3FF) << 10 | patch & 0x3FF
