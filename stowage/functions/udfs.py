"""Codec and header functions over Arrow batches, and their registration for SQL.

Bytes that can't be decoded or parameters out of range give an error text
beside a null, never a failed job.
"""

from __future__ import annotations

import posixpath
import struct

import pandas as pd
from pyspark.sql import SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from stowage import codec, schema
from stowage.codec.trees import code_lengths
from stowage.functions import columns

RESULT = T.StructType([T.StructField("data", T.BinaryType()), T.StructField("error", T.StringType())])


def _tried(act, *args) -> tuple[bytes | None, str | None]:
    try:
        return act(*args), None
    except (codec.CodecError, struct.error) as e:
        return None, str(e)


def _frame(rows: list[tuple[bytes | None, str | None]]) -> pd.DataFrame:
    return pd.DataFrame({"data": pd.Series([r[0] for r in rows], dtype=object), "error": pd.Series([r[1] for r in rows], dtype=object)})


def _encoded(together, alone, raw: pd.Series, method: pd.Series, level: pd.Series) -> pd.DataFrame:
    """Those of one method and level encoded together; if that fails, one by one."""
    out: list[tuple[bytes | None, str | None]] = [(None, None)] * len(raw)
    kinds: dict[tuple[int, int], list[int]] = {}
    for i, (b, m, n) in enumerate(zip(raw, method, level, strict=True)):
        if b is not None:
            kinds.setdefault((int(m), int(n)), []).append(i)
    for kind, rows in kinds.items():
        data = [bytes(raw.iat[i]) for i in rows]
        made, error = _tried(together, data, *kind)
        for i, r in zip(rows, [(b, None) for b in made] if error is None else [_tried(alone, b, *kind) for b in data], strict=True):
            out[i] = r
    return _frame(out)


@F.pandas_udf(RESULT)
def encode_block(raw: pd.Series, method: pd.Series, level: pd.Series) -> pd.DataFrame:
    """One block of content, encoded."""
    return _encoded(codec.encode_blocks, codec.encode_block, raw, method, level)


@F.pandas_udf(RESULT)
def encode_content(raw: pd.Series, method: pd.Series, level: pd.Series) -> pd.DataFrame:
    """A whole content, encoded block by block."""
    return _encoded(codec.encode_contents, codec.encode_content, raw, method, level)


@F.pandas_udf(RESULT)
def decode_content(data: pd.Series, method: pd.Series, level: pd.Series) -> pd.DataFrame:
    return _frame(codec.decode_contents([(None if b is None else bytes(b), int(m), int(n)) for b, m, n in zip(data, method, level, strict=True)]))


@F.pandas_udf(T.ArrayType(T.IntegerType()))
def huffman_lengths(freqs: pd.Series) -> pd.Series:
    """Optimal code lengths of at most 15 bits for each array of frequencies."""
    return pd.Series([None if f is None else code_lengths(f).tolist() for f in freqs])


@F.pandas_udf(T.BinaryType())
def header_bytes(version: pd.Series, size: pd.Series, method: pd.Series, level: pd.Series, kind: pd.Series, permissions: pd.Series, path: pd.Series) -> pd.Series:
    """The header of an entry; null if a field is out of range."""
    out = []
    for v, s, m, n, t, p, name in zip(version, size, method, level, kind, permissions, path, strict=True):
        raw = name.encode()
        fine = m in codec.METHODS.values() and 0 <= t <= 3 and len(raw) <= schema.MAX_PATH and s >= 0
        out.append(struct.pack(schema.HEADER, int(v), int(s), int(m), int(n), int(t) << 9 | int(p) & 0o777, len(raw)) + raw if fine else None)
    return pd.Series(out, dtype=object)


@F.pandas_udf(T.StringType())
def portable_path(path: pd.Series, is_dir: pd.Series) -> pd.Series:
    """A path in lexical normal form; directories end in a slash."""

    def made(p: str | None, d: bool) -> str | None:
        if p is None:
            return None
        p = posixpath.normpath(p) if p else p
        p = "/" + p.lstrip("/") if p.startswith("//") else p
        return p + "/" if d and not p.endswith("/") else p

    return pd.Series([made(p, d) for p, d in zip(path, is_dir, strict=True)], dtype=object)


@F.udtf(returnType="archive string, ord bigint, pos bigint, version bigint, content_size bigint, method int, level int, entry_type int, permissions int, path string")
class ArchiveEntries:
    """The catalog of the archive at a path, as a table function."""

    def eval(self, path: str):
        from stowage.sources.archive import ArchiveReader

        reader = ArchiveReader(path, False)
        for stretch in reader.partitions():
            for batch in reader.read(stretch):
                yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


#: Functions in SQL itself, which the optimiser takes apart as it does columns.
SQL_FUNCTIONS = {
    "within_dir(path string, dir string) returns boolean": "startswith(path, dir) and (endswith(dir, '/') or length(path) = length(dir) or substr(path, length(dir) + 1, 1) = '/')",
    "mode_string(entry_type int, permissions int) returns string": "case entry_type when 1 then '-' when 2 then 'd' when 3 then 'l' else '?' end || "
    + " || ".join(f"if(permissions & {1 << (8 - i)} <> 0, '{'rwx'[i % 3]}', '-')" for i in range(9)),
    "header_size(path string) returns bigint": f"cast({schema.HEADER_BYTES} + octet_length(path) as bigint)",
}


def register(spark: SparkSession) -> None:
    """Makes the functions callable from SQL: codecs, headers and paths, directories, modes and sizes, and the catalog of an archive as a table."""
    for name, function in (("encode_block", encode_block), ("encode_content", encode_content), ("decode_content", decode_content), ("huffman_lengths", huffman_lengths), ("header_bytes", header_bytes), ("portable_path", portable_path)):
        spark.udf.register(name, function)
    spark.udtf.register("archive_entries", ArchiveEntries)
    for head, body in SQL_FUNCTIONS.items():
        spark.sql(f"create or replace temporary function {head} return {body}")


__all__ = ["ArchiveEntries", "columns", "decode_content", "encode_block", "encode_content", "header_bytes", "huffman_lengths", "portable_path", "register"]
