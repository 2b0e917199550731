"""Catalog functions as native columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from stowage import schema
from stowage.codec.levels import LEVELS, METHODS

C = Column | str


def col(c: C) -> Column:
    return F.col(c) if isinstance(c, str) else c


def pack_attributes(entry_type: C, permissions: C) -> Column:
    return F.shiftleft(col(entry_type).cast("int"), 9).bitwiseOR(col(permissions).cast("int").bitwiseAND(schema.PERMISSIONS))


def attribute_type(attributes: C) -> Column:
    return F.shiftright(col(attributes).cast("int"), 9)


def attribute_permissions(attributes: C) -> Column:
    return col(attributes).cast("int").bitwiseAND(schema.PERMISSIONS)


def pack_version(major: C, minor: C, patch: C) -> Column:
    part = lambda c, bits: col(c).cast("long").bitwiseAND((1 << bits) - 1)
    return F.shiftleft(part(major, 12), 20).bitwiseOR(F.shiftleft(part(minor, 10), 10)).bitwiseOR(part(patch, 10))


def version_parts(version: C) -> Column:
    v = col(version).cast("long")
    part = lambda shift, bits: F.shiftright(v, shift).bitwiseAND((1 << bits) - 1).cast("int")
    return F.struct(part(20, 12).alias("major"), part(10, 10).alias("minor"), part(0, 10).alias("patch"))


def has_flag(flags: C, flag: int) -> Column:
    return col(flags).cast("int").bitwiseAND(flag) == flag


def switch_flag(flag: int, on: C) -> Column:
    return F.when(col(on), F.lit(flag)).otherwise(F.lit(0))


def mode_string(entry_type: C, permissions: C) -> Column:
    """As in ``drwxr-xr-x``."""
    kind = F.lit("?")
    for number, letter in schema.TYPE_LETTERS.items():
        kind = F.when(col(entry_type) == number, letter).otherwise(kind)
    bits = [F.when(has_flag(permissions, 1 << (8 - i)), "rwx"[i % 3]).otherwise("-") for i in range(9)]
    return F.concat(kind, *bits)


def header_size(path: C) -> Column:
    return (F.lit(schema.HEADER_BYTES) + F.octet_length(col(path))).cast("long")


def full_size(path: C, content_size: C) -> Column:
    return header_size(path) + col(content_size).cast("long")


def within_dir(path: C, directory: str) -> Column:
    """Whether a path is ``directory`` or lies in it; an empty directory holds only empty and absolute paths."""
    p = col(path)
    if directory.endswith("/"):
        return p.startswith(directory)
    rest = F.substring(p, len(directory) + 1, 1)
    return p.startswith(directory) & ((rest == "") | (rest == "/"))


def valid_header(method: C, entry_type: C) -> Column:
    return col(method).isin(list(LEVELS)) & col(entry_type).between(0, 3)


def parse_compression(spec: C, method: int = METHODS["deflate"], level: int = 8) -> Column:
    """(method, level, error) of ``method``, ``level`` or ``method/level``; a method alone means its least level, a level alone keeps ``method``."""
    s = col(spec)
    name = F.regexp_extract(s, "^(none|huffman|deflate)", 1)
    rest = F.substring(s, F.length(name) + 1, F.length(s))
    named = name != ""
    number = F.lit(method)
    least, most = F.lit(LEVELS[method][0]), F.lit(LEVELS[method][1])
    for text, code in METHODS.items():
        number = F.when(name == text, code).otherwise(number)
        least = F.when(name == text, LEVELS[code][0]).otherwise(least)
        most = F.when(name == text, LEVELS[code][1]).otherwise(most)
    digits = F.regexp_extract(rest, "^/?([0-9]+)", 1)
    after = F.when(named, F.substring(rest, 2, 1)).otherwise(F.substring(rest, 1, 1))
    slash = F.substring(rest, 1, 1) == "/"
    asked = F.when(F.length(digits) <= 3, digits.cast("int"))
    has_digit = after.rlike("^[0-9]")
    error = (
        F.when(s.isNull() | (s == ""), "empty")
        .when(named & (rest == ""), F.lit(None).cast("string"))
        .when(named & ~slash, "invalid")
        .when(named & (F.length(rest) == 1), "invalid")
        .when(has_digit & (asked.isNull() | (asked > 255)), "out of range")
        .when(has_digit & ~asked.between(least, most), "out of range")
        .when(~has_digit & ~named, "invalid")
    )
    chosen = F.when(has_digit, asked).when(named, least).otherwise(F.lit(level))
    ok = error.isNull()
    return F.struct(F.when(ok, number).alias("method"), F.when(ok, chosen).alias("level"), error.alias("error"))


def length_symbol(length: C) -> Column:
    """The symbol of a match length from 3 to 258."""
    x = col(length).cast("int") - 3
    extra = F.greatest(F.floor(F.log2(F.greatest(x, F.lit(1)))).cast("int") - 2, F.lit(0))
    plain = F.when(x < 4, x).otherwise(4 * extra + F.floor(x / F.pow(F.lit(2), extra)).cast("int"))
    return F.when(col(length) == 258, 28).otherwise(plain).cast("int")


def length_extra_bits(length: C) -> Column:
    x = col(length).cast("int") - 3
    return F.when((col(length) == 258) | (x < 4), 0).otherwise(F.floor(F.log2(x)).cast("int") - 2).cast("int")


def distance_symbol(distance: C) -> Column:
    """The symbol of a match distance from 1 to 32768."""
    x = col(distance).cast("int") - 1
    extra = distance_extra_bits(distance)
    return F.when(x < 2, x).otherwise(2 * extra + F.floor(x / F.pow(F.lit(2), extra)).cast("int")).cast("int")


def distance_extra_bits(distance: C) -> Column:
    x = col(distance).cast("int") - 1
    return F.when(x < 4, 0).otherwise(F.floor(F.log2(F.greatest(x, F.lit(1)))).cast("int") - 1).cast("int")


#: The alphabet of literals and lengths, and marks and fields of packed tokens.
END_SYMBOL, FIRST_LENGTH_SYMBOL, LAST_LENGTH_SYMBOL, LAST_DISTANCE_SYMBOL = 256, 257, 285, 29
NO_TOKEN, MATCH_MARK = 0x6000, 0x8000


def is_literal(symbol: C) -> Column:
    return col(symbol) < END_SYMBOL


def is_end(symbol: C) -> Column:
    return col(symbol) == END_SYMBOL


def is_length(symbol: C) -> Column:
    return col(symbol).between(FIRST_LENGTH_SYMBOL, LAST_LENGTH_SYMBOL)


def is_distance(symbol: C) -> Column:
    return col(symbol).between(0, LAST_DISTANCE_SYMBOL)


def litlen_symbol(literal: C, length: C) -> Column:
    """The symbol of a literal byte, or of a length's own symbol where there is no literal."""
    return F.coalesce(col(literal).cast("int").bitwiseAND(0xFF), col(length).cast("int") + FIRST_LENGTH_SYMBOL)


def literal_of(symbol: C) -> Column:
    return F.when(is_literal(symbol), col(symbol).cast("int"))


def length_of(symbol: C) -> Column:
    """The length's own symbol of one in the joint alphabet."""
    return F.when(is_length(symbol), col(symbol).cast("int") - FIRST_LENGTH_SYMBOL)


def pack_match(extra: C, length: C, distance: C) -> Column:
    """A packed token: extra bits of the length, its symbol and the distance's symbol, five bits each."""
    part = lambda c: col(c).cast("int").bitwiseAND(31)
    return F.lit(MATCH_MARK).bitwiseOR(F.shiftleft(part(extra), 10)).bitwiseOR(F.shiftleft(part(length), 5)).bitwiseOR(part(distance))


def pack_distance_extra(extra: C) -> Column:
    """The packed token that follows a match: up to 13 extra bits of its distance."""
    return col(extra).cast("int").bitwiseAND(0x1FFF)


def token_parts(packed: C) -> Column:
    """What a packed token holds: whether it is none or a match, and the fields of each reading."""
    p = col(packed).cast("int")
    match = p.bitwiseAND(MATCH_MARK) != 0
    field = lambda shift, mask: F.shiftright(p, shift).bitwiseAND(mask)
    return F.struct(
        (p == NO_TOKEN).alias("is_none"),
        match.alias("is_match"),
        F.when(match, field(10, 31)).alias("length_extra"),
        F.when(match, field(5, 31)).alias("length_symbol"),
        F.when(match, field(0, 31)).alias("distance_symbol"),
        F.when(~match, field(0, 0x1FFF)).alias("distance_extra"),
        F.when(~match, field(0, 0xFF)).alias("literal"),
    )


def named(numbers: C, names: dict[str, int]) -> Column:
    out = F.lit("unknown")
    for name, number in names.items():
        out = F.when(col(numbers) == number, name).otherwise(out)
    return out


def compression_string(method: C, level: C) -> Column:
    """As in ``deflate/8``."""
    return F.concat(named(method, METHODS), F.lit("/"), col(level).cast("string"))


def entry_type_string(entry_type: C) -> Column:
    return named(entry_type, schema.TYPE_NAMES)


def version_string(version: C) -> Column:
    parts = version_parts(version)
    return F.concat_ws(".", *(parts[n].cast("string") for n in ("major", "minor", "patch")))


def error_chain(*reasons: C) -> Column:
    """Errors from the outermost to the root cause, nulls left out."""
    return F.concat_ws(" because of ", *map(col, reasons))
