"""Command line: options and paths are read in order, and each option holds for the paths behind it.

    python -m stowage.cli ARCHIVE [-A] PATH... [-R PATH...] [-X PATH...] [-L] ...

The first path names the archive. Appends and removals are gathered until a
listing, an extraction or the end. ``*`` stands for all entries.
"""

from __future__ import annotations

import logging
import os
import sys
from collections.abc import Iterator

from stowage.archive import Archive
from stowage.codec.levels import LEVELS, METHODS, NAMES

HELP = """usage: ARCHIVE [options and paths]
  -A, --append        paths that follow are appended (the default)
  -R, --remove        paths that follow are removed; * removes all
  -X, --extract       paths that follow are extracted; * extracts all
  -L, --list          list the entries
  -r, --recurse       with all that folders hold; --no-recurse ends it
  -C, --compression   METHOD, LEVEL or METHOD/LEVEL; methods: none, huffman, deflate
  -l, --log-level     trace, debug, info, warn, error, critical or off, their first letters, or 0 to 6; in any case
  -D, --dir           folder that paths start from
  -h, --help          this text"""

SHORT = {"A": "append", "R": "remove", "X": "extract", "L": "list", "r": "recurse", "C": "compression", "l": "log-level", "D": "dir", "h": "help"}
FLAGS = {"append", "remove", "extract", "list", "recurse", "no-recurse", "help"}
WITH_VALUE = {"compression", "log-level", "dir"}
#: From the most to the least detailed; their digits count from 0, and a letter is a name's first.
LOG_LEVELS = {"trace": 5, "debug": logging.DEBUG, "info": logging.INFO, "warn": logging.WARNING, "error": logging.ERROR, "critical": logging.CRITICAL, "off": logging.CRITICAL + 10}


class UsageError(ValueError):
    """Arguments that can't be carried out."""


def parse_compression(spec: str, method: int, level: int) -> tuple[int, int]:
    """A method alone takes its least level, a level alone keeps the method."""
    name = next((m for m in METHODS if spec.startswith(m)), "")
    rest = spec[len(name) :]
    if name:
        method, level = METHODS[name], LEVELS[METHODS[name]][0]
        if not rest:
            return method, level
        if rest[0] != "/":
            raise UsageError(f"invalid compression {spec!r}")
        rest = rest[1:]
    digits = rest[: next((i for i, ch in enumerate(rest) if ch not in "0123456789"), len(rest))]
    if not digits:
        if name and rest:
            return method, level
        raise UsageError(f"invalid compression {spec!r}")
    least, most = LEVELS[method]
    if not least <= int(digits) <= most:
        raise UsageError(f"compression level {digits} of {NAMES[method]} is out of range {least} to {most}")
    return method, int(digits)


def log_level(value: str) -> int:
    """The level of a name, its first letter or its digit, in any case."""
    for digit, (name, level) in enumerate(LOG_LEVELS.items()):
        if value.lower() in (name, name[0], str(digit)):
            return level
    raise UsageError(f"unknown log level {value}")


def arguments(argv: list[str]) -> Iterator[tuple[str, str | None]]:
    """(option, value) and ("", path) in order; short options may be grouped."""
    rest = iter(argv)
    for arg in rest:
        if arg.startswith("--") and len(arg) > 2:
            names = [arg[2:]]
        elif arg.startswith("-") and len(arg) > 1:
            names = [SHORT.get(ch, ch) for ch in arg[1:]]
        else:
            yield "", arg
            continue
        for name in names:
            if name in WITH_VALUE:
                value = next(rest, None)
                if value is None:
                    raise UsageError(f"option {name} needs a value")
                yield name, value
            elif name in FLAGS:
                yield name, None
            else:
                print(f"unknown option: {name}", file=sys.stderr)


class Session:
    def __init__(self, spark, out=print) -> None:
        self.spark, self.out = spark, out
        self.archive: Archive | None = None
        self.mode, self.recurse, self.base = "append", False, "."
        self.method, self.level = METHODS["deflate"], 8
        self.dirty = False

    def run(self, argv: list[str]) -> int:
        for option, value in arguments(argv):
            if option == "help":
                self.out(HELP)
            elif option in ("append", "remove", "extract"):
                self.mode = option
            elif option in ("recurse", "no-recurse"):
                self.recurse = option == "recurse"
            elif option == "compression":
                self.method, self.level = parse_compression(value, self.method, self.level)
            elif option == "log-level":
                logging.getLogger("stowage").setLevel(log_level(value))
            elif option == "dir":
                if not os.path.isdir(value):
                    raise UsageError(f"no such folder: {value}")
                self.base = value
            elif option == "list":
                self.list()
            elif self.archive is None:
                self.open(value)
            else:
                getattr(self, self.mode)(value)
        self.close()
        return 0

    def open(self, path: str) -> None:
        self.archive = Archive(self.spark, path)
        if self.archive.is_corrupted():
            logging.getLogger("stowage").warning("the archive is corrupted: %s", path)

    def _needed(self) -> Archive:
        if self.archive is None:
            raise UsageError("no archive named")
        return self.archive

    def append(self, path: str) -> None:
        self._needed().will_append_files(self.base, [path], self.recurse, self.method, self.level)
        self.dirty = True

    def remove(self, path: str) -> None:
        a = self._needed()
        if path == "*":
            a.will_remove_all()
        else:
            found = a.within(path) if self.recurse else a.find(path)
            if found.isEmpty():
                self.out(f"{path}: non-existent path")
                return
            a.will_remove(found)
        self.dirty = True

    def extract(self, path: str) -> None:
        self.flush()
        status = self._needed().extract(self.base, None if path == "*" else path, self.recurse)
        self._report(status)

    def list(self) -> None:
        self.flush()
        for r in self._needed().list().toLocalIterator():
            self.out(f"{r['mode']}    {r['path']}" + (f" -> {r['target']}" if r["target"] is not None else ""))

    def flush(self) -> None:
        if self.dirty:
            self._report(self._needed().write())
            self.dirty = False

    def _report(self, status) -> None:
        for r in status.where("error is not null").toLocalIterator():
            self.out(f"{r['path']}: {r['error']}")

    def close(self) -> None:
        """Writes what is pending; an archive without entries goes."""
        self.flush()
        if self.archive is not None and self.archive.entries().isEmpty():
            self.archive.delete()


def main(argv: list[str] | None = None) -> int:
    from pyspark.sql import SparkSession

    argv = sys.argv[1:] if argv is None else argv
    if not argv or argv in (["-h"], ["--help"]):
        print(HELP)
        return 0
    spark = SparkSession.builder.appName("stowage").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    try:
        return Session(spark).run(argv)
    except UsageError as e:
        print(f"error: {e}", file=sys.stderr)
        return 1


if __name__ == "__main__":
    sys.exit(main())
