import os

import pytest
from pyspark.sql import functions as F

from stowage.archive import Archive
from stowage.cli import Session, UsageError, arguments, log_level, parse_compression
from stowage.codec import CodecError
from stowage.streaming.append import add_batch, append_stream


@pytest.mark.parametrize("spec, want", [("none", (0, 0)), ("huffman", (1, 1)), ("deflate", (2, 0)), ("huffman/3", (1, 3)), ("7", (2, 7)), ("0", (2, 0)), ("deflate/x", (2, 0))])
def test_compression(spec, want):
    assert parse_compression(spec, 2, 8) == want


@pytest.mark.parametrize("spec", ["", "zip", "9", "none/1", "deflate/", "deflate7", "huffman/0"])
def test_bad_compression(spec):
    with pytest.raises(UsageError):
        parse_compression(spec, 2, 8)


def test_arguments():
    assert list(arguments(["a", "-rC", "none", "--dir", "d", "-", "--no-recurse"])) == [("", "a"), ("recurse", None), ("compression", "none"), ("dir", "d"), ("", "-"), ("no-recurse", None)]
    with pytest.raises(UsageError):
        list(arguments(["--dir"]))


def test_session(spark, tmp_path):
    (tmp_path / "in" / "d").mkdir(parents=True)
    (tmp_path / "in" / "d" / "x").write_text("content of x")
    (tmp_path / "in" / "y").write_text("content of y")
    os.symlink("y", tmp_path / "in" / "l")
    lines = []
    archive, base = str(tmp_path / "a"), str(tmp_path / "in")
    Session(spark, lines.append).run([archive, "-D", base, "-r", "d", "y", "--no-recurse", "l", "gone", "-L", "-R", "y", "nothing", "-L"])
    assert [x.split("    ")[1] for x in lines if "    " in x] == ["d/", "d/x", "y", "l -> y", "d/", "d/x", "l -> y"]
    assert [x for x in lines if "    " not in x] == ["gone: gone: No such file or directory", "nothing: non-existent path"]
    out = tmp_path / "out"
    out.mkdir()
    Session(spark, lines.append).run([archive, "-D", str(out), "-X", "*"])
    assert (out / "d" / "x").read_text() == "content of x" and os.readlink(out / "l") == "y"
    Session(spark, lines.append).run([archive, "-R", "*"])
    assert not os.path.exists(archive)


def test_stream(spark, tmp_path):
    rows = spark.range(6).select(F.concat(F.lit("f"), "id").alias("path"), F.lit(1).alias("entry_type"), F.lit(0o644).alias("permissions"), F.concat(F.lit("text "), "id").cast("binary").alias("content"))
    rows.write.parquet(f"{tmp_path}/in")
    query = append_stream(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"), f"{tmp_path}/a", f"{tmp_path}/c")
    query.processAllAvailable()
    rows.limit(1).withColumn("path", F.lit("late")).write.mode("append").parquet(f"{tmp_path}/in")
    query.processAllAvailable()
    query.stop()
    found = Archive(spark, f"{tmp_path}/a").contents().orderBy("ord").collect()
    assert found[-1].path == "late" and sorted(bytes(r.content).decode() for r in found[:-1]) == [f"text {i}" for i in range(6)]


def inputs(spark, *rows):
    return spark.createDataFrame(list(rows), "path string, entry_type int, permissions int, content binary")


def test_streams_keep_to_their_own_parts(spark, tmp_path):
    a = Archive(spark, f"{tmp_path}/a")
    for name in ("first", "second"):
        inputs(spark, (name, 1, 0o644, name.encode())).write.parquet(f"{tmp_path}/in-{name}")
        schema = spark.read.parquet(f"{tmp_path}/in-{name}").schema
        query = append_stream(spark.readStream.schema(schema).parquet(f"{tmp_path}/in-{name}"), f"{tmp_path}/a", f"{tmp_path}/c-{name}")
        query.processAllAvailable()
        query.stop()
    assert sorted(r.path for r in a.entries().collect()) == ["first", "second"]


def test_a_repeated_batch_replaces_what_it_wrote(spark, tmp_path):
    a = Archive(spark, f"{tmp_path}/a")
    rows = inputs(spark, *((f"f{i}", 1, 0o644, b"x" * i) for i in range(12)))
    add_batch(inputs(spark, ("before", 1, 0, b"")), 0, a.path, "s")
    add_batch(rows.repartition(6), 1, a.path, "s")
    add_batch(inputs(spark, ("other", 1, 0, b"")), 1, a.path, "t")
    add_batch(rows.coalesce(1), 1, a.path, "s")
    assert sorted(r.path for r in a.entries().collect()) == sorted(["before", "other", *(f"f{i}" for i in range(12))])


def test_inputs_that_cannot_be_written_are_listed(spark, tmp_path):
    a = Archive(spark, f"{tmp_path}/a")
    rows = inputs(spark, ("fine", 1, 0o644, b"1"), (None, 1, 0, b"2"), ("odd", 9, 0, b"3"), ("none", 1, None, None))
    add_batch(rows, 0, a.path, "s", 2, 3, f"{tmp_path}/status")
    assert sorted(r.path for r in a.entries().collect()) == ["fine", "none"]
    status = {r.path: r.error for r in spark.read.parquet(f"{tmp_path}/status").collect()}
    assert status == {"fine": None, None: "no path", "odd": "unknown entry type", "none": None}
    with pytest.raises(CodecError):
        append_stream(rows, a.path, f"{tmp_path}/c", 1, 0)


@pytest.mark.parametrize("value, want", [("trace", 5), ("DEBUG", 10), ("I", 20), ("3", 30), ("e", 40), ("off", 60), ("6", 60)])
def test_log_levels(value, want):
    assert log_level(value) == want


@pytest.mark.parametrize("value", ["", "7", "x", "warning!", "-1"])
def test_bad_log_levels(value):
    with pytest.raises(UsageError):
        log_level(value)


def test_session_on_a_single_file(spark, tmp_path):
    (tmp_path / "x").write_text("content of x")
    Session(spark).run([f"{tmp_path}/one.stow", "-D", str(tmp_path), "x"])
    assert (tmp_path / "one.stow").is_file()
    lines = []
    Session(spark, lines.append).run([f"{tmp_path}/one.stow", "-L"])
    assert [x.split("    ")[1] for x in lines] == ["x"]
