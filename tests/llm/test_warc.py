import hashlib
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from stowage.llm import warc


def made(i, payload=b"<p>x</p>", **kw):
    return warc.record(i, f"http://a/{i}", payload, hashlib.sha1(payload).digest(), kw.get("refers_to"), "refers_to" in kw)


def tiles(data):
    found = list(warc.salvage(data))
    at = 0
    for _, start, end, _ in found:
        assert start == at
        at = end
    assert at == len(data)
    return found


def test_plain_and_compressed_round_trip():
    rows = [made(i, bytes([65 + i]) * i * 100) for i in range(5)]
    plain = b"".join(r + warc.END for r in rows)
    packed = b"".join(warc.member(r) for r in rows)
    for data in (plain, packed):
        found = tiles(data)
        assert [k for k, *_ in found] == ["record"] * 5
        assert [x["payload"] for *_, x in found] == [bytes([65 + i]) * i * 100 for i in range(5)]


@pytest.mark.parametrize("compressed", [False, True])
def test_salvage_after_damage(compressed):
    rng = random.Random(5)
    for _ in range(60):
        rows = [made(i, rng.randbytes(rng.randint(0, 400))) for i in range(8)]
        parts = [warc.member(r) if compressed else r + warc.END for r in rows]
        hurt = rng.randrange(8)
        bad = bytearray(parts[hurt])
        bad[rng.randrange(12) if not compressed else rng.randrange(4)] ^= 0xFF
        data = b"".join(parts[:hurt]) + bytes(bad) + b"".join(parts[hurt + 1 :])
        found = tiles(data)
        ids = [x["warc-record-id"] for k, *_, x in found if k == "record"]
        assert ids == [f"<urn:page:{i}>" for i in range(8) if i != hurt]
        assert sum(k == "gap" for k, *_ in found) == 1


def test_garbage_truncation_and_digest():
    one, two = made(1) + warc.END, made(2, b"abc") + warc.END
    assert [k for k, *_ in tiles(b"junk" + one + b"WARC/1.1\r\nbroken" + two)] == ["gap", "record", "gap", "record"]
    assert [k for k, *_ in tiles(one + two[:-3])] == ["record", "gap"]
    assert [k for k, *_ in tiles(one + two.replace(b"abc", b"abd"))] == ["record", "gap"]
    assert tiles(b"") == []


def test_query_against_brute_force(spark, tmp_path):
    long, short = "é" * 600, "x" * 999
    rows = [(1, "u", long), (2, None, long), (3, "u\r\nv%", None), (4, "w", short), (5, "w", short), (6, "z", "a\r\n\r\nWARC/1.1\r\n" + long), (7, "q", long), (None, "n", long), (7, "q", long)]
    docs = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("kind", F.lit("clash"))
    docs.write.parquet(f"{tmp_path}/pages.parquet")
    got = sorted((tuple(r) for r in warc.op9_warc(spark, str(tmp_path)).collect()), key=str)
    want = []
    for page_id, _, html in rows:
        body = (html or "").encode()
        same = [i for i, _, h in rows if (h or "") == (html or "") and i is not None]
        refers = max(same) if len(body) >= 1000 and page_id != max(same) else None
        want.append((page_id, len(body), hashlib.sha1(body).hexdigest(), "revisit" if refers else "response", refers))
    assert got == sorted(want, key=str)


def test_empty_table_and_urls(spark, tmp_path):
    empty = spark.createDataFrame([], "page_id long, url string, html string")
    empty.write.parquet(f"{tmp_path}/pages.parquet")
    assert warc.op9_warc(spark, str(tmp_path)).count() == 0
    warc.write(warc.plan(spark.createDataFrame([(1, "a\r\nb%0Ac", "x")], "page_id long, url string, html string")), f"{tmp_path}/w")
    assert [r.url for r in warc.read(spark, f"{tmp_path}/w").collect()] == ["a\r\nb%0Ac"]


PIECES = [warc.VERSION, warc.END, warc.MEMBER, b"Content-Length: ", b"9" * 5000, b"3", b"WARC-Type: revisit\r\n", b"WARC-Payload-Digest: sha1:ABC\r\n", b"WARC-Record-ID: <urn:page:--5>\r\n", made(7) + warc.END, warc.member(made(8)), made(9).replace(b"urn:page:9", "urn:page:²".encode()) + warc.END]


@settings(max_examples=300, deadline=None)
@given(st.lists(st.one_of(st.sampled_from(PIECES), st.binary(max_size=8)), max_size=12))
def test_any_bytes_are_tiled(parts):
    for kind, _, _, x in tiles(b"".join(parts)):
        if kind == "record":
            warc.number(x.get("warc-record-id", ""))
            assert x["warc-type"] != "revisit" or not x.get("warc-payload-digest") or warc.label_digest(x["warc-payload-digest"])


def test_odd_headers():
    digits = made(1).replace(b"Content-Length: 8", b"Content-Length: " + b"9" * 5000)
    assert [k for k, *_ in tiles(digits + warc.END + made(2) + warc.END)] == ["gap", "record"]
    padded = made(1).replace(b"Content-Length: 8", b"Content-Length: 0000000000000000000000000008")
    assert [k for k, *_ in tiles(padded + warc.END)] == ["record"]
    hexed = made(1).replace(warc.sha1_label(hashlib.sha1(b"<p>x</p>").digest()).encode(), b"sha1:" + hashlib.sha1(b"<p>x</p>").hexdigest().encode())
    assert [k for k, *_ in tiles(hexed + warc.END)] == ["record"]
    assert [warc.number(x) for x in ("<urn:page:5>", "urn:page:-5", "<urn:page:--5>", "<urn:page:²>", "<urn:page:>", f"<urn:page:{1 << 63}>", "x")] == [5, -5, None, None, None, None, None]
    nested = warc.member(warc.member(made(1)))
    assert [k for k, *_ in tiles(nested)] == ["gap"]


def test_reading_damaged_and_compressed_archives(spark, tmp_path):
    (tmp_path / "w").mkdir()
    broken = made(3).replace(b"sha1:", b"sha1:!").replace(b"response", b"revisit")
    (tmp_path / "w" / "a.txt").write_bytes(b"junk" + made(1) + warc.END + broken + warc.END + made(2).replace(b"urn:page:2", b"urn:page:--2") + warc.END)
    (tmp_path / "w" / "b.txt.gz").write_bytes(warc.member(made(4)) + b"\x1f\x8b\x08bad" + warc.member(made(5)) + warc.member(made(6))[:-9])
    found = warc.read(spark, f"{tmp_path}/w")
    assert sorted((r.page_id or 0, r.digest) for r in found.where("kind = 'record'").collect()) == [(i, hashlib.sha1(b"<p>x</p>").hexdigest()) for i in (0, 1, 4, 5)]
    lost = {(r.file.rsplit("/", 1)[1], r.reason): r.gaps for r in warc.gaps(found).collect()}
    assert lost == {("a.txt", "no version line"): 1, ("a.txt", "a digest that can't be read"): 1, ("b.txt.gz", lost and next(k[1] for k in lost if k[0] == "b.txt.gz" and "end" not in k[1])): 1, ("b.txt.gz", "member without an end"): 1}
    warc.report_gaps(found)


def test_files_are_bounded_and_groups_joined_by_shuffling(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(warc, "BROADCAST_BYTES", 0)
    rows = [(i, f"u{i}", f"{i % 50} " * 600) for i in range(600)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1)
    planned = warc.plan(pages)
    assert planned.where("refers_to is not null").count() == 550
    warc.write(planned, f"{tmp_path}/w", file_bytes=10_000)
    found = warc.read(spark, f"{tmp_path}/w")
    assert found.count() == 600 and found.where("kind = 'record'").count() == 600 and found.select("file").distinct().count() > 5
