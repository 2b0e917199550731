"""Registered queries of the archive engine, each with its SQL counterpart.

Tables are seen as archives: ``documents`` as ``docs/<source>/<lang>/<doc_id>.txt``,
``pages`` and ``conversations`` alike. Contents are UTF-8.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage import codec, schema
from stowage.archive import Archive
from stowage.codec.levels import LEVELS
from stowage.codec.levels import table as level_table
from stowage.functions import columns as c
from stowage.functions import udfs
from stowage.operators import blocks, catalog, coding, tokens
from stowage.sources import archive as source
from stowage.tables import Scratch, spread, table

QUERIES: dict = {}
ORACLE_SQL: dict = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f):
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return add


# ---------------------------------------------------------------- tables as archives


def docs(spark: SparkSession, d: str, archive: str = "docs") -> DataFrame:
    t = table(spark, d, "documents")
    path = F.concat(F.lit(f"{archive}/"), "source", F.lit("/"), "lang", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return catalog.catalog(t, "doc_id", path, F.col("text"))


def pages(spark: SparkSession, d: str) -> DataFrame:
    return catalog.catalog(table(spark, d, "pages"), "page_id", F.concat(F.lit("pages/"), F.col("page_id").cast("string"), F.lit(".html")), F.col("html"))


def turns(spark: SparkSession, d: str) -> DataFrame:
    t = table(spark, d, "conversations")
    path = F.concat(F.lit("chat/"), F.col("conv_id").cast("string"), F.lit("/"), F.col("turn").cast("string"), F.lit("."), "role")
    return catalog.catalog(t, F.col("conv_id") * 1000 + F.col("turn"), path, F.col("text"), permissions=0o600)


def doubled(spark: SparkSession, d: str) -> DataFrame:
    """The documents' archive with itself behind it."""
    return catalog.concatenate(docs(spark, d), docs(spark, d))


def pending(spark: SparkSession, d: str) -> DataFrame:
    """Appends: every document once, and those labelled as poor once more."""
    own = docs(spark, d)
    return catalog.append(own, own.join(labelled(spark, d, "quality = 0"), "ord", "left_semi"))


def labelled(spark: SparkSession, d: str, which: str) -> DataFrame:
    """``ord`` of the documents whose label is of a kind."""
    return table(spark, d, "labels").where(which).select(F.col("doc_id").alias("ord")).distinct()


DOCS = "docs as (select doc_id as ord, 'docs/' || source || '/' || lang || '/' || doc_id || '.txt' as path, octet_length(encode(text))::bigint as content_size from documents)"
PAGES = "pages_a as (select page_id as ord, 'pages/' || page_id || '.html' as path, octet_length(encode(html))::bigint as content_size from pages)"
TURNS = "turns as (select conv_id * 1000 + turn as ord, 'chat/' || conv_id || '/' || turn || '.' || role as path, octet_length(encode(text))::bigint as content_size from conversations)"
FULL = "18 + octet_length(encode(path)) + content_size"
POS = f"coalesce(sum({FULL}) over (order by ord rows between unbounded preceding and 1 preceding), 0)::bigint"
#: Behind all orders of a table, in the SQL.
FAR = 1 << 48
DOUBLED = f"doubled as (select * from docs union all select ord + {FAR}, path, content_size from docs)"
POOR = "ord in (select doc_id from labels where quality = 0)"
TOXIC = "ord in (select doc_id from labels where toxic = 1)"
PENDING = f"pending as (select * from docs union all select ord + {FAR // 2}, path, content_size from docs where {POOR})"


def shown(df: DataFrame) -> DataFrame:
    return df.select("path", "content_size", "pos")


# ---------------------------------------------------------------- listing and search


@query(f"with {DOCS} select '-rw-r--r--' as mode, path, ({FULL})::bigint as full_size, {POS} as pos from docs")
def archive_list(spark, d):
    placed = catalog.positions(docs(spark, d))
    return placed.select(c.mode_string("entry_type", "permissions").alias("mode"), "path", c.full_size("path", "content_size").alias("full_size"), "pos")


@query(f"with {TURNS} select '-rw-------' as mode, path, ({FULL})::bigint as full_size from turns")
def archive_list_turns(spark, d):
    return catalog.listing(turns(spark, d)).drop("ord")


@query(f"with {DOCS} select path, content_size, {POS} as pos from docs")
def archive_positions(spark, d):
    return shown(catalog.positions(docs(spark, d)))


@query(f"with {DOCS}, {DOUBLED} select ord, path, content_size from doubled where path = (select path from docs order by ord desc limit 1) order by ord limit 1")
def archive_find(spark, d):
    last = docs(spark, d).agg(F.max_by("path", "ord")).scalar()
    return catalog.find(doubled(spark, d), last).select("ord", "path", "content_size")


@query(f"with {DOCS} select path, content_size from docs where starts_with(path, 'docs/src1/en') and substr(path, 13, 1) in ('', '/')")
def archive_within_dir(spark, d):
    return catalog.within(docs(spark, d), "docs/src1/en").select("path", "content_size")


@query(f"with {DOCS} select count(*)::bigint as n from docs where starts_with(path, 'docs/src1') and substr(path, 10, 1) in ('', '/')")
def archive_within_dir_no_false_prefix(spark, d):
    return catalog.within(docs(spark, d), "docs/src1").agg(F.count(F.lit(1)).alias("n"))


_PATHS = ["d", "d/", "d/a", "dx", "src1", "src10", "src1/x", "", "/abs"]
_DIRS = ["d", "d/", "src1", ""]


@query(
    "with p(path) as (values " + ", ".join(f"('{p}')" for p in _PATHS) + "), q(dir) as (values " + ", ".join(f"('{p}')" for p in _DIRS) + ") "
    "select path, dir, starts_with(path, dir) and (dir like '%/' or length(path) = length(dir) or substr(path, length(dir) + 1, 1) = '/') as inside from p cross join q"
)
def path_within_dir(spark, d):
    paths = spark.createDataFrame([(p,) for p in _PATHS], "path string")
    out = None
    for q in _DIRS:
        part = paths.select("path", F.lit(q).alias("dir"), c.within_dir("path", q).alias("inside"))
        out = part if out is None else out.unionByName(part)
    return out


@query(f"with {DOCS}, {PAGES} select 'docs' as archive, max(path) filter (ord = (select max(ord) from docs)) as path, (select max(pos) from (select {POS} as pos from docs))::bigint as pos from docs")
def archive_last_entry(spark, d):
    return catalog.last_entry(catalog.positions(docs(spark, d)).withColumn("archive", F.lit("docs")))


# ---------------------------------------------------------------- changes


@query(f"with {DOCS}, {PAGES}, a as (select * from docs union all select ord + {FAR}, path, content_size from pages_a) select path, content_size, {POS} as pos from a")
def archive_append(spark, d):
    return shown(catalog.positions(catalog.append(docs(spark, d), pages(spark, d))))


@query(f"with {DOCS}, {DOUBLED} select path, count(*)::bigint as entries from doubled group by path")
def archive_append_duplicates(spark, d):
    return doubled(spark, d).groupBy("path").agg(F.count(F.lit(1)).alias("entries"))


_UPDATE = f"c as (select path, count(*) as n from pending group by path), k as (select *, row_number() over (partition by path order by ord) as rn from existing), u as (select ord, path, content_size from k left join c using (path) where rn > coalesce(n, 0) union all select ord + {FAR}, path, content_size from pending)"


@query(f"with {DOCS}, existing as (select * from docs), {PENDING}, {_UPDATE} select path, content_size, {POS} as pos from u")
def archive_update(spark, d):
    return shown(catalog.positions(catalog.update(docs(spark, d), pending(spark, d))))


@query(f"with {DOCS}, {DOUBLED}, existing as (select * from doubled), {PENDING}, {_UPDATE.replace(f'ord + {FAR}', f'ord + {2 * FAR}')} select path, content_size, {POS} as pos from u")
def archive_update_duplicate_paths(spark, d):
    return shown(catalog.positions(catalog.update(doubled(spark, d), pending(spark, d))))


@query(f"with {DOCS}, existing as (select * from docs), pending as (select * from docs where not {POOR}), {_UPDATE} select path, content_size, {POS} as pos from u")
def archive_update_failed_inputs(spark, d):
    poor = labelled(spark, d, "quality = 0").withColumn("error", F.lit("unreadable"))
    new = docs(spark, d).join(poor, "ord", "left")
    return shown(catalog.positions(catalog.update(docs(spark, d), new)))


@query(f"with {DOCS}, p as (select *, {POS} as pos from docs) select path, content_size, {POS} as pos from p where ord not in (select doc_id from labels where quality = 0)")
def archive_remove(spark, d):
    placed = catalog.positions(docs(spark, d))
    bad = table(spark, d, "labels").where("quality = 0").select(F.col("doc_id").alias("ord"))
    keys = placed.join(bad, "ord", "left_semi").select("pos")
    kept = catalog.remove(placed, keys.unionByName(keys))
    return shown(catalog.positions(kept.drop("pos")))


@query(f"with {DOCS}, k as (select * from docs where not starts_with(path, 'docs/src1/')) select path, content_size, {POS} as pos from k")
def archive_remove_recursive(spark, d):
    return shown(catalog.positions(catalog.remove_within(docs(spark, d), "docs/src1")))


@query(f"with {DOCS}, {DOUBLED}, gone as (select min(ord) as ord from doubled where path = (select path from docs order by ord limit 1)) select path, count(*)::bigint as entries from doubled where ord not in (select ord from gone) group by path")
def archive_remove_first_match(spark, d):
    first = docs(spark, d).agg(F.min_by("path", "ord")).scalar()
    return catalog.remove_path(doubled(spark, d), first).groupBy("path").agg(F.count(F.lit(1)).alias("entries"))


@query(f"with {DOCS}, {TURNS}, k as (select * from docs where not {TOXIC} union all select ord + {FAR}, path, content_size from turns) select path, content_size, {POS} as pos from k")
def archive_remove_then_append(spark, d):
    own = docs(spark, d)
    kept = catalog.remove(own, labelled(spark, d, "toxic = 1"), on="ord")
    return shown(catalog.positions(catalog.append(kept, turns(spark, d))))


@query(f"with {DOCS}, {PAGES}, {TURNS}, a as (select * from docs union all select ord + {FAR}, path, content_size from pages_a union all select ord + {2 * FAR}, path, content_size from turns) select path, content_size, {POS} as pos from a")
def archive_concat(spark, d):
    return shown(catalog.positions(catalog.concatenate(docs(spark, d), pages(spark, d), turns(spark, d))))


@query(f"with {DOCS}, {PAGES}, {TURNS}, a as (select * from turns union all select ord + {FAR}, path, content_size from docs union all select ord + {2 * FAR}, path, content_size from docs union all select ord + {3 * FAR}, path, content_size from pages_a) select path, content_size, {POS} as pos from a")
def archive_append_twice(spark, d):
    """Three appends one after the other keep their order."""
    once = catalog.append(turns(spark, d), docs(spark, d))
    return shown(catalog.positions(catalog.append(catalog.append(once, docs(spark, d)), pages(spark, d))))


@query("with r as (select 'docs/' || source || '/' || lang as path, doc_id as req from documents) select path, min(req) as req from r group by path")
def archive_dedup_requests(spark, d):
    asked = table(spark, d, "documents").select(F.concat(F.lit("docs/"), "source", F.lit("/"), "lang").alias("path"), F.col("doc_id").alias("req"))
    return catalog.first_requests(asked).select("path", "req")


@query(f"with {DOCS}, a(path) as (select path from docs union all values ('nowhere'), ('docs')) select path, case when path not in (select path from docs) then 'non-existent path' end as error from a")
def archive_remove_status(spark, d):
    asked = docs(spark, d).select("path").unionByName(spark.createDataFrame([("nowhere",), ("docs",)], "path string"))
    return catalog.remove_status(docs(spark, d), asked)


@query("select false as succeeded")
def archive_all_succeeded(spark, d):
    return catalog.all_succeeded(archive_remove_status(spark, d))


# ---------------------------------------------------------------- bytes of archives


def written(spark: SparkSession, entries: DataFrame, scratch: Scratch, payload: bool = True) -> DataFrame:
    """``entries`` with ``payload`` written as archives and scanned again."""
    source.register(spark)
    path = scratch.path("archive")
    entries.select("version", "content_size", "method", "level", "entry_type", "permissions", "path", "payload").write.format("archive").mode("append").save(path)
    return spark.read.format("archive").option("payload", str(payload).lower()).load(path)


_HEADERS = f"select path, 1025::bigint as version, content_size, 1::tinyint as entry_type, 420::smallint as permissions, 0::tinyint as method, 0::tinyint as level from docs"


@query(f"with {DOCS} {_HEADERS}")
def header_roundtrip(spark, d):
    found = written(spark, spread(docs(spark, d)).withColumn("payload", F.col("content")), Scratch(spark), payload=False)
    return found.select("path", "version", "content_size", "entry_type", "permissions", "method", "level")


@query("with f(archive, length, is_corrupted, is_truncated) as (values ('garbage', 9, true, false), ('garbage_behind', 37, true, false), ('truncated', 26, false, true), ('whole', 28, false, false), ('bad_method', 28, true, false)) select * replace (length::bigint as length) from f")
def archive_corrupt_check(spark, d):
    from stowage.sources import layout
    from stowage.sources.parts import Place

    top = Scratch(spark).path("odd")
    place = Place(top)
    place.make()
    good = layout.pack(1025, 5, 0, 0, schema.FILE, 0o644, "a.txt") + b"hello"
    bad = bytearray(good)
    bad[12] = 9
    for name, data in {"garbage": b"not an ar", "garbage_behind": good + b"\xff" * 9, "truncated": good[:-2], "whole": good, "bad_method": bytes(bad)}.items():
        with place.store.open_output_stream(place.full(name)) as out:
            out.write(data)
    files = source.lengths(spark, top)
    checked = catalog.corruption(source.read_archives(spark, top), files).join(files, "archive")
    return checked.withColumn("archive", F.element_at(F.split("archive", "/"), -1)).select("archive", "length", "is_corrupted", "is_truncated")


_RANGE = "generate_series(0, 2047)"


@query(f"select a::int as attributes, (a >> 9)::int as entry_type, (a & 511)::int as permissions, (((a >> 9) << 9) | (a & 511))::int as packed from {_RANGE} t(a)")
def attributes_unpack(spark, d):
    a = spark.range(2048).select(F.col("id").cast("int").alias("attributes"))
    a = a.withColumn("entry_type", c.attribute_type("attributes")).withColumn("permissions", c.attribute_permissions("attributes"))
    return a.withColumn("packed", c.pack_attributes("entry_type", "permissions"))


_VERSION = "(v * 2654435761 % 4294967296)::bigint"


@query(f"with t as (select {_VERSION} as version from generate_series(0, 999) g(v)) select version, (version >> 20)::int as major, ((version >> 10) & 1023)::int as minor, (version & 1023)::int as patch, version as packed from t")
def version_unpack(spark, d):
    v = spark.range(1000).select((F.col("id") * 2654435761 % 4294967296).alias("version")).withColumn("p", c.version_parts("version"))
    return v.select("version", "p.major", "p.minor", "p.patch", c.pack_version("p.major", "p.minor", "p.patch").alias("packed"))


@query("select p::int as permissions, t::int as entry_type, case t when 1 then '-' when 2 then 'd' when 3 then 'l' else '?' end || " + " || ".join(f"case when p & {1 << (8 - i)} <> 0 then '{'rwx'[i % 3]}' else '-' end" for i in range(9)) + " as mode from generate_series(0, 511) a(p), generate_series(0, 3) b(t)")
def permission_render(spark, d):
    rows = spark.range(2048).select((F.col("id") % 512).cast("int").alias("permissions"), F.floor(F.col("id") / 512).cast("int").alias("entry_type"))
    return rows.withColumn("mode", c.mode_string("entry_type", "permissions"))


_LINKS = "select 'links/' || item_id as path, 'docs/' || item_id || '.txt' as target from benchmark"


@query(_LINKS)
def symlink_targets(spark, d):
    target = F.concat(F.lit("docs/"), F.col("item_id").cast("string"), F.lit(".txt"))
    links = catalog.catalog(table(spark, d, "benchmark"), "item_id", F.concat(F.lit("links/"), F.col("item_id").cast("string")), F.concat(target, F.lit("\x00")), schema.SYMLINK, 0o777)
    found = written(spark, links.withColumn("payload", F.col("content")), Scratch(spark))
    return found.select("path", catalog.symlink_target("payload", "content_size").alias("target"))


# ---------------------------------------------------------------- blocks and codecs


@query("with t as (select doc_id, octet_length(encode(text)) as n from documents) select doc_id, b::int as block_no, least(8192, n - b * 8192)::int as block_bytes, n - b * 8192 < 8192 as is_final from t, unnest(range(0, (n + 8191) // 8192)) g(b)")
def block_split(spark, d):
    found = blocks.split(table(spark, d, "documents").select("doc_id", F.col("text").cast("binary").alias("content")), "content", 8192)
    return found.select("doc_id", "block_no", F.octet_length("raw").alias("block_bytes"), "is_final")


_DIGEST = "select doc_id, sha256(text) as digest from documents"


@query(_DIGEST)
def block_reassemble(spark, d):
    found = blocks.split(table(spark, d, "documents").select("doc_id", F.col("text").cast("binary").alias("content")), "content", 4096, outer=True)
    return blocks.reassemble(found, "doc_id", "raw").select("doc_id", F.sha2("payload", 256).alias("digest"))


def _coded(spark: SparkSession, d: str, method: int, level: int) -> DataFrame:
    t = spread(table(spark, d, "documents").select("doc_id", F.col("text").cast("binary").alias("content")))
    return blocks.encode_contents(t, "doc_id", "content", method, level).withColumn("method", F.lit(method)).withColumn("level", F.lit(level))


def _extract(method: int, level: int):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return blocks.decode_contents(_coded(spark, d, method, level)).select("doc_id", F.sha2("content", 256).alias("digest"))

    return run


query(_DIGEST, "extract_none")(_extract(codec.NONE, 0))
for _level in (1, 4, 8):
    query(_DIGEST, f"extract_huffman_{_level}")(_extract(codec.HUFFMAN, _level))
for _level in (0, 4, 8):
    query(_DIGEST, f"extract_deflate_{_level}")(_extract(codec.DEFLATE, _level))


@query("select 'docs/' || source || '/' || lang || '/' || doc_id || '.txt' as path, sha256(text) as digest from documents where source = 'src1'")
def extract_by_prefix(spark, d):
    made = spread(docs(spark, d)).withColumn("payload", udfs.encode_content("content", F.lit(codec.DEFLATE), F.lit(1))["data"]).withColumn("method", F.lit(codec.DEFLATE).cast("tinyint")).withColumn("level", F.lit(1).cast("tinyint"))
    found = written(spark, made, Scratch(spark))
    return blocks.decode_contents(catalog.within(found, "docs/src1")).select("path", F.sha2("content", 256).alias("digest"))


@query(name="compression_ratio")
def compression_ratio(spark, d):
    """Encoded against plain bytes, by method and level."""
    plain = F.sum(F.octet_length("text")).cast("long")
    total = table(spark, d, "documents").agg(plain.alias("plain_bytes"))
    out = None
    for method, level in ((codec.HUFFMAN, 8), (codec.DEFLATE, 1), (codec.DEFLATE, 8)):
        part = _coded(spark, d, method, level).agg(F.sum(F.octet_length("payload")).cast("long").alias("encoded_bytes")).select(F.lit(method).alias("method"), F.lit(level).alias("level"), "encoded_bytes")
        out = part if out is None else out.unionByName(part)
    return out.join(F.broadcast(total)).withColumn("ratio", F.col("plain_bytes") / F.col("encoded_bytes"))


_PAIRS = [(m, n) for m, (least, most) in sorted(LEVELS.items()) for n in range(least, most + 1)]


@query(
    f"with pairs(method, level) as (values {', '.join(map(str, _PAIRS))}) select 'm' || method || '/' || level || '/' || doc_id as path, method::int as method, level::int as level, "
    f"sha256(case when doc_id in (select doc_id from labels where quality = 0) then text || ' changed' else text end) as digest from documents cross join pairs"
)
def archive_write_update_read(spark, d):
    """An archive with every document at every method and level, written, updated and read again."""
    t = table(spark, d, "documents").select("doc_id", "text")
    poor = t.join(labelled(spark, d, "quality = 0").withColumnRenamed("ord", "doc_id"), "doc_id", "left_semi")
    a = Archive(spark, Scratch(spark).path("archive"))
    for rows in (t, poor.withColumn("text", F.concat("text", F.lit(" changed")))):
        for method, level in _PAIRS:
            path = F.concat(F.lit(f"m{method}/{level}/"), F.col("doc_id").cast("string"))
            a.will_append(rows.select(F.col("doc_id").alias("req"), path.alias("path"), F.lit(schema.FILE).alias("entry_type"), F.lit(0o644).alias("permissions"), F.col("text").cast("binary").alias("content")), method, level)
        a.write()
    parts = F.split("path", "/")
    return a.contents().select("path", F.substring(parts[0], 2, 9).cast("int").alias("method"), parts[1].cast("int").alias("level"), F.sha2("content", 256).alias("digest"))


@query("with p(method, level) as (values (1, 8), (2, 1), (2, 8)) select method::int as method, level::int as level, (select sum(octet_length(encode(text)))::bigint from documents) as plain_bytes, true as holds from p")
def compression_floor(spark, d):
    """Whether contents don't grow, by method and level."""
    return compression_ratio(spark, d).select("method", "level", "plain_bytes", (F.col("ratio") >= 1).alias("holds"))


@query("select doc_id, ((octet_length(encode(text)) + 8191) // 8192)::bigint as blocks, octet_length(encode(text))::bigint as bytes from documents where text <> ''")
def token_totals(spark, d):
    """Blocks and bytes of each document, from its tokens and their end symbols."""
    return tokens.totals(spread(table(spark, d, "documents").select("doc_id", "text")), "doc_id", "text", 0).select("doc_id", "blocks", "bytes")


@query("select s::int as symbol, s < 256 as is_literal, s = 256 as is_end, s between 257 and 285 as is_length, s <= 29 as is_distance, case when s < 256 then s end::int as literal, case when s between 257 and 285 then s - 257 end::int as length_symbol from generate_series(0, 299) g(s)")
def symbol_classes(spark, d):
    s = spark.range(300).select(F.col("id").cast("int").alias("symbol"))
    return s.select("symbol", c.is_literal("symbol").alias("is_literal"), c.is_end("symbol").alias("is_end"), c.is_length("symbol").alias("is_length"), c.is_distance("symbol").alias("is_distance"), c.literal_of("symbol").alias("literal"), c.length_of("symbol").alias("length_symbol"))


@query("select p::int as packed, p = 24576 as is_none, p >= 32768 as is_match, case when p >= 32768 then (p >> 10) & 31 end::int as length_extra, case when p >= 32768 then (p >> 5) & 31 end::int as length_symbol, case when p >= 32768 then p & 31 end::int as distance_symbol, case when p < 32768 then p & 8191 end::int as distance_extra, case when p < 32768 then p & 255 end::int as literal, case when p >= 32768 then p else p & 8191 end::int as again from generate_series(0, 65535) g(p)")
def packed_tokens(spark, d):
    p = spark.range(1 << 16).select(F.col("id").cast("int").alias("packed")).withColumn("t", c.token_parts("packed"))
    again = F.when(F.col("t.is_match"), c.pack_match("t.length_extra", "t.length_symbol", "t.distance_symbol")).otherwise(c.pack_distance_extra("t.distance_extra"))
    return p.select("packed", "t.*", again.alias("again"))


@query("with t(method, level, block_bytes, lazy_threshold, insert_threshold) as (values " + ", ".join(f"({m}, {n}, {k}, {x}, {y})".replace("None", "null") for m, n, k, x, y in level_table()) + ") select method::int as method, level::int as level, block_bytes::int as block_bytes, lazy_threshold::int as lazy_threshold, insert_threshold::int as insert_threshold, case method when 0 then 'none' when 1 then 'huffman' else 'deflate' end || '/' || level as name from t")
def compression_levels(spark, d):
    rows = spark.createDataFrame(level_table(), "method int, level int, block_bytes int, lazy_threshold int, insert_threshold int")
    return rows.withColumn("name", c.compression_string("method", "level"))


# ---------------------------------------------------------------- coding statistics


_BYTES = "select ('0x' || b)::bigint as byte, count(*)::bigint as count from (select unnest(regexp_extract_all(hex(encode(text)), '..')) as b from documents) group by b"


@query(_BYTES)
def byte_histogram(spark, d):
    return coding.byte_histogram(table(spark, d, "documents"), "text")


@query(_BYTES)
def byte_histogram_native(spark, d):
    return coding.byte_histogram_native(table(spark, d, "documents"), "text")


@query("select doc_id, case when count(distinct b) > 1 then 32768 else 16384 end::bigint as kraft_sum, count(distinct b)::bigint as symbols, true as is_valid from (select doc_id, unnest(regexp_extract_all(hex(encode(text)), '..')) as b from documents) group by doc_id")
def code_length_kraft(spark, d):
    @F.pandas_udf("array<bigint>")
    def histogram(data):
        import numpy as np
        import pandas as pd

        return pd.Series([np.bincount(np.frombuffer(x, np.uint8), minlength=256).tolist() for x in data])

    # an empty content has no symbols and so no code
    freqs = spread(table(spark, d, "documents").where("text <> ''").select("doc_id", "text")).select("doc_id", histogram(F.col("text").cast("binary")).alias("freqs"))
    return freqs.select("doc_id", coding.kraft_of(udfs.huffman_lengths("freqs")).alias("k")).select("doc_id", "k.*")


_LENGTHS = (15, 15, 14, 13, 12, 11, 10, 9, 8, 7, 6, 5, 4, 3, 0, 3, 3, 3, 0, 3, 3, 4)
_LENGTHS_SQL = "l(sym, len) as (values " + ", ".join(f"({i}, {n})" for i, n in enumerate(_LENGTHS)) + ")"


@query(f"with {_LENGTHS_SQL} select sym::int as sym, len::int as len, (coalesce(sum(1 << (15 - len)) over (order by len, sym rows between unbounded preceding and 1 preceding), 0)::bigint >> (15 - len))::bigint as code from l where len > 0")
def canonical_codes(spark, d):
    return coding.canonical_codes(spark.createDataFrame(list(enumerate(_LENGTHS)), "sym int, len int"))


_RUN_LENGTHS = [0] * 150 + [8] * 9 + [7, 7, 0, 0] + [9] * 4 + [0] * 11 + [5] * 20 + [0] * 3 + [4]
_RUNS_SQL = "l(idx, len) as (values " + ", ".join(f"({i}, {n})" for i, n in enumerate(_RUN_LENGTHS)) + "), b as (select *, case when lag(len) over (order by idx) = len then 0 else 1 end as s from l), n as (select *, sum(s) over (order by idx)::bigint as run from b), r as (select run, min(len) as len, count(*)::bigint as reps from n group by run)"


@query(f"with {_RUNS_SQL} select run, len::int as len, reps from r")
def rle_runs(spark, d):
    return coding.runs(spark.createDataFrame(list(enumerate(_RUN_LENGTHS)), "idx int, len int"))


@query(
    f"with {_RUNS_SQL} select run, len::int as len, reps, case when len = 0 then 0 else (reps - 1) // 6 + ((reps - 1) % 6 >= 3)::int end::bigint as sym16, (len = 0 and reps % 138 >= 3)::bigint as sym17, "
    "case when len = 0 then reps // 138 + (reps % 138 >= 11)::int else 0 end::bigint as sym18, case when len = 0 then case when reps % 138 < 3 then reps % 138 else 0 end else 1 + case when (reps - 1) % 6 < 3 then (reps - 1) % 6 else 0 end end::bigint as own from r"
)
def rle_symbol_counts(spark, d):
    return coding.run_symbol_counts(rle_runs(spark, d))


@query("select n::int as length, case when n = 258 then 28 when n < 7 then n - 3 else 4 * (floor(log2(n - 3))::int - 2) + ((n - 3) >> (floor(log2(n - 3))::int - 2)) end::int as symbol, case when n = 258 or n < 7 then 0 else floor(log2(n - 3))::int - 2 end::int as extra_bits from generate_series(3, 258) g(n)")
def length_symbols(spark, d):
    n = spark.range(3, 259).select(F.col("id").cast("int").alias("length"))
    return n.select("length", c.length_symbol("length").alias("symbol"), c.length_extra_bits("length").alias("extra_bits"))


@query("select n::int as distance, case when n < 3 then n - 1 when n < 5 then n - 1 else 2 * (floor(log2(n - 1))::int - 1) + ((n - 1) >> (floor(log2(n - 1))::int - 1)) end::int as symbol, case when n < 5 then 0 else floor(log2(n - 1))::int - 1 end::int as extra_bits from generate_series(1, 32768) g(n)")
def distance_symbols(spark, d):
    n = spark.range(1, 32769).select(F.col("id").cast("int").alias("distance"))
    return n.select("distance", c.distance_symbol("distance").alias("symbol"), c.distance_extra_bits("distance").alias("extra_bits"))


_SPECS = ["none", "huffman", "deflate", "huffman/3", "deflate/0", "deflate/9", "huffman/0", "7", "9", "0", "none/0", "none/1", "deflate/", "deflate7", "zip", "deflate/x", "999", "huffman/8junk"]
_SPECS_SQL = """
with s(spec) as (values %s),
p as (select spec, regexp_extract(spec, '^(none|huffman|deflate)', 1) as name, substr(spec, length(regexp_extract(spec, '^(none|huffman|deflate)', 1)) + 1) as rest from s),
q as (select *, case name when 'none' then 0 when 'huffman' then 1 else 2 end as m, case name when 'huffman' then 1 else 0 end as lo, case name when 'none' then 0 else 8 end as hi,
      regexp_extract(case when name = '' then rest else substr(rest, 2) end, '^[0-9]+') as digits from p),
r as (select *, case when name <> '' and rest = '' then null when name <> '' and (rest[1] <> '/' or length(rest) = 1) then 'invalid'
      when digits <> '' and digits::int not between lo and hi then 'out of range' when digits = '' and name = '' then 'invalid' end as error from q)
select spec, case when error is null then m end::int as method, case when error is null then case when digits <> '' then digits::int when name <> '' then lo else 8 end end::int as level, error from r
""" % ", ".join(f"('{s}')" for s in _SPECS)


@query(_SPECS_SQL)
def parse_compression_spec(spark, d):
    rows = spark.createDataFrame([(s,) for s in _SPECS], "spec string").withColumn("p", c.parse_compression("spec"))
    return rows.select("spec", F.col("p.method").alias("method"), F.col("p.level").alias("level"), F.col("p.error").alias("error"))


@query("select doc_id, concat_ws(' because of ', 'failed writing ' || doc_id, case when doc_id % 2 = 0 then 'failed encoding' end, 'unexpected end of data') as message from documents")
def error_messages(spark, d):
    t = table(spark, d, "documents")
    return t.select("doc_id", c.error_chain(F.concat(F.lit("failed writing "), F.col("doc_id").cast("string")), F.when(F.col("doc_id") % 2 == 0, "failed encoding"), F.lit("unexpected end of data")).alias("message"))


@query("select p as path, r as portable from (values ('a/./b', 'a/b'), ('a//b', 'a/b'), ('../a', '../a'), ('a/..', './'), ('/..', '/'), ('//x', '/x'), ('d/e/', 'd/e/'), ('.', './')) t(p, r)")
def portable_paths(spark, d):
    rows = [("a/./b", False), ("a//b", False), ("../a", False), ("a/..", True), ("/..", True), ("//x", False), ("d/e/", True), (".", True)]
    return spark.createDataFrame(rows, "path string, is_dir boolean").select("path", udfs.portable_path("path", "is_dir").alias("portable"))


@query("select count(*)::bigint as valid from generate_series(0, 255) a(m), generate_series(0, 7) b(t) where m in (0, 1, 2) and t between 0 and 3")
def header_validation(spark, d):
    rows = spark.range(2048).select((F.col("id") % 256).alias("m"), F.floor(F.col("id") / 256).alias("t"))
    return rows.where(c.valid_header("m", "t")).agg(F.count(F.lit(1)).alias("valid"))
