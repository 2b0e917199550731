"""Conversations rebuilt from quotations, with DataFrame functions only.

A message's lines carry a quote level: the number of ``>`` marks that they
begin with. Runs of lines of one level are passages; so are the paragraphs
(parted by blank lines), lines and sentences of a run, sentences being taken
across line breaks since mail clients wrap anew. Passages are normalised
(lower case; letters, digits and single spaces alone) and hashed; so are the
same passages of every message's unquoted runs, and its unquoted text as a whole.
A quoted passage is linked to the first message of its conversation that wrote it
before. A message answers the message that its outermost linked passage comes
from, then its first quotation, then its longest passage; without one it begins a
thread. A quotation that begins or ends within a sentence, and is no whole line,
is not linked, nor is one without letters and digits. Messages come out without quotations and
without the attribution line above a quotation, each with its thread, its depth
in it and its chat-formatted text. Sorting by (conversation, thread,
turn) gives reply order: every message follows the one it answers.

Scale: passages meet their origin through the first author of each hash and
conversation, an aggregate combined before shuffling, so no group's rows are
paired with each other; rows of a frequent hash, or of the many answers to one
message, are dealt to several tasks. Threads are found by pointer jumping over the messages
that answer something; rounds grow with the logarithm of the longest chain.

Defined results: null texts have no passages and an empty body; rows that
repeat a conversation and turn each come out, and a passage in any of them counts for that
turn; null conversations or turns are never linked and begin threads of their
own; no rows in, no rows out; other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from stowage.llm.skew import spread_join
from stowage.tables import Scratch, table

MARKS = r"^[ \t]*(?:>[ \t]?)+"
ATTRIBUTION = r"(?i)^\s*(?:on\b.*\bwrote|.*\bwrote|am\b.*\bschrieb.*|le\b.*\ba écrit|el\b.*\bescribió)\s*:\s*$"
PARAGRAPH = r"\n(?:[\s\p{Z}]*\n)+"
#: A sentence ends before spaces, after its marks and closing quotes or brackets; ideographic marks need no spaces.
SENTENCE = r"(?<=[.!?…][\"'”’»)\]]{0,3})[\s\p{Z}]+|(?<=[。！？][」』”’）]{0,3})(?![。！？」』”’）])"
ITEM = r"(?m)^[ \t]*(?:[-*+•]|\p{N}{1,3}[.)]|\p{L}[.)])[ \t]+"
LEAST_LETTERS = 1
MAX_ROUNDS = 64


def normalised(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}]+", " "))


def levelled(text: Column) -> Column:
    """An array of (no, level, line) of a text's lines, marks taken off."""
    rows = F.split(F.coalesce(text, F.lit("")), r"\r\n|\r|\n")

    def line(x: Column, i: Column) -> Column:
        marks = F.regexp_extract(x, MARKS, 0)
        return F.struct(i.alias("no"), F.length(F.regexp_replace(marks, "[^>]", "")).alias("level"), F.regexp_replace(x, MARKS, "").alias("line"))

    return F.transform(rows, line)


def passages(lines: Column) -> Column:
    """An array of (level, lines) of runs of one level, from ``levelled``."""

    def begins(x: Column, i: Column) -> Column:
        return (i == 0) | (F.element_at(lines, F.greatest(i, F.lit(1)))["level"] != x["level"])

    starts = F.filter(F.transform(lines, lambda x, i: F.when(begins(x, i), i)), lambda x: x.isNotNull())
    size = F.size(lines)

    def run(start: Column, i: Column) -> Column:
        end = F.coalesce(F.get(starts, i + 1), size)
        part = F.slice(lines, start + 1, end - start)
        return F.struct(F.get(lines, start)["level"].alias("level"), F.transform(part, lambda x: x["line"]).alias("lines"))

    return F.transform(starts, run)


def unquoted(runs: Column) -> Column:
    """The lines of each unquoted run, without the attribution line that stands right above a quotation; none for quoted runs."""

    def own(x: Column, i: Column) -> Column:
        quoted_next = F.coalesce(F.get(runs, i + 1)["level"] > 0, F.lit(False))
        last = F.element_at(x["lines"], -1)
        blank_last = (F.trim(last) == "") & (F.size(x["lines"]) > 1)
        kept = F.when(blank_last, F.slice(x["lines"], 1, F.greatest(F.size(x["lines"]) - 1, F.lit(0)))).otherwise(x["lines"])
        cut = quoted_next & F.element_at(kept, -1).rlike(ATTRIBUTION)
        return F.when(x["level"] > 0, F.array().cast("array<string>")).when(cut, F.slice(kept, 1, F.size(kept) - 1)).otherwise(x["lines"])

    return F.transform(runs, own)


def body(own: Column) -> Column:
    """The text of ``unquoted`` lines."""
    return F.trim(F.array_join(F.flatten(own), "\n"))


def parts(lines: Column) -> Column:
    """A run as a whole, its paragraphs, its lines and its sentences."""
    text = F.array_join(lines, "\n")
    paragraphs = F.split(text, PARAGRAPH)
    sentences = F.flatten(F.transform(paragraphs, lambda x: F.split(F.regexp_replace(x, ITEM, ""), SENTENCE)))
    return F.concat(F.array(text), paragraphs, lines, sentences)


def hashes(texts: Column) -> Column:
    """(length, hash) of the distinct normalised texts, those without letters and digits left out. Each distinct text is normalised once."""
    norms = F.array_distinct(F.filter(F.transform(F.array_distinct(texts), normalised), lambda x: F.length(x) >= LEAST_LETTERS))
    return F.transform(norms, lambda x: F.struct(F.length(x).alias("length"), F.xxhash64(x).alias("hash")))


def rebuild(messages: DataFrame) -> DataFrame:
    """(conv_id, turn, role, content, reply_to, quotes, thread_turn, depth, chat) of each row of ``messages`` (conv_id, turn, role, text)."""
    scratch = Scratch(messages.sparkSession)
    rows = messages.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.col("role").cast("string").alias("role"), levelled(F.col("text").cast("string")).alias("lines"))
    rows = rows.select("conv_id", "turn", "role", passages(F.col("lines")).alias("runs"))
    rows = rows.select("conv_id", "turn", "role", unquoted(F.col("runs")).alias("own"), F.filter("runs", lambda x: x["level"] > 0).alias("quoted"))
    parsed = scratch.store(rows.withColumn("quotes", F.size("quoted")), "parsed")
    known = parsed.where("conv_id is not null and turn is not null")

    pieces = F.concat(F.array(body(F.col("own"))), F.flatten(F.transform("own", parts)))
    written = known.select("conv_id", "turn", F.explode(hashes(pieces)["hash"]).alias("hash"))
    origin = written.groupBy("conv_id", "hash").agg(F.min("turn").alias("origin"))
    quoted = known.select("conv_id", "turn", F.posexplode("quoted").alias("place", "q")).select("conv_id", "turn", "place", "q.level", hashes(parts(F.col("q.lines"))).alias("all"))
    quoted = quoted.select("conv_id", "turn", "place", "level", F.posexplode("all").alias("part", "x")).select("conv_id", "turn", "place", "level", "part", "x.*")
    quoted = scratch.store(quoted, "quoted")
    linked = spread_join(quoted, origin, ["conv_id", "hash"]).where("origin < turn")
    # the outermost, then the first, then the longest passage decides
    first = F.min(F.struct("level", "place", (-F.col("length")).alias("short"), "part", (-F.col("origin")).alias("late"))).alias("first")
    replies = scratch.store(linked.groupBy("conv_id", "turn").agg(first).select("conv_id", "turn", (-F.col("first.late")).alias("reply_to")), "replies")

    # (root, depth) by pointer jumping: a message points at the furthest ancestor known so far
    paths = scratch.store(replies.select("conv_id", "turn", F.col("reply_to").alias("up"), F.lit(1).alias("depth")), "paths0")
    for turn in range(1, MAX_ROUNDS):
        ahead = paths.select("conv_id", F.col("turn").alias("up"), F.col("up").alias("further"), F.col("depth").alias("more"))
        moved = spread_join(paths, ahead, ["conv_id", "up"], "left").select("conv_id", "turn", F.coalesce("further", "up").alias("up"), (F.col("depth") + F.coalesce("more", F.lit(0))).alias("depth"), F.col("further").isNotNull().alias("moved"))
        stored = scratch.store(moved, f"paths{turn}")
        scratch.drop(f"paths{turn - 1}")
        paths = stored.drop("moved")
        if stored.where("moved").isEmpty():
            break
    placed = parsed.withColumn("content", body(F.col("own"))).join(replies, ["conv_id", "turn"], "left").join(paths.withColumnRenamed("up", "root"), ["conv_id", "turn"], "left")
    chat = F.concat(F.lit("<|"), F.coalesce("role", F.lit("")), F.lit("|>\n"), F.col("content"), F.lit("\n<|end|>"))
    return placed.select("conv_id", "turn", "role", "content", "reply_to", F.col("quotes").cast("long").alias("quotes"), F.coalesce("root", "turn").alias("thread_turn"), F.coalesce("depth", F.lit(0)).cast("long").alias("depth"), chat.alias("chat"))


def threads(rebuilt: DataFrame) -> DataFrame:
    """(conv_id, thread_turn, messages, chat) of each thread of ``rebuild``'s rows: its messages in reply order as one chat-formatted text.

    A thread becomes one row, as a training example is one. Messages without a conversation or turn are threads by themselves.
    """
    known = rebuilt.where("conv_id is not null and turn is not null")
    message = F.struct("turn", "role", "chat")
    held = known.groupBy("conv_id", "thread_turn").agg(F.array_sort(F.collect_list(message)).alias("all"))
    joined = held.select("conv_id", "thread_turn", F.size("all").cast("long").alias("messages"), F.array_join("all.chat", "\n").alias("chat"))
    alone = rebuilt.where("conv_id is null or turn is null").select("conv_id", "thread_turn", F.lit(1).cast("long").alias("messages"), "chat")
    return joined.unionByName(alone)


def op6_quotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rebuild(table(spark, sf_dir, "conversations"))
