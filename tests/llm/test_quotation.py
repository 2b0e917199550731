import random
import re
import textwrap

from pyspark.sql import functions as F

from stowage.llm import quotation as q


def norm(t):
    return re.sub(r"[\W_]+", " ", t.lower()).strip()


def keys(lines):
    text = "\n".join(lines)
    return [k for k in dict.fromkeys([norm(text), *map(norm, lines)]) if len(k) >= q.LEAST_LETTERS]


def brute(rows):
    parsed = []
    for conv, turn, role, text in rows:
        runs = []
        for line in re.split(r"\r\n|\r|\n", text or ""):
            m = re.match(q.MARKS, line)
            level = m[0].count(">") if m else 0
            line = line[m.end() :] if m else line
            if runs and runs[-1][0] == level:
                runs[-1][1].append(line)
            else:
                runs.append((level, [line]))
        own = []
        for i, (level, lines) in enumerate(runs):
            if level:
                continue
            lines = list(lines)
            kept = lines[:-1] if not lines[-1].strip(" ") and len(lines) > 1 else lines
            if i + 1 < len(runs) and re.match(q.ATTRIBUTION.replace("(?i)", ""), kept[-1], re.I):
                lines = kept[:-1]
            own += lines
        parsed.append((conv, turn, role, "\n".join(own).strip(" "), [r for r in runs if r[0]]))
    origin = {}
    for conv, turn, _, content, _ in parsed:
        if conv is not None and turn is not None:
            for k in keys(content.split("\n")):
                origin[conv, k] = min(turn, origin.get((conv, k), turn))
    up = {}
    for conv, turn, _, _, quoted in parsed:
        found = [(level, place, part, -origin[conv, k]) for place, (level, lines) in enumerate(quoted) for part, k in enumerate(keys(lines)) if (conv, k) in origin and turn is not None and origin[conv, k] < turn]
        if found:
            up[conv, turn] = min([(found and min(found)), *([up[conv, turn]] if (conv, turn) in up else [])])
    out = []
    for conv, turn, role, content, quoted in parsed:
        reply = -up[conv, turn][3] if (conv, turn) in up else None
        root, depth = turn, 0
        while (conv, root) in up:
            root, depth = -up[conv, root][3], depth + 1
        out.append((conv, turn, role, content, reply, len(quoted), root, depth))
    return out


ROWS = [
    (1, 0, "user", "Hello there friend.\nHow do I sort a list?"),
    (1, 1, "assistant", "On Monday, user wrote:\n> how do i SORT a list?\n\nCall sorted()."),
    (1, 2, "user", "> > How do I sort a list?\n> Call sorted().\nIn which order?"),
    (1, 3, "user", ">How do I sort a list?\r\nI have the same question."),
    (1, 4, "assistant", "Alice wrote:\n\n> In which order?\n> unknown line\nAscending.\n>> never written\nBye"),
    (1, 5, "user", "Nothing quoted, 3 > 2."),
    (2, 0, "user", None),
    (2, 1, "user", "> Hello there friend."),
    (2, 2, None, "He wrote:"),
    (2, 2, "user", "> He wrote:"),
    (3, 7, "user", "> later words\nx"),
    (3, 8, "user", "later words"),
    (None, 1, "user", "> later words"),
    (3, None, "user", "> later words"),
    (4, 0, "user", ""),
    (4, 1, "user", "été über >\n>\n> été über >"),
] + [(9, i, "user", (f"> line number {i - 1}\n" if i else "") + f"line number {i}") for i in range(40)]


def plain(rows):
    return sorted((tuple(r)[:8] for r in rows), key=str)


def test_against_brute_force(spark, tmp_path):
    rows = ROWS + ROWS[3:4]
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("quotes", F.lit("clash")).write.parquet(f"{tmp_path}/conversations.parquet")
    got = q.op6_quotation(spark, str(tmp_path)).collect()
    assert plain(got) == plain(brute(rows))
    by = {(r.conv_id, r.turn): r for r in got}
    assert by[1, 1].content == "Call sorted()." or by[1, 1].content == "\nCall sorted()."
    assert [by[1, t].reply_to for t in range(6)] == [None, 0, 1, 0, 2, None]
    assert (by[9, 39].thread_turn, by[9, 39].depth) == (0, 39)


def test_empty(spark):
    assert q.rebuild(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


LINK = [
    (1, 0, "user", "The first paragraph begins here.\nIt ends here.\n\nAnother one follows."),
    (1, 1, "user", "> The first paragraph\n> begins here. It ends here.\nwrapped anew"),
    (1, 2, "user", "My own answer\nin two lines\n> Another one follows.\nand an afterthought, also\nin two"),
    (1, 3, "user", "> My own answer in two lines\nto the upper run"),
    (1, 4, "user", "> and an afterthought,\n> also in two\nto the lower run"),
    (1, 5, "user", "One thing. Is it so (or not?) Who knows! The rest\nof it is this. 答えはこれです。次の文です。"),
    (1, 6, "user", "> Who knows!\na sentence of a line"),
    (1, 7, "user", "> The rest of it is this.\na sentence across lines"),
    (1, 8, "user", "> 次の文です。\nwithout spaces"),
    (1, 9, "user", "1. Apples are red.\n2. Pears are green. They are sweet."),
    (1, 10, "user", "> They are sweet.\nan item's second sentence"),
    (1, 11, "user", "> 1. Nobody wrote this.\nonly the number is known"),
    (1, 12, "user", "> Who knows! The first paragraph begins here. Surely\nthe longer decides"),
]


def test_any_passage_is_linked(spark):
    got = {r.turn: r.reply_to for r in q.rebuild(spark.createDataFrame(LINK, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {0: None, 1: 0, 2: 0, 3: 2, 4: 2, 5: None, 6: 5, 7: 5, 8: 5, 9: None, 10: 9, 11: None, 12: 0}


def test_rewrapped_quotations_of_known_origin(spark):
    rng = random.Random(7)
    rows, expected = [], {}
    for conv in range(40):
        origins = []
        for turn in range(4):
            paragraphs = [[" ".join(f"w{rng.randrange(10**6)}" for _ in range(rng.randint(2, 8))) + rng.choice(".!?") for _ in range(rng.randint(1, 3))] for _ in range(rng.randint(1, 3))]
            own = "\n\n".join(textwrap.fill(" ".join(x), rng.randint(15, 60)) for x in paragraphs)
            reply, quote = None, ""
            if origins:
                reply = rng.randrange(turn)
                paragraph = rng.choice(origins[reply])
                a = rng.randrange(len(paragraph))
                some = paragraph[a : rng.randint(a + 1, len(paragraph))]
                quote = textwrap.indent(textwrap.fill(" ".join(some), rng.randint(15, 60)), "> ") + "\n"
            origins.append(paragraphs)
            rows.append((conv, turn, "user", rng.choice([quote + own, own + "\n" + quote])))
            expected[conv, turn] = reply
    got = {(r.conv_id, r.turn): r.reply_to for r in q.rebuild(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == expected


def test_short_passages_are_linked(spark):
    rows = [(c, 0, "user", text) for c, text in enumerate(["No", "OK", "42", "是的", "はい。", "x"])]
    rows += [(c, 1, "user", f"> {text}\nwhy?") for c, _, _, text in rows]
    rows += [(10, 0, "user", "No"), (10, 1, "user", "A longer answer."), (10, 2, "user", "> No\n> A longer answer.\nwell"), (10, 3, "user", "> ...\nwell")]
    got = {(r.conv_id, r.turn): r.reply_to for r in q.rebuild(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got == {(c, t): 0 if t else None for c in range(6) for t in (0, 1)} | {(10, 0): None, (10, 1): None, (10, 2): 1, (10, 3): None}


def test_threads_are_assembled_in_reply_order(spark):
    rows = [(1, 0, "user", "first question here"), (1, 1, "assistant", "> first question here\nan answer"), (1, 2, "user", "another topic"), (1, 3, "user", "> an answer\nthanks"), (None, 1, "user", "alone"), (2, None, "user", "turnless")]
    out = q.threads(q.rebuild(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()
    by = {(r.conv_id, r.thread_turn): (r.messages, r.chat) for r in out}
    assert by[1, 0] == (3, "<|user|>\nfirst question here\n<|end|>\n<|assistant|>\nan answer\n<|end|>\n<|user|>\nthanks\n<|end|>")
    assert by[1, 2][0] == by[None, 1][0] == by[2, None][0] == 1 and sum(r.messages for r in out) == len(rows)
