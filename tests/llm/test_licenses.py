import random
import re
from collections import Counter

from pyspark.sql import functions as F

from stowage.llm import licenses


def words(text):
    return re.findall(r"[^\x00-\x2f:-@\[-`{-\x7f]+", (text or "").lower())


def bigrams(ws):
    return list(zip(ws, ws[1:], strict=False))


def brute(text, templates, t):
    ws = words(text)
    grams = bigrams(ws)
    rows = []
    for name, template in templates.items():
        own = Counter(bigrams(words(template)))
        for i in range(len(grams)):
            best = None
            for j in range(i, len(grams)):
                dice = 2 * (Counter(grams[i : j + 1]) & own).total() / (j - i + 1 + own.total())
                if dice >= t - 1e-12 and (best is None or dice > best[0] + 1e-12):
                    best = dice, j
            if best and grams[i] in own:
                rows.append((-best[0], -(best[1] - i), i, name, best[1] - i + 2))
    taken, out = [], []
    for dice, _, i, name, n in sorted(rows):
        if all(i + n <= x or y <= i for x, y in taken):
            taken.append((i, i + n))
            out.append((name, round(-dice, 6), i, n))
    return out


SHORT = {k: v for k, v in licenses.TEMPLATES.items() if len(v) < 130}


def test_against_brute_force():
    rng = random.Random(3)
    names = sorted(SHORT)
    scanner = licenses.Scanner(SHORT)
    texts = []
    for _ in range(60):
        parts = [rng.choice(["the", "of", "work", "is", "licensed", "under", "x", "y"]) for _ in range(rng.randrange(25))]
        for _ in range(rng.randrange(3)):
            copy = SHORT[rng.choice(names)].split()
            if rng.random() < 0.4:
                copy[rng.randrange(len(copy))] = "changed"
            at = rng.randint(0, len(parts))
            parts[at:at] = copy
        texts.append(rng.choice([" ", "\n"]).join(parts))
    got = {}
    for i, name, dice, first, n in scanner.scan(texts):
        got.setdefault(i, []).append((name, round(dice, 6), first, n))
    assert got and got == {i: found for i, t in enumerate(texts) if (found := brute(t, SHORT, licenses.THRESHOLD))}


def test_long_texts_are_found_whole():
    scanner = licenses.Scanner()
    for name, text in licenses.TEMPLATES.items():
        around = "Copyright (c) 1999 Someone\n" + text.upper().replace(" ", "\n ") + "\n of the and the "
        found = [r for r in scanner.scan([around, None, "", "one"])]
        assert [(r[0], r[1], r[2]) for r in found] == [(0, name, 1.0)]


def test_query(spark, tmp_path):
    line = licenses.TEMPLATES["cc-by-nc-4.0-line"]
    rows = [(1, f"a b\n{line}\nc", 1), (1, line, 2), (None, line, 3), (2, None, 4), (3, (line + "\n") * 500, 5)]
    spark.createDataFrame(rows, "doc_id long, text string, license int").withColumn("dice", F.lit(1)).write.parquet(f"{tmp_path}/documents.parquet")
    got = licenses.op7_licenses(spark, str(tmp_path)).collect()
    assert sorted(str(r.doc_id) for r in got) == sorted(["1", "1", "None"] + ["3"] * 500)
    assert {(r.license, r.dice) for r in got} == {("cc-by-nc-4.0-line", 1.0)}
    assert licenses.scan(spark.createDataFrame(rows[:0], "doc_id long, text string, license int")).count() == 0


GNU = (
    "Foo is free software: you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later version. "
    "Foo is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
    "See the GNU {0} for more details. You should have received a copy of the GNU {0} along with Foo. If not, see <http://www.gnu.org/licenses/>."
)
KINDRED = {
    "gpl-2.0-or-later": GNU.format("General Public License", "2"),
    "gpl-3.0-or-later": GNU.format("General Public License", "3"),
    "lgpl-3.0-or-later": GNU.format("Lesser General Public License", "3"),
    "agpl-3.0-or-later": GNU.format("Affero General Public License", "3"),
    "cc-by-nd-4.0": "This book is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.",
    "cc-by-nc-sa-4.0": "This book is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.",
    "bsd-3-clause": licenses.TEMPLATES["bsd-2-clause"].replace("THIS SOFTWARE IS", "Neither the name of Foo Inc. nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS"),
}


def test_kindred_licences_are_told_apart():
    scanner = licenses.Scanner()
    for name, text in KINDRED.items():
        found = [r[1] for r in scanner.scan([f"some words {text} more words"])]
        assert found == [name]


def test_bodies_are_whole():
    tail = "SUCH DAMAGE."
    assert licenses.TEMPLATES["bsd-2-clause"].endswith(tail) and "unlicense.org" in licenses.TEMPLATES["unlicense"]


def test_altered_whole_texts_keep_their_name():
    scanner = licenses.Scanner()
    names = "agpl-3.0 apache-2.0 epl-1.0 gpl-1.0 gpl-2.0 gpl-3.0 lgpl-2.0 lgpl-2.1 lgpl-3.0 mpl-1.1 mpl-2.0 gfdl-1.2 gfdl-1.3 cc0-1.0 artistic-1.0".split()
    for name in names:
        text = licenses.TEMPLATES[f"{name}-text"].split()
        text[20::60] = ["changed"] * len(text[20::60])
        (found,) = scanner.scan([" ".join(text)])
        assert found[1] == f"{name}-text" and 0.9 < found[2] < 1


def test_repeated_bigrams_against_brute_force():
    rng = random.Random(5)
    templates = {"a": "x y x y x z", "b": "y x y y x y z x", "c": "x x x x y"}
    texts = [" ".join(rng.choices("xyzw", k=rng.randrange(40))) for _ in range(200)]
    got = {}
    for i, name, dice, first, n in licenses.Scanner(templates).scan(texts):
        got.setdefault(i, []).append((name, round(dice, 6), first, n))
    assert got and got == {i: found for i, t in enumerate(texts) if (found := brute(t, templates, licenses.THRESHOLD))}
