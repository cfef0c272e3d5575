"""Near-duplicates, benchmark leaks, licences and secrets against plain Python."""

import random
import re

import pytest
from pyspark.sql import functions as F

from busward.llm.components import components
from busward.llm.decontaminate import clean, leaks
from busward.llm.licenses import TEMPLATES, bigrams, licensed, words
from busward.llm.near import near_duplicates
from busward.llm.secrets import candidates, classified, described, dictionary, label, scan

WORD = re.compile(r"[^\x20\x09-\x0d]+")


def test_components(spark):
    dice = random.Random(1)
    pairs = [(i, i + 1) for i in range(100, 140)] + [(7, k) for k in range(200, 260)] + [(dice.randrange(300, 400), dice.randrange(300, 400)) for _ in range(60)]
    root = {n: n for p in pairs for n in p}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    got = {r["node"]: r["root"] for r in components(spark.createDataFrame(pairs, "a long, b long")).collect()}
    assert got == {n: find(n) for n in root if any(n in p and p[0] != p[1] for p in pairs)}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def shingles(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = WORD.findall(lower)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def plain_near(rows):
    ids = sorted({i for i, _ in rows if i is not None})
    sets = {i: shingles(next(t for j, t in rows if j == i)) for i in ids}
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return sorted((i, len(shingles(t)), find(i) if i is not None else None, i is None or find(i) == i) for i, t in rows if i is not None)


def near_corpus():
    dice = random.Random(6)
    vocabulary = [f"w{i}" for i in range(3000)]
    passage = " ".join(dice.choice(vocabulary) for _ in range(60))
    rows = []

    def put(words):
        rows.append((len(rows), " ".join(words)))

    base = [dice.choice(vocabulary) for _ in range(150)]
    for _ in range(150):  # a family in which many pairs lie near the limit and many are linked by others only
        own = list(base)
        for _ in range(dice.randrange(0, 9)):
            own[dice.randrange(len(own))] = dice.choice(vocabulary)
        put(own)
    chain = [dice.choice(vocabulary) for _ in range(100)]
    for step in range(25):  # each linked with its neighbours only
        put(chain)
        chain = chain[7:] + [dice.choice(vocabulary) for _ in range(7)]
    for _ in range(60):  # a common passage links nothing
        put([*(dice.choice(vocabulary) for _ in range(80)), *passage.split()])
    for _ in range(30):
        put(["Same", "TEXT", "of", "copies", "all", "over"])
    return rows


@pytest.mark.parametrize("block_bytes", [1 << 20, 1 << 14])
def test_near_duplicates(spark, block_bytes):
    rows = near_corpus()
    n = len(rows)
    rows += [(n, "a b c"), (n + 1, "A  B\nc"), (n + 2, "a b"), (n + 3, ""), (n + 4, None), (n + 5, " \t"), (n + 6, "é b c d"), (n + 7, "É b c d"), (n + 8, "x y z z z z"), (0, rows[0][1])]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, component_id string")
    got = sorted(tuple(r) for r in near_duplicates(docs, block_bytes=block_bytes).collect())
    assert got == plain_near(rows)


def test_near_duplicates_without_ids_or_rows(spark):
    docs = spark.createDataFrame([(None, "a b c"), (None, "a b c"), (5, "a b c")], "doc_id long, text string")
    got = sorted((tuple(r) for r in near_duplicates(docs).collect()), key=str)
    assert got == [(5, 1, 5, True), (None, 1, None, True), (None, 1, None, True)]
    assert near_duplicates(docs.limit(0)).count() == 0


QUESTION = "Alice buys 12 apples for 3 dollars each and gives 5 of them to Bob, how many apples does Alice keep?"


def test_decontamination(spark):
    dice = random.Random(8)
    prose = lambda n: " ".join(dice.choice(["lorem", "ipsum", "dolor", "amet", "elit", "sed", "magna", "quis"]) + str(dice.randrange(40)) * 0 + "abcdefgh"[dice.randrange(8)] for _ in range(n))
    items = [(1, QUESTION), (2, prose(40)), (3, "so few words"), (4, "exactly six words in this item"), (5, None), (6, ""), (7, items_text := prose(30)), (7, items_text), (None, "no id")]
    text = {i: t for i, t in items if t and i}
    changed = QUESTION.replace("Alice", "Carol").replace("12", "40").replace("3 dollars", "7 dollars").replace("Bob", "Dan")
    pens = "when Bob has 5 pens in the box he gives 5 pens to the girl who sits near the window of the room"
    items.append((8, pens))
    text[8], mixed_up = pens, pens.replace("5", "7", 1).replace("5", "9")  # one value of the item, two of the document
    docs = [
        (10, f"{prose(50)}\n{QUESTION}\n{prose(20)}"), (11, f"{prose(30)}\n{changed}\n{prose(20)}"), (12, mixed_up), (13, prose(300)), (14, f"{prose(9)} {text[2]} {prose(9)}"),
        (15, text[2].upper()), (16, "so few words"), (17, "and so few words more"), (18, f"{prose(20)}. exactly six words in this item {prose(3)}"), (19, None), (20, ""),
        (21, " ".join(text[2].split()[:12]) + " " + prose(40)), (22, " ".join(text[2].split()[:30]) + " " + prose(40)), (23, text[7]), (23, text[7]), (None, QUESTION), (25, pens.replace("5", "7").replace("Bob", "Eve")), (24, "12 3 5 7 kg 40 5 3 12 " * 20),
    ]
    df = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame([(i, t, 0) for i, t in items], "item_id long, text string, doc_id int")
    got = {(r["doc_id"], r["item_id"]): r for r in leaks(df, bench).collect()}
    found = {k for k, r in got.items() if r["contaminated"]}
    assert found == {(10, 1), (11, 1), (14, 2), (15, 2), (16, 3), (18, 4), (22, 2), (23, 7), (25, 8)}
    assert got[10, 1]["n_changed"] == 0 and got[11, 1]["n_changed"] >= 4
    assert got[12, 8]["n_windows"] == got[12, 8]["n_item_windows"] and not got[12, 8]["contaminated"] and not got[21, 2]["contaminated"]
    kept = [r["doc_id"] for r in clean(df, bench).collect()]
    assert sorted(kept, key=str) == sorted([12, 13, 17, 19, 20, 21, 24, None], key=str)
    assert leaks(df.limit(0), bench).count() == 0 and leaks(df, bench.limit(0)).count() == 0


def plain_licenses(text):
    best = {}
    for section in {*text.split("\n"), *re.split(r"\n[ \t\r\x0b\x0c]*\n", text), text}:
        own = bigrams(section)
        for name, wording in TEMPLATES:
            other = bigrams(wording)
            if own and 200 * len(own & other) >= 80 * (len(own) + len(other)):
                best[name] = max(best.get(name, 0), 2 * len(own & other) / (len(own) + len(other)))
    tokens = words(text)
    for name, wording in TEMPLATES:
        other, size = bigrams(wording), len(words(wording))
        for start in range(len(tokens) - 1):
            if f"{tokens[start]} {tokens[start + 1]}" in other:
                own = bigrams(" ".join(tokens[start : start + size]))
                if 200 * len(own & other) >= 80 * (len(own) + len(other)):
                    best[name] = max(best.get(name, 0), 2 * len(own & other) / (len(own) + len(other)))
    return best


def test_licenses_inside_longer_texts(spark):
    """Several paragraphs within a file, a notice within a sentence, repeated and damaged wordings."""
    wording = {n: t for n, t in TEMPLATES if len(t) > 400}
    mit = re.sub(r"(conditions:|Software\.) ", r"\1\n\n", wording["MIT"], count=2)
    noise = "int main() { return 0; } // the software of the author or of the\n\n"
    bsd = re.sub(r" (\d\.|THIS)", r"\n\n\1", wording["BSD-3-Clause"])
    texts = [
        f"{noise * 30}Copyright 2020 Someone\n\n{mit}\n\n{noise * 30}", "See below. This project is released under the MIT License.",
        f"{noise}{bsd}\n\n{noise * 3}{wording['Unlicense']}", f"{noise}{wording['GPL-2.0']}", f"{mit} {mit}\n{mit}",
        noise + " ".join(w for i, w in enumerate(wording["LGPL-3.0"].split()) if i % 15), noise * 20, wording["Apache-2.0"][:200],
        noise + " ".join(reversed(wording["MIT"].split())), "released under the mit license " * 5,
    ]
    got = licensed(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    found = {i: {r["license"]: r["dice"] for r in got if r["doc_id"] == i} for i in range(len(texts))}
    assert found == {i: plain_licenses(t) for i, t in enumerate(texts)}
    assert found[0] == {"MIT": 1.0} and found[1] == {"MIT": 1.0} and "GPL-2.0" in found[3] and "LGPL-3.0" in found[5]
    assert {"BSD-3-Clause", "Unlicense"} <= set(found[2]) and not found[6] and not found[8]
    best = {r["doc_id"]: r["license"] for r in got if r["is_best"]}
    assert best[2] == "BSD-3-Clause" and best[3] == "GPL-2.0"


def test_licenses(spark):
    long_mit = next(t for n, t in TEMPLATES if n == "MIT" and len(t) > 500)
    texts = [
        None, "", "nothing here", "Released under the MIT License.", "prose before\nlicensed under the apache license version 2.0\nprose after",
        f"Copyright 2020 Someone\n\n{long_mit}\n\nint main() {{}}", long_mit.replace("Software", "Program", 2), "we are not licensed under anything, see the text",
        "Licensed under CC BY-NC 4.0.\nLicensed under CC BY 4.0.", "x " * 50_000, "This work is licensed under the GNU\nGeneral Public License, version 3.", "Released under the MIT License.",
    ]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in enumerate(texts)] + [(None, texts[3], "")], "doc_id long, text string, license string")
    got = licensed(docs).collect()
    for i, text in [*enumerate(texts), (None, texts[3])]:
        rows = [r for r in got if r["doc_id"] == i]
        want = plain_licenses(text or "")
        assert {r["license"]: r["dice"] for r in rows} == want
        assert [r["license"] for r in rows if r["is_best"]] == ([min(want, key=lambda n: (-want[n], n))] if want else [])
    assert licensed(docs.limit(0)).count() == 0


def findings(dice, n):
    hexa = lambda k: "".join(dice.choice("0123456789abcdef") for _ in range(k))
    key = lambda: "AKIA" + "".join(dice.choice("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567") for _ in range(16))
    prose = lambda: " ".join(dice.choice(["the", "server", "and", "value", "holds", "report", "figure"]) for _ in range(6))
    real = [lambda: f"password={hexa(18)}", lambda: f'token = "{hexa(40)}"', key, lambda: f"secret: {hexa(24)}"]
    false = [
        lambda: f"{dice.randrange(10**15, 10**16)}", lambda: f"{dice.randrange(256)}.{dice.randrange(256)}.{dice.randrange(256)}.{dice.randrange(256)}",
        lambda: f"user{dice.randrange(99)}@mail.example.com", lambda: f"for example token = \"{hexa(40)}\"", lambda: f"{dice.randrange(100, 999)}-555-{dice.randrange(1000, 9999)}",
    ]
    for i in range(n):
        is_real = dice.random() < 0.4
        yield i, f"{prose()} {dice.choice(real if is_real else false)()} {prose()}", "src/main.py", float(is_real)


def test_secrets_on_held_out_findings(spark):
    rows = list(findings(random.Random(9), 600))
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, truth double")
    found = described(candidates(docs), dictionary(docs))
    truth = found.join(docs.select("doc_id", "truth"), "doc_id")
    # Labels for the first 400 only; the rest is scored blind.
    out = classified(truth.withColumn("label", F.when(F.col("doc_id") < 400, F.col("truth")))).filter("doc_id >= 400").collect()
    assert len(out) > 150
    right = sum(r["secret"] == (r["truth"] == 1) for r in out)
    assert right / len(out) >= 0.95


def test_secret_scan_cases(spark):
    rows = [(1, None, None), (2, "", "s"), (3, "plain words only", "s"), (4, "password=abc123def456ghi7", None), (4, "password=abc123def456ghi7", None), (None, "call 555-123-4567 now", "tests/x"), (6, "x" * 100_000 + "1", "s")]
    docs = spark.createDataFrame([(*r, "clash", "clash") for r in rows], "doc_id long, text string, source string, label string, secret string")
    out = scan(docs).collect()
    assert sorted((str(r["doc_id"]), r["secret"]) for r in out if r["doc_id"] in (4, None)) == [("4", True), ("4", True), ("None", False)]
    assert scan(docs.filter("doc_id = 4")).filter("secret").count() == 2
    assert scan(docs.limit(0)).count() == 0
    plan = label(described(candidates(docs), dictionary(docs)))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan
