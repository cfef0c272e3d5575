"""Quality rules and chat formatting against plain Python."""

import re
from collections import Counter

from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from busward.llm.chat import Template, formatted, loss_text, read_turns
from busward.llm.quality import RULES, judge

WORD = re.compile(r"[^\x20\x09-\x0d]+")
DOCS = "doc_id long, text string, kept string, n_words string"


def counts(text):
    text = text or ""
    w = WORD.findall(text)
    grams = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    seen = Counter(grams)
    covered = {i + k for i, g in enumerate(grams) if seen[g] > 1 for k in range(3)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(covered)


TEXTS = [
    None, "", " \t\n", "one", "a b c a b c", "a b c\na b c\n\n \na b c", "x " * 60, "the of " * 40, "# $ % & | < >",
    "é ü ß 😀 the\x0bof\x0cto", " ".join(f"w{i}" for i in range(70)), ("the cat is of " + " ".join(f"v{i}" for i in range(90))) * 2, "y" * 100_000,
]


def test_counts(spark):
    rows = [(i, t, "clash", "clash") for i, t in enumerate([*TEXTS, TEXTS[4]])]
    got = {r["doc_id"]: r for r in judge(spark.createDataFrame(rows, DOCS)).collect()}
    assert len(got) == len(rows)
    for i, text, *_ in rows:
        r, want = got[i], counts(text)
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == want, text
        assert r["base_failed"] == (want[0] < 50 or 100 * want[4] > 50 * want[0])
        assert not (r["base_failed"] and r["kept"])


def test_rules_and_empty_table(spark):
    base = " ".join(f"word{i}" for i in range(80))
    rows = [(1, base, "", ""), (2, base + " the of", "", ""), (3, "the of " + base + " ##########" * 4, "", ""), (4, "The OF " + base, "", "")]
    got = {r["doc_id"]: r["failed_rules"] for r in judge(spark.createDataFrame(rows, DOCS)).collect()}
    assert got == {1: ["stop_words"], 2: [], 3: ["symbols_per_word"], 4: []}
    assert judge(spark.createDataFrame([], DOCS)).count() == 0
    assert {r.name for r in RULES} >= {"stop_words", "duplicate_lines"}


def test_no_python_on_native_paths(spark):
    docs = spark.createDataFrame([(1, "a", "", "")], DOCS)
    plan = judge(docs)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


TURNS = "conv_id long, turn long, role string, text string, formatted string"
NASTY = ["", "\\", "</s>", "<\\/s>", "[INST]", "[I", "NST]", "<", "[", "\\\\[/INST]</s>", " [SAYS] ", "\n", "ok", "é😀", "[ROLE] x [SAYS] y"]


def check_conversations(spark, rows):
    template = Template()
    out = formatted(spark.createDataFrame([(*r, None) for r in rows], TURNS))
    got = out.select("conv_id", "formatted", "first_violation", "complete", read_turns(F.col("formatted")).alias("turns"), loss_text(F.col("segments")).alias("loss"), "segments").collect()
    convs = {}
    for conv, turn, role, text in rows:
        convs.setdefault(conv, []).append((turn is None, turn, role or "", text or ""))
    assert len(got) == len(convs)
    for r in got:
        turns = [(role, text) for _, _, role, text in sorted(convs[r["conv_id"]], key=lambda t: (t[0], t[1] or 0, t[2].encode(), t[3].encode()))]
        assert [tuple(t) for t in r["turns"]] == turns
        assert r["loss"] == "".join(text for role, text in turns if role == "assistant")
        assert r["formatted"] == template.begin + "".join(s["text"] for s in r["segments"])
        assert r["formatted"].count(template.end) == len(turns)
        state, bad = "", None
        for i, (role, _) in enumerate(turns):
            if bad is None and role not in template.order.get(state, ()):
                bad = i
            state = role
        assert r["first_violation"] == bad and r["complete"] == (bad is None and state == "assistant")


def test_chat_cases(spark):
    rows = [(1, 0, "user", "hi"), (1, 1, "assistant", None), (2, 1, "assistant", "b"), (2, 0, "user", "a"), (2, 0, "user", "a"), (None, None, None, None), (3, 0, "wizard", "[INST] </s>")]
    check_conversations(spark, rows)
    check_conversations(spark, [(k, i, role, text) for k, role in enumerate(("user", "assistant", "tool", "[INST]", "a [SAYS] b")) for i, text in enumerate(NASTY)])
    assert formatted(spark.createDataFrame([], TURNS)).count() == 0


@settings(max_examples=8, deadline=None)
@given(st.lists(st.lists(st.tuples(st.sampled_from(["user", "assistant", "system", "odd"]), st.lists(st.sampled_from(NASTY), max_size=5).map("".join)), min_size=1, max_size=4), min_size=1, max_size=25))
def test_chat_round_trip(spark, convs):
    check_conversations(spark, [(c, t, role, text) for c, turns in enumerate(convs) for t, (role, text) in enumerate(turns)])


