"""Leaks that no single diagonal holds half of: words put in, left out or replaced, short verbatim runs, far slots."""

from busward.llm.decontaminate import leaks


def test_edited_items(spark):
    words = lambda letter, n: [f"{letter}{'abcdefghij'[i // 10]}{'abcdefghij'[i % 10]}" for i in range(n)]
    item, short, other, long = words("i", 45), words("s", 16), words("o", 40), words("l", 100)
    far = ["put", "5", *words("f", 12), "and", "5", *words("g", 4)]
    square = [*words("p", 40), "5", "by", "5", *words("q", 40)]
    pad = words("x", 40)
    docs = {
        1: [*pad, *item[:22], "inserted", *item[22:], *pad],
        2: [*pad, *item[:22], *item[23:], *pad],
        3: [*pad, *item[:25], *pad],
        4: [*pad, *other[:14], *pad],
        5: [*pad, *other[3:16], *pad],
        6: [*pad, *short[:8], "replaced", *short[9:], *pad],
        7: [*pad, *["7" if i == 1 else w for i, w in enumerate(far)], *pad],
        8: [*pad, *["7" if i == 40 else "9" if i == 42 else w for i, w in enumerate(square)], *pad],
        9: [*long[:12], *pad, *words("y", 99), *long[40:52]],
    }
    bench = {1: item, 2: short, 3: other, 4: far, 5: square, 6: long}
    frame = lambda rows, name: spark.createDataFrame([(k, " ".join(v)) for k, v in rows.items()], f"{name} long, text string")
    got = {(r["doc_id"], r["item_id"]): r for r in leaks(frame(docs, "doc_id"), frame(bench, "item_id")).collect()}
    assert {k for k, r in got.items() if r["contaminated"]} == {(1, 1), (2, 1), (3, 1), (4, 3), (6, 2), (7, 4), (8, 5)}
    assert got[1, 1]["n_windows"] == 15 + 16 and got[1, 1]["n_item_windows"] == 38
    assert not got[5, 3]["contaminated"] and not got[9, 6]["contaminated"]
