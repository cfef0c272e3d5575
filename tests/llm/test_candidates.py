"""Secrets inside words, with odd characters and without digits."""

from busward.llm.secrets import candidates, described, dictionary, label


def test_values_inside_words(spark):
    cases = {
        '{"api_key":"Zx9kQ2mB7tR4Lw8p"}': ["Zx9kQ2mB7tR4Lw8p"],
        '{"a":1,"api_key":"Zx9kQ2mB7tR4Lw8p","token":"Qq8kQ2mB7tR4"}': ["Qq8kQ2mB7tR4", "Zx9kQ2mB7tR4Lw8p"],
        "see https://h.io/x?token=Zx9kQ2mB7tR4&u=1 now": ["Zx9kQ2mB7tR4"],
        "token=Zx9kQ2mB7tR4;user=1": ["Zx9kQ2mB7tR4"],
        "password=S3cur3!Pass#77x": ["S3cur3!Pass#77x"],
        'password="S3cur3;Pass?77x!"': ["S3cur3;Pass?77x!"],
        "password=CorrectHorseBattery": ["CorrectHorseBattery"],
        "the password = CorrectHorseBattery is": ["CorrectHorseBattery"],
        'clientSecret := "Correct!Horse!Battery"': ["Correct!Horse!Battery"],
        "author=ChristopherSmith wrote this": [],
        "f(run=ab12cd34ef)": ["ab12cd34ef"],
        "plain words: nothing here": [],
        "password=abc123def456ghi7": ["abc123def456ghi7"],
    }
    docs = spark.createDataFrame([(i, t, "s") for i, t in enumerate(cases)], "doc_id long, text string, source string")
    got = candidates(docs).collect()
    assert {t: sorted(r["candidate"] for r in got if r["doc_id"] == i) for i, t in enumerate(cases)} == cases
    plan = described(candidates(docs), dictionary(docs))._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan


def test_compound_names(spark):
    names = ["client_secret", "db_password", "aws_secret_access_key", "auth_token", "github_token", "clientSecret", "password2", "secretary", "tokenizer", "author"]
    rows = [(2 * i + k, f"set {n}{'=' if k else ' = '}Zx9kQ2mB7tR4Lw8p here", "s") for i, n in enumerate(names) for k in (0, 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = {r["doc_id"]: (r["keyword_near"], r["label"]) for r in label(described(candidates(docs), dictionary(docs))).collect()}
    assert got == {i: (1.0, 1.0) if i < 14 else (0.0, None) for i, _, _ in rows}
