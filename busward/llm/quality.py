"""Quality rules: a threshold table compiled into one projection over length, symbols, stop words and lines.

Everything is a built-in expression; no row leaves its task and nothing is shuffled.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from busward.llm.common import BLANKS, words

# Frequent function words of the four languages of the corpus.
STOP_WORDS = (
    "the be to of and that have with in is was it for on as at by this are",
    "le la les de des du et un une en que qui dans pour est pas sur avec au",
    "der die das und ist von zu den mit ein eine für auf im dem nicht sich",
    "el los las del y un una que en por con para es se no su al como lo",
)


@dataclass(frozen=True)
class Rule:
    """A document fails if numerator / denominator is below `low` or above `high` (None: no bound).

    A denominator of 0 passes. Bounds are compared as products of integers by 1000, so no rounding decides.
    """

    name: str
    numerator: str
    denominator: str | None = None
    low: float | None = None
    high: float | None = None

    def failed(self) -> Column:
        over = F.col(self.denominator) if self.denominator else F.lit(1)
        scaled = F.col(self.numerator) * 1000
        bad = F.lit(False)
        if self.low is not None:
            bad = bad | (scaled < over * round(self.low * 1000))
        if self.high is not None:
            bad = bad | (scaled > over * round(self.high * 1000))
        return bad & (over > 0)


#: Bounds after the published heuristics for web text; the contract's base rules are separate.
RULES = (
    Rule("mean_word_length", "word_chars", "n_words", low=2, high=15),
    Rule("symbols_per_word", "n_symbols", "n_words", high=0.35),
    Rule("stop_words", "n_stop_words", None, low=2),
    Rule("duplicate_lines", "n_dup_lines", "n_lines", high=0.5),
    Rule("bullet_lines", "n_bullet_lines", "n_lines", high=0.9),
    Rule("ellipsis_lines", "n_ellipsis_lines", "n_lines", high=0.3),
)


def repeated_words(tokens: Column) -> Column:
    """Words inside three-word windows that occur twice or more in the text.

    Windows are sorted by hash with their position, so equal ones are neighbours; no step is quadratic.
    Windows are told apart by a 64-bit hash of their words.
    """
    n = F.size(tokens)
    hashed = F.transform(tokens, lambda w: F.xxhash64(w))
    at = lambda a, i: F.get(a, i)

    def starts(h: Column) -> Column:
        return F.sort_array(
            F.transform(
                F.sequence(F.lit(0), n - 3),
                lambda i: F.struct(F.xxhash64(at(h, i), at(h, i + 1), at(h, i + 2)).alias("h"), i.alias("i")),
            )
        )

    def covered(s: Column) -> Column:
        last = F.size(s) - 1
        twin = F.filter(
            s,
            lambda x, k: ((k > 0) & (at(s, k - 1)["h"] == x["h"])) | ((k < last) & (at(s, k + 1)["h"] == x["h"])),
        )
        positions = F.flatten(F.transform(twin, lambda x: F.array(x["i"], x["i"] + 1, x["i"] + 2)))
        return F.size(F.array_distinct(positions))

    def counted(h: Column) -> Column:
        plain = F.transform(F.sequence(F.lit(0), n - 3), lambda i: F.xxhash64(at(h, i), at(h, i + 1), at(h, i + 2)))
        # Most texts repeat no window and need no sort.
        return F.when(F.size(F.array_distinct(plain)) == n - 2, F.lit(0)).otherwise(F.transform(F.array(starts(h)), covered)[0])

    # Each array is bound to a lambda variable, so it is computed once and not at every use.
    return F.when(n >= 4, F.transform(F.array(hashed), counted)[0]).otherwise(F.lit(0)).cast("long")


def measured(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds the counts that rules name. A null text counts as an empty one; clashing columns are replaced."""
    body = F.coalesce(F.col(text), F.lit(""))
    listed = sorted({w for line in STOP_WORDS for w in line.split()})
    # All three spellings are listed, so that words need no lower-casing one by one.
    stop = F.array(*[F.lit(v) for w in listed for v in dict.fromkeys((w, w.capitalize(), w.upper()))])
    with_arrays = df.withColumns(
        {
            "_words": words(body),
            "_lines": F.filter(F.split(body, "\n"), lambda line: F.length(F.btrim(line, F.lit(BLANKS))) > 0),
            "n_symbols": F.length(F.regexp_replace(body, r"[^#*$%&|<>]+", "")).cast("long"),
        }
    )
    first = lambda line: F.substring(F.btrim(line, F.lit(BLANKS)), 1, 1)
    return with_arrays.withColumns(
        {
            "n_words": F.size("_words").cast("long"),
            "word_chars": F.length(F.array_join("_words", "")).cast("long"),
            "n_lines": F.size("_lines").cast("long"),
            "n_dup_lines": (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"),
            "n_bullet_lines": F.size(F.filter("_lines", lambda x: first(x).isin("-", "*", "•"))).cast("long"),
            "n_ellipsis_lines": F.size(F.filter("_lines", lambda x: F.rtrim(x).endswith("...") | F.rtrim(x).endswith("…"))).cast("long"),
            "n_stop_words": F.size(
                F.array_distinct(F.transform(F.array_intersect("_words", stop), lambda w: F.lower(w)))
            ).cast("long"),
            "n_repeat_words": repeated_words(F.col("_words")),
        }
    ).drop("_words", "_lines")


def judge(df: DataFrame, rules: tuple[Rule, ...] = RULES, text: str = "text", min_words: int = 50, max_repeat_pct: int = 50) -> DataFrame:
    """Every row with its counts, base_failed, the names of failed rules, and kept.

    Nulls and empty texts have no words and fail the base rule. Repeated rows are judged alike, each for itself.
    Columns of the input with the names of results are replaced.
    """
    base = (F.col("n_words") < min_words) | (F.col("n_repeat_words") * 100 > F.col("n_words") * max_repeat_pct)
    failed = F.array_compact(F.array(*[F.when(r.failed(), F.lit(r.name)) for r in rules])) if rules else F.array().cast("array<string>")
    out = measured(df, text).withColumn("base_failed", base).withColumn("failed_rules", failed)
    return out.withColumn("kept", ~F.col("base_failed") & (F.size("failed_rules") == 0))
