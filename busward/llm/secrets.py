"""Secret scan: candidates by shape, then a random forest that removes false positives.

Built-in expressions and Spark ML only. Candidates are rare, so all that is computed for each of them is
small beside the one pass that finds them; the dictionary is counted over all documents.
"""

from __future__ import annotations

from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, functions as F

from busward.llm.common import staged, words

# Names that secrets are assigned to, and words that mark an example.
KEYWORDS = ("password", "passwd", "pwd", "secret", "token", "apikey", "api_key", "api-key", "access_key", "auth", "credential", "private_key")
EXAMPLES = ("example", "sample", "dummy", "test", "placeholder", "changeme", "fake", "mock")
# Shapes of well-known credentials.
PROVIDERS = r"^(AKIA[0-9A-Z]{16}|gh[pousr]_[A-Za-z0-9]{36}|xox[abprs]-[A-Za-z0-9-]{10,}|sk-[A-Za-z0-9_-]{20,}|AIza[0-9A-Za-z_-]{35})$"
HARMLESS = r"^([0-9.,:/()+-]+|[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}|[^@]+@[^@]+\.[a-z]+|https?://.*|v?[0-9]+(\.[0-9]+)+)$"

FEATURES = (
    "length", "digits", "upper", "lower", "symbols", "transitions", "distinct_chars", "hex", "covered", "keyword_near", "assigned", "example_near",
    "words_before", "path_length", "path_depth", "path_example",
)

_TRIM = "\"'`.,;:!?()[]{}<>*&%$#|"


#: What stands between a name and its value, and a value with its quotes or up to a separator.
_GLUE = r"[\"'\]]*(?::=|=>|[=:])"
_PLAIN = "[A-Za-z0-9_+/=.@:-]"
# The bound cuts only the captured front of a name, and keeps long runs linear.
_NAMED = rf"(?i)[a-z0-9_.-]{{0,64}}(?:{'|'.join(KEYWORDS)})[a-z0-9_.-]*+"


def _value(least: int) -> str:
    return rf"(?:\"[^\"\s]{{{least},}}\"|'[^'\s]{{{least},}}'|[\"'(\[{{<]*[^\s\"'`;&?,]{{{least},}})"


def _parted(text: Column) -> Column:
    """Lower-cased, with parts of mixed-case names (apiKey) parted."""
    return F.lower(F.regexp_replace(text, "(?<=[a-z0-9])(?=[A-Z])", "_"))


def _names_secret(text: Column, end: str = "") -> Column:
    return text.rlike(rf"(?<![a-z])(?:{'|'.join(KEYWORDS)})(?![a-z]){end}")


def candidates(docs: DataFrame, path: str = "source", least: int = 8) -> DataFrame:
    """doc_id, at (word position), candidate, value_name, before, after, path for each value that may be a secret.

    A value is any run of at least `least` characters of [A-Za-z0-9_+/=.@:-] with a digit, wherever it stands
    in a word, without a leading name= (the name may be quoted). What is assigned to a secret's name, in the
    same word or after `name =`, may hold other characters too, up to its closing quote, a blank or one of
    ; & ? , and needs no digit. A word may have several values. Null texts have none.
    """
    text, run = F.col("text"), f"{_PLAIN}{{{least},}}"
    listed = f"(?i)(?:{'|'.join(KEYWORDS)})"
    bearing = docs.filter(text.rlike(run) & text.rlike("[0-9]") | text.rlike(listed))
    own = bearing.select("doc_id", F.col(path).alias("path"), words(text).alias("w"))
    inside = _NAMED + _GLUE + _value(least)

    def spots(w: Column) -> Column:
        near = lambda i, k: F.coalesce(F.get(w, i + k), F.lit(""))
        spaced = lambda x, i: (F.length(x) >= least) & (near(i, -1).rlike("(?:=>|[=:])$") | x.rlike("^[=:]")) & F.concat_ws(" ", near(i, -2), near(i, -1)).rlike(listed)
        bears = lambda x, i: x.rlike("[0-9]") & x.rlike(run) | x.rlike("[=:].") & x.rlike(inside) | spaced(x, i)
        at = F.filter(F.transform(w, lambda x, i: F.when(bears(x, i), i)), lambda i: i.isNotNull())
        return F.transform(at, lambda i: F.struct(
            i.alias("at"), near(i, 0).alias("word"),
            F.concat_ws(" ", near(i, -3), near(i, -2), near(i, -1)).alias("before"), F.concat_ws(" ", near(i, 1), near(i, 2)).alias("after"),
        ))

    # The words are bound once, as the element of an array of one: else they are split anew for every word that looks at its neighbours.
    # The outer explode: from a plain one Spark infers a filter that searches the text a second time.
    row = own.select("doc_id", "path", F.explode_outer(F.flatten(F.transform(F.array("w"), spots))).alias("c")).filter("c IS NOT NULL").select("doc_id", "path", "c.*")
    trimmed = lambda x: F.btrim(x, F.lit(_TRIM))
    # A value in quotes keeps the signs at its ends, others lose them.
    quoted = rf"^(\"|')([^\s]{{{least},}})\1$"
    bare = lambda x: F.when(x.rlike(quoted), F.regexp_extract(x, quoted, 2)).otherwise(trimmed(x))
    pair = lambda name, value: F.struct(name.alias("name"), value.alias("value"))
    assigned = F.regexp_extract_all("word", F.lit(f"({inside})"), F.lit(1))
    assigned = F.transform(assigned, lambda x: pair(F.regexp_extract(x, rf"^([A-Za-z0-9_.-]+){_GLUE}", 1), bare(F.regexp_replace(x, rf"^[A-Za-z0-9_.-]+{_GLUE}", ""))))
    assigned = F.filter(assigned, lambda x: _names_secret(_parted(x["name"])))
    operator = r"^(?::=|=>|[=:])"
    open_end = _names_secret(_parted(F.concat_ws(" ", "before", F.regexp_extract("word", operator, 0))), rf"[a-z0-9_.-]*[\"'\]]*\s*(?::=|=>|[=:])\s*$")
    alone = bare(F.regexp_extract(F.regexp_replace("word", operator, ""), f"^{_value(least)}", 0))
    follows = F.when(open_end & (F.size("_assigned") == 0), F.array(pair(F.lit(""), alone))).otherwise(F.array().cast("array<struct<name:string,value:string>>"))
    plain = F.regexp_extract_all("word", F.lit(rf"((?:[A-Za-z_-]+[\"']?[=:][\"']?)?{run})"), F.lit(1))
    plain = F.transform(plain, lambda x: pair(F.regexp_extract(trimmed(x), r"^([A-Za-z_-]+)[\"']?[=:]", 1), trimmed(F.regexp_replace(trimmed(x), r"^[A-Za-z_-]+[\"']?[=:]", ""))))
    rest = F.filter("_plain", lambda x: x["value"].rlike("[0-9]") & ~F.exists("_named", lambda y: F.contains(y["value"], x["value"]) | F.contains(x["value"], y["value"]) & F.startswith(x["value"], y["name"]) & (y["name"] != "")))
    each = row.withColumn("_assigned", assigned).withColumn("_named", F.filter(F.concat("_assigned", follows), lambda x: F.length(x["value"]) >= least)).withColumn("_plain", plain)
    each = each.withColumn("c", F.explode(F.concat("_named", rest)))
    return each.select(
        "doc_id", "at", F.col("c.value").alias("candidate"), _parted(F.col("c.name")).alias("value_name"), _parted(F.col("before")).alias("before"), F.lower("after").alias("after"), "path"
    ).filter(F.length("candidate") >= least)


def dictionary(docs: DataFrame, least: int = 5) -> DataFrame:
    """entry: words of letters that at least `least` documents hold, lower-cased."""
    plain = F.filter(words(F.lower("text")), lambda w: F.length(w).between(3, 24) & w.rlike(r"^\p{L}+$"))
    each = docs.select(F.explode(F.array_distinct(plain)).alias("entry"))
    return each.groupBy("entry").agg(F.count("*").alias("n")).filter(F.col("n") >= least).select("entry")


def _any(text: Column, listed: tuple[str, ...]) -> Column:
    return text.rlike(rf"(?<![a-z])(?:{'|'.join(listed)})(?![a-z])").cast("double")


def described(found: DataFrame, entries: DataFrame) -> DataFrame:
    """Candidates with the columns of FEATURES, all doubles."""
    value = F.col("candidate")
    share = lambda pattern: F.regexp_count(value, F.lit(pattern)) / F.length(value)
    change = r"(?<=[0-9])(?=[A-Za-z])|(?<=[A-Za-z])(?=[0-9])|(?<=[a-z])(?=[A-Z])|(?<=[A-Z])(?=[a-z])"
    last = F.element_at(F.split("before", " "), -1)
    runs = F.array_distinct(F.regexp_extract_all(F.lower(value), F.lit(r"\p{L}{3,}"), F.lit(0)))
    rows = found.withColumns(
        {
            "length": F.length(value).cast("double"),
            "digits": share("[0-9]"),
            "upper": share("[A-Z]"),
            "lower": share("[a-z]"),
            "symbols": share("[^A-Za-z0-9]"),
            "transitions": share(change),
            "distinct_chars": F.size(F.array_distinct(F.split(value, ""))) / F.length(value),
            "hex": value.rlike("^[0-9A-Fa-f]+$").cast("double"),
            "keyword_near": _any(F.concat_ws(" ", "before", "value_name"), KEYWORDS),
            "assigned": ((F.col("value_name") != "") | last.isin("=", ":", ":=") | last.rlike("[=:]$")).cast("double"),
            "example_near": _any(F.concat_ws(" ", "before", "value_name", "after", F.lower(value)), EXAMPLES),
            "words_before": F.size(F.filter(F.split("before", " "), lambda w: w.rlike(r"^\p{L}+$"))).cast("double"),
            "path_length": F.length(F.coalesce("path", F.lit(""))).cast("double"),
            "path_depth": F.regexp_count(F.coalesce("path", F.lit("")), F.lit("/")).cast("double"),
            "path_example": _any(F.lower(F.coalesce("path", F.lit(""))), EXAMPLES),
        }
    )
    parts = rows.select("candidate", F.explode(runs).alias("entry")).distinct()
    covered = parts.join(entries, "entry").groupBy("candidate").agg(F.sum(F.length("entry")).alias("_letters"))
    joined = rows.join(covered, "candidate", "left")
    return joined.withColumn("covered", F.least(F.coalesce(F.col("_letters"), F.lit(0)) / F.length(value), F.lit(1.0))).drop("_letters")


def label(rows: DataFrame) -> DataFrame:
    """Labelled findings by rule: 1 for the shape of a provider or a mixed value assigned to a secret's name, 0 for
    numbers, addresses, versions and values beside words that mark examples, null (not labelled) for the rest."""
    value = F.col("candidate")
    mixed = value.rlike("[0-9]") & value.rlike("[A-Za-z]")
    real = (value.rlike(PROVIDERS) | ((F.col("keyword_near") == 1) & (F.col("assigned") == 1) & mixed & (F.col("length") >= 12))) & (F.col("example_near") == 0)
    harmless = value.rlike(HARMLESS) | (F.col("example_near") == 1)
    return rows.withColumn("label", F.when(real, 1.0).when(harmless, 0.0))


def classified(rows: DataFrame, most_labelled: int = 50_000, trees: int = 20, depth: int = 6, seed: int = 7) -> DataFrame:
    """rows with secret (boolean) and probability, by a forest fitted on the labelled rows.

    Fitting takes at most most_labelled rows, those of the smallest hash of their value and place: a model
    needs no more, and its memory stays bounded. All rows are scored. Where fewer than two labels occur,
    every row has the one there is; where none does, no row is a secret.
    """
    rows = staged(rows.withColumn("_dice", F.xxhash64("candidate", "doc_id", "at")), "findings")
    (n, low, high) = rows.filter("label IS NOT NULL").agg(F.count("*"), F.min("label"), F.max("label")).first()
    if low is None or low == high:
        return rows.drop("_dice").withColumns({"secret": F.lit(bool(high)), "probability": F.lit(float(high or 0))})
    # An even share by hash instead of a sort; a hash is uniform, so the bound is kept up to chance and halved to be safe.
    part = rows.filter("label IS NOT NULL") if n <= most_labelled else rows.filter("label IS NOT NULL").filter(F.pmod("_dice", F.lit(1 << 20)) < int((1 << 20) * 0.5 * most_labelled / n))
    gather = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    forest = RandomForestClassifier(labelCol="label", featuresCol="features", numTrees=trees, maxDepth=depth, seed=seed)
    model = forest.fit(gather.transform(part).select("features", "label"))
    scored = model.transform(gather.transform(rows))
    return scored.withColumn("probability", vector_to_array("probability")[1]).withColumn("secret", F.col("prediction") == 1).drop("features", "rawPrediction", "prediction", "_dice")


def scan(docs: DataFrame, path: str = "source", **settings) -> DataFrame:
    """Every candidate of docs (doc_id, text and a path column) with its features, label, probability and secret.

    Nulls in any column, empty and repeated rows are allowed: null texts have no candidates, null paths are
    empty ones, and a repeated row repeats its candidates.
    """
    found = staged(candidates(docs, path), "candidates")
    return classified(label(described(found, dictionary(docs.select("text")))), **settings)
