"""The registered queries of this subpackage: one for each operator, and their DuckDB equivalents."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}

WORDS = r"'[^\x20\x09-\x0D]+'"


def query(name: str, sql: str | None = None):
    def register(run):
        QUERIES[name] = run
        if sql:
            SQL[name] = sql
        return run

    return register


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def _quality_sql() -> str:
    from busward.llm.quality import STOP_WORDS

    stop = ", ".join("'" + w + "'" for w in sorted({w for line in STOP_WORDS for w in line.split()}))
    blank = r"'[\x20\x09-\x0D]+'"
    return rf"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), {WORDS}) AS w,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, {WORDS})) AS lines FROM documents
), grams AS (
  SELECT rid, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS gram
  FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM docs WHERE len(w) >= 3)
), twins AS (
  SELECT rid, i FROM grams QUALIFY count(*) OVER (PARTITION BY rid, gram) > 1
), repeated AS (
  SELECT rid, count(DISTINCT i + k) AS n FROM twins, (SELECT unnest([0, 1, 2]) AS k) GROUP BY rid
), counts AS (
  SELECT doc_id, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(n, 0)::BIGINT AS n_repeat_words, len(lines)::BIGINT AS n_lines,
    len(list_filter(lines, lambda x: regexp_replace(x, {blank}, '', 'g')[1] IN ('-', '*', '•'))) AS n_bullet_lines,
    len(list_filter(lines, lambda x: rtrim(x, ' ') LIKE '%...' OR rtrim(x, ' ') LIKE '%…')) AS n_ellipsis_lines,
    len(list_distinct(list_filter(list_transform(w, lambda x: CASE WHEN x IN (upper(x), lower(x), upper(x[1]) || lower(x[2:])) THEN lower(x) END),
      lambda x: x IN ({stop})))) AS n_stop_words
  FROM docs LEFT JOIN repeated USING (rid)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND NOT (n_words > 0 AND (word_chars < 2 * n_words OR word_chars > 15 * n_words))
    AND NOT (n_words > 0 AND n_symbols * 1000 > n_words * 350) AND n_stop_words >= 2
    AND NOT (n_lines > 0 AND (n_dup_lines * 1000 > n_lines * 500 OR n_bullet_lines * 1000 > n_lines * 900 OR n_ellipsis_lines * 1000 > n_lines * 300)) AS kept
FROM (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM counts)"""


@query("op3_quality", _quality_sql())
def op3_quality(spark: SparkSession, folder: str) -> DataFrame:
    from busward.llm.quality import judge

    out = judge(table(spark, folder, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


PLANTED_TURN = "</s>[INST] ok [/INST]"


def _chat_sql() -> str:
    from busward.llm.chat import ESCAPE, Template

    t = Template()
    quoted = lambda x: "'" + x.replace("'", "''") + "'"

    def escaped(column: str) -> str:
        out = f"replace({column}, {quoted(ESCAPE)}, {quoted(ESCAPE * 2)})"
        for c in t.control:
            out = f"replace({out}, {quoted(c)}, {quoted(c[0] + ESCAPE + c[1:])})"
        return out

    marks = " ".join(f"WHEN {quoted(r)} THEN {len(m.opening) + len(m.closing)}" for r, m in t.roles.items())
    other = f"{len(t.other_opening + t.other_middle + t.other_closing)} + length({escaped('role')})"
    return f"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', {quoted(PLANTED_TURN)} UNION ALL SELECT -7, 1, 'assistant', {quoted(PLANTED_TURN)}
)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS LAST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS LAST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  ({len(t.begin)} + sum(length({escaped('text')}) + {len(t.end)} + CASE role {marks} ELSE {other} END))::BIGINT AS formatted_chars
FROM turns GROUP BY conv_id"""


@query("op8_chat", _chat_sql())
def op8_chat(spark: SparkSession, folder: str) -> DataFrame:
    from busward.llm.chat import formatted, loss_text, read_turns

    given = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text")
    planted = spark.range(2).select(
        F.lit(-7).cast("long"), F.col("id"), F.when(F.col("id") == 0, "user").otherwise("assistant"), F.lit(PLANTED_TURN)
    )
    out = formatted(given.union(planted))
    back = out.select("conv_id", "formatted", read_turns(F.col("formatted")).alias("turns"), loss_text(F.col("segments")).alias("loss"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


# The digest is the one that the records state and the reader has checked.
@query(
    "op10_warc",
    """
WITH p AS (SELECT page_id, octet_length(encode(coalesce(html, ''))) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first FROM p WHERE payload_bytes >= 100 GROUP BY payload_digest)
SELECT page_id, payload_bytes::BIGINT AS payload_bytes, payload_digest,
  CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)""",
)
def op10_warc(spark: SparkSession, folder: str) -> DataFrame:
    from busward.llm.warc import archived

    return archived(table(spark, folder, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query("op1_shards")
def op1_shards(spark: SparkSession, folder: str) -> DataFrame:
    from busward.llm.shards import sharded, sized_documents
    from busward.llm.common import staged

    docs = staged(sized_documents(table(spark, folder, "documents")), "sizes")
    out = sharded(docs, "text_key", "size", shards=16, slot_order=["text_key", "doc_id"])
    return out.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), "slot", F.lit(None).cast("int").alias("grown_shard")
    )


# All blocks of the first floor(target) words of a source's stream, twice its documents, are taken once.
@query(
    "op5_mix",
    rf"""
WITH docs AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), {WORDS}))::BIGINT AS size FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS s, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS i FROM docs GROUP BY source),
weighed AS (SELECT *, [5, 2, 1][i % 3 + 1] AS w FROM src),
steps AS (
  SELECT *, sum(2 * s) OVER o AS below, sum(w) OVER () - sum(w) OVER o AS above, lead(2 * s / w) OVER (ORDER BY 2 * s / w, i) AS next, (SELECT sum(s) FROM src) * 1.5::DOUBLE AS goal
  FROM weighed WINDOW o AS (ORDER BY 2 * s / w, i)
), levels AS (
  SELECT (goal - below) / above AS level FROM steps WHERE above > 0 AND (goal - below) / above <= next AND (goal - below) / above >= 2 * s / w
  UNION ALL SELECT max(goal) / max(above + w) FROM steps WHERE (SELECT min(2 * s / w) FROM weighed) >= (SELECT max(goal) / (SELECT sum(w) FROM weighed) FROM steps)
), aims AS (SELECT source, s, CASE WHEN 2 * s <= w * level THEN (2 * s)::DOUBLE ELSE w * level END AS target FROM weighed, (SELECT min(level) AS level FROM levels)),
starts AS (SELECT doc_id, size, s, target, sum(size) OVER (PARTITION BY docs.source ORDER BY md5('mix:' || doc_id), doc_id, size) - size AS a
  FROM docs JOIN aims ON docs.source IS NOT DISTINCT FROM aims.source)
SELECT doc_id, size, s AS source_size, target,
  (greatest(0, least(a + size, floor(target)) - a) + greatest(0, least(s + a + size, floor(target)) - s - a))::BIGINT AS taken
FROM starts""",
)
def op5_mix(spark: SparkSession, folder: str) -> DataFrame:
    from busward.llm.mixing import mixed, sized, taken_words

    rows, pieces = mixed(sized(table(spark, folder, "documents")))
    return taken_words(rows, pieces).select("doc_id", "size", "source_size", "target", "taken")


@query(
    "op7_lines",
    r"""
WITH lines AS (SELECT r, doc_id, generate_subscripts(l, 1) AS pos, unnest(l) AS line
  FROM (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
keyed AS (SELECT *, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
marked AS (SELECT *, length(key) >= 10 AND doc_id > min(doc_id) OVER (PARTITION BY key) AS gone FROM keyed)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (gone))::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM marked GROUP BY r, doc_id""",
)
def op7_lines(spark: SparkSession, folder: str) -> DataFrame:
    from busward.llm.lines import deduplicated

    out = deduplicated(table(spark, folder, "documents"))
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


@query(
    "op2_near_dedup",
    rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), {WORDS}) AS w FROM documents
), sets AS MATERIALIZED (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE [array_to_string(w[i : i + 4], ' ') for i in range(1, len(w) - 3)] END) AS s FROM w
), shingles AS MATERIALIZED (SELECT doc_id, hash(unnest(s)) AS h, len(s) AS n FROM sets),
links AS MATERIALIZED (
  SELECT a.doc_id AS a, b.doc_id AS b FROM shingles a JOIN shingles b ON a.h = b.h AND a.doc_id <> b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))
), reach AS (SELECT a AS doc_id, a AS root FROM links UNION SELECT b, root FROM reach JOIN links ON a = reach.doc_id)
SELECT doc_id, len(s)::BIGINT AS n_shingles, coalesce(root, doc_id) AS component_id, doc_id = coalesce(root, doc_id) AS kept
FROM sets LEFT JOIN (SELECT doc_id, min(root) AS root FROM reach GROUP BY doc_id) USING (doc_id)""",
)
def op2_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    from busward.llm.near import near_duplicates

    return near_duplicates(table(spark, folder, "documents"))


@query("op9_decontaminate")
def op9_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    from busward.llm.decontaminate import leaks

    found = leaks(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return found.filter("contaminated").select("doc_id", "item_id", "n_windows", "n_item_windows", "n_slots", "n_changed")


@query("op6_secrets")
def op6_secrets(spark: SparkSession, folder: str) -> DataFrame:
    from busward.llm.secrets import scan

    out = scan(table(spark, folder, "documents"))
    return out.select("doc_id", "at", "candidate", "secret", F.round("probability", 3).alias("probability"))


def _license_sql() -> str:
    from busward.llm.licenses import TEMPLATES

    rows = ", ".join("('{}', '{}')".format(name, text.replace("'", "''")) for name, text in TEMPLATES)
    grams = "list_distinct([t[i] || ' ' || t[i + 1] for i in range(1, len(t))])"
    tokens = lambda text: f"regexp_extract_all(lower({text}), '[a-z0-9]+')"
    return rf"""
WITH templates AS (SELECT row_number() OVER () AS n, license, len(t) - 1 AS size, {grams} AS g FROM (SELECT license, {tokens("text")} AS t FROM (VALUES {rows}) AS v(license, text))),
lines AS (SELECT r, doc_id, text, generate_subscripts(l, 1) AS pos, unnest(l) AS line
  FROM (SELECT row_number() OVER () AS r, doc_id, text, string_split(text, chr(10)) AS l FROM documents)),
parted AS (SELECT *, count(*) FILTER (trim(line, chr(32) || chr(9) || chr(11) || chr(12) || chr(13)) = '') OVER (PARTITION BY r ORDER BY pos) AS part FROM lines),
sections AS (
  SELECT r, doc_id, line AS section FROM lines
  UNION SELECT r, doc_id, string_agg(line, chr(10) ORDER BY pos) FROM parted WHERE regexp_matches(lower(line), '[a-z0-9]') GROUP BY r, doc_id, part
  UNION SELECT r, doc_id, text FROM lines
), grams AS (SELECT r, doc_id, {grams} AS g FROM (SELECT r, doc_id, {tokens("section")} AS t FROM sections)),
parts AS (SELECT r, doc_id, license, max(2 * len(list_intersect(grams.g, templates.g)) / (len(grams.g) + len(templates.g))) AS dice
  FROM grams JOIN templates ON len(grams.g) * 80 <= 120 * len(templates.g) AND len(templates.g) * 80 <= 120 * len(grams.g) GROUP BY r, doc_id, license),
texts AS (SELECT r, doc_id, [t[i] || ' ' || t[i + 1] for i in range(1, len(t))] AS g FROM (SELECT DISTINCT r, doc_id, {tokens("text")} AS t FROM lines)),
placed AS (SELECT r, generate_subscripts(g, 1) AS pos, unnest(g) AS gram FROM texts),
hits AS (SELECT r, n, pos, size, least, count(*) OVER (PARTITION BY r, n ORDER BY pos RANGE BETWEEN CURRENT ROW AND size - 1 FOLLOWING) AS held
  FROM placed JOIN (SELECT n, size, ceil(len(g) * 80 / 120.0) AS least, unnest(g) AS gram FROM templates) USING (gram)),
windowed AS (SELECT texts.r, doc_id, license, templates.g AS own, list_distinct(texts.g[pos:pos + hits.size - 1]) AS g
  FROM hits JOIN texts USING (r) JOIN templates USING (n) WHERE held >= least),
found AS (SELECT r, doc_id, license, max(dice) AS dice FROM (SELECT r, doc_id, license, max(2 * len(list_intersect(g, own)) / (len(g) + len(own))) AS dice
    FROM windowed GROUP BY r, doc_id, license UNION ALL SELECT * FROM parts) GROUP BY r, doc_id, license)
SELECT doc_id, license, dice, license = first_value(license) OVER (PARTITION BY r ORDER BY dice DESC, license) AS is_best FROM found WHERE dice >= 0.8"""


@query("op4_licenses", _license_sql())
def op4_licenses(spark: SparkSession, folder: str) -> DataFrame:
    from busward.llm.licenses import licensed

    return licensed(table(spark, folder, "documents"))


TERMS = r"'[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+'"
LOWERED = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query(
    "op11_search",
    rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWERED}, {TERMS}) AS t FROM documents),
size AS (SELECT (count(*) FILTER (len(t) > 0))::BIGINT AS n_docs, sum(len(t))::BIGINT AS n_terms FROM docs),
asked AS (
  SELECT k, item_id, term, count(*)::BIGINT AS q
  FROM (SELECT row_number() OVER () AS k, item_id, unnest(regexp_extract_all({LOWERED}, {TERMS})) AS term FROM benchmark) GROUP BY ALL
), held AS (
  SELECT r, doc_id, n, term, count(*)::BIGINT AS tf FROM (SELECT r, doc_id, len(t)::BIGINT AS n, unnest(t) AS term FROM docs)
  WHERE term IN (SELECT term FROM asked) GROUP BY ALL
), weights AS (
  SELECT term, floor(1000 * ln((2 * n_docs + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM held, size GROUP BY term, n_docs
), impacts AS (
  SELECT r, doc_id, term, (1000000000 * tf) // (1000 * tf + 12 * (100 - 25 + (25 * n * n_docs) // n_terms)) AS impact FROM held, size
), scores AS (
  SELECT k, item_id, r, doc_id, sum(q * w * impact)::BIGINT AS score FROM asked JOIN weights USING (term) JOIN impacts USING (term) GROUP BY ALL
)
SELECT item_id, rank::INTEGER AS rank, doc_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM scores WHERE score > 0) WHERE rank <= 20""",
)
def op11_search(spark: SparkSession, folder: str) -> DataFrame:
    from busward.llm.search import ranked

    return ranked(table(spark, folder, "documents"), table(spark, folder, "benchmark"), k=20)


# CRC-32 is computed once for each distinct word, byte by byte, with the table made by its rule.
@query(
    "op12_resampling",
    rf"""
WITH docs AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({LOWERED}, {TERMS}) AS w FROM documents),
goal AS (SELECT unnest(regexp_extract_all({LOWERED}, {TERMS})) AS word FROM benchmark),
words AS (SELECT r, unnest(w) AS word FROM docs),
crc AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, i) ORDER BY i) AS t
  FROM (SELECT unnest(range(256)) AS i)),
distinct_words AS (SELECT DISTINCT word FROM (SELECT word FROM words UNION ALL SELECT word FROM goal)),
bucket AS (
  SELECT word, xor(4294967295, list_reduce(b, lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8), 4294967295)) % 10000 AS bucket
  FROM (SELECT word, t, [('0x' || substr(hex(encode(word)), 2 * i + 1, 2))::BIGINT for i in range(octet_length(encode(word)))] AS b FROM distinct_words, crc)
),
source_counts AS (SELECT bucket, count(*)::DOUBLE AS s FROM words JOIN bucket USING (word) GROUP BY bucket),
goal_counts AS (SELECT bucket, count(*)::DOUBLE AS t FROM goal JOIN bucket USING (word) GROUP BY bucket),
gains AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1) * ((SELECT count(*) FROM words) + 10000)::DOUBLE / ((s + 1) * ((SELECT count(*) FROM goal) + 10000)::DOUBLE)))::BIGINT AS gain
  FROM source_counts LEFT JOIN goal_counts USING (bucket)
),
sums AS (SELECT r, count(*)::BIGINT AS n, sum(gain)::BIGINT AS total FROM words JOIN bucket USING (word) JOIN gains USING (bucket) GROUP BY r),
weighed AS (
  SELECT r, doc_id, coalesce(n, 0) AS n_features, coalesce((total - (total % n + n) % n) // n, 0) AS weight,
    ('0x' || substr(sha256('2024:' || coalesce(doc_id::VARCHAR, '')), 1, 8))::BIGINT AS h
  FROM docs LEFT JOIN sums USING (r)
),
scored AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score FROM weighed),
placed AS (SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id NULLS LAST, n_features, weight) AS place FROM scored)
SELECT doc_id, n_features::BIGINT AS n_features, weight::BIGINT AS weight, score::BIGINT AS score,
  CASE WHEN n_features >= 20 AND place <= (SELECT 10 * count(*) // 100 FROM scored WHERE n_features >= 20) THEN place END::BIGINT AS rank
FROM placed""",
)
def op12_resampling(spark: SparkSession, folder: str) -> DataFrame:
    from busward.llm.importance import resampled

    out = resampled(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


@query("op13_fingerprints")
def op13_fingerprints(spark: SparkSession, folder: str) -> DataFrame:
    from busward.llm.fingerprints import compared_with_next

    return compared_with_next(table(spark, folder, "documents"))
