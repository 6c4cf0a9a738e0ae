"""The operators over the driver's tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from netweave.llm.audit import audit_filters
from netweave.llm.base import crc_bucket
from netweave.llm.chat import link_tool_calls
from netweave.llm.decontaminate import contamination
from netweave.llm.embeddings import near_vectors
from netweave.llm.html import extract_pages
from netweave.llm.lm import score_texts
from netweave.llm.mixing import mix_sources
from netweave.llm.quality import fit_quality, score_quality
from netweave.llm.secrets import secret_spans
from netweave.llm.simhash import near_duplicates
from netweave.llm.spelling import spelling_groups
from netweave.llm.tokens import token_counts
from netweave.llm.toxicity import fit_toxicity, score_toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The kinds of the base rules, in their order.
BASE_KINDS = ("assign", "access", "hex")
QUALITY_CUT = 0.7
TOXIC_CUT = 0.5


def query(name: str, sql: str | None = None):
    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql.strip()
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("op1_token_counts")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def _joined(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _count(kind: str):
    return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")


# The k-th match begins where its text first occurs after the end of the one before: an earlier
# place would itself have been part of an earlier match.
_KEYWORDS = "([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
_ASSIGN = _KEYWORDS + """["'']?\\x20*[:=]\\x20*["'']?([A-Za-z0-9+/_.=-]+)"""
_SECRETS_SQL = f"""
WITH RECURSIVE texts AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
found AS (
  SELECT r, text, 0 AS kind, regexp_extract_all(text, '{_ASSIGN}') AS m, regexp_extract_all(text, '{_ASSIGN}', 2) AS g,
    8 AS least FROM texts
  UNION ALL SELECT r, text, 1, regexp_extract_all(text, 'AKIA[A-Z0-9]+'), regexp_extract_all(text, 'AKIA[A-Z0-9]+'), 16 FROM texts
  UNION ALL SELECT r, text, 2, regexp_extract_all(text, '[0-9a-f]+'), regexp_extract_all(text, '[0-9a-f]+'), 32 FROM texts),
bearing AS (SELECT * FROM found WHERE len(list_filter(g, lambda x: length(x) >= least)) > 0),
walk AS (
  SELECT r, kind, m, g, least, 0 AS k, CAST(0 AS BIGINT) AS start, CAST(0 AS BIGINT) AS stop, text AS rest FROM bearing
  UNION ALL
  SELECT r, kind, m, g, least, k + 1, stop + strpos(rest, m[k + 1]) - 1, stop + strpos(rest, m[k + 1]) - 1 + length(m[k + 1]),
    substr(rest, strpos(rest, m[k + 1]) + length(m[k + 1]))
  FROM walk WHERE k < len(m)),
spans AS (SELECT r, kind, start, stop FROM walk WHERE k > 0 AND length(g[k]) >= least),
digest AS (
  SELECT r, count(*) FILTER (kind = 0) AS n0, count(*) FILTER (kind = 1) AS n1, count(*) FILTER (kind = 2) AS n2,
    string_agg((['assign', 'access', 'hex'])[kind + 1] || ':' || start || ':' || stop, ',' ORDER BY start, kind) AS line
  FROM spans GROUP BY r)
SELECT doc_id, coalesce(n0, 0) AS n_assign, coalesce(n1, 0) AS n_access, coalesce(n2, 0) AS n_hex,
  sha256(coalesce(line, '')) AS base_sha256, coalesce(line, '') AS spans
FROM texts LEFT JOIN digest USING (r)
"""


@query("op2_secret_scan", _SECRETS_SQL)
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secret_spans(table(spark, sf_dir, "documents"))
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE_KINDS))
    return found.select("doc_id", *[_count(k).alias(f"n_{k}") for k in BASE_KINDS], F.sha2(_joined(base), 256).alias("base_sha256"), _joined("spans").alias("spans"))


@query("op3_quality")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit_quality(docs, labels, crc_bucket(F.col("doc_id"), 4) != 2)
    held = F.coalesce(crc_bucket(F.col("doc_id"), 4) == 2, F.lit(False))
    return score_quality(docs, model).select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= QUALITY_CUT).cast("int").alias("predicted"))


@query("op4_mix_sources")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix_sources(table(spark, sf_dir, "documents")).select(
        "doc_id", "size", "source_size", "target", "taken", "copies")


@query("op5_simhash")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


_CONTAMINATION_SQL = """
WITH d AS (
  SELECT row_number() OVER () AS r, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM documents),
b AS (
  SELECT CAST(item_id AS VARCHAR) AS item,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w
  FROM benchmark),
windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS n, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS line
  FROM (SELECT item, w, unnest(generate_series(1, greatest(1, len(w) - 9))) AS i FROM b WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT r, n, i, array_to_string(w[i:i + n - 1], ' ') AS line
  FROM (SELECT r, w, n, unnest(generate_series(1, len(w) - n + 1)) AS i FROM d, lengths WHERE len(w) >= n)),
met AS (SELECT r, i, p.n, item FROM places p JOIN windows USING (line) WHERE p.n = windows.n),
hit AS (SELECT r, count(DISTINCT k) AS n_hit FROM (SELECT r, unnest(generate_series(i, i + n - 1)) AS k FROM met) GROUP BY r),
items AS (
  SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS line
  FROM (SELECT DISTINCT r, item FROM met WHERE item IS NOT NULL) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
  sha256(coalesce(line, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
"""


@query("op6_decontaminate", _CONTAMINATION_SQL)
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = F.aggregate("hits", F.lit(0).cast("long"), lambda n, h: n + h["last"] - h["first"] + 1)
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("hits") > 0).alias("contaminated"))


@query("op7_toxicity")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    model = fit_toxicity(docs, labels, crc_bucket(F.col("doc_id"), 5) != 0)
    held = F.coalesce(crc_bucket(F.col("doc_id"), 5) == 0, F.lit(False))
    return score_toxicity(docs, model).select(
        "doc_id", held.alias("held_out"), "score", (F.col("score") >= TOXIC_CUT).cast("int").alias("predicted"))


@query("op8_main_text")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_pages(table(spark, sf_dir, "pages"))


# Cosines are added up over components in double precision; a pair closer to the threshold than
# their rounding could go either way.
_VECTORS_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS e FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
u AS (SELECT vec_id, label, e, sqrt(list_dot_product(e, e)) AS n FROM v),
links AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id
  WHERE list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.93),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
found AS (SELECT a, min(b) AS least FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM links GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, least(vec_id, coalesce(found.least, vec_id)) AS component_id,
  vec_id <= coalesce(found.least, vec_id) AS kept
FROM embeddings LEFT JOIN counts ON vec_id = counts.a LEFT JOIN found ON vec_id = found.a
"""


@query("op9_near_vectors", _VECTORS_SQL)
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))


#: Tools that the calls of the query below name; arguments are whole texts.
TOOLS = {
    "lookup": {"type": "object", "required": ["query", "limit"], "additionalProperties": False, "properties": {
        "query": {"type": "string", "minLength": 1}, "limit": {"type": "integer", "minimum": 1, "maximum": 30},
        "after": {"type": "string"}}},
    "search": {"type": "object", "required": ["query"], "properties": {
        "query": {"type": "string", "maxLength": 1000}, "limit": {"type": "integer"}, "after": {"type": "string"}}},
}


def _assistant_calls(talk: DataFrame) -> DataFrame:
    name = F.element_at(F.array(F.lit("lookup"), F.lit("search"), F.lit("recall")), (F.length("text") % 3 + 1).cast("int"))
    step = F.when(F.col("conv_id") % 7 == 0, 2).otherwise(-2)
    ref = F.concat(F.lit("c"), "conv_id", F.lit("-"), F.col("turn") + step)
    arguments = F.to_json(F.struct(F.col("text").alias("query"), (F.length("text") % 40).alias("limit"),
                                   F.struct(ref.alias("$ref")).alias("after")))
    return talk.where("role = 'assistant'").select(
        F.col("conv_id").alias("conv"), "turn", F.concat(F.lit("c"), "conv_id", F.lit("-"), "turn").alias("call_id"),
        name.alias("name"), arguments.alias("arguments"))


_CALLS_SQL = """
WITH RECURSIVE calls AS (
  SELECT conv_id, turn, 'c' || conv_id || '-' || turn AS call_id, length(text) % 3 AS tool, length(text) % 40 AS lim,
    text AS q, CASE WHEN conv_id % 7 = 0 THEN turn + 2 ELSE turn - 2 END AS ref
  FROM conversations WHERE role = 'assistant'),
results AS (
  SELECT conv_id, turn, text, CASE WHEN role = 'user' AND turn > 0 THEN 'c' || conv_id || '-' || (turn - 1)
    ELSE coalesce(role, 'none') || conv_id || '-' || turn END AS call_id
  FROM conversations WHERE role IS DISTINCT FROM 'assistant'),
chain AS (
  SELECT conv_id, turn, 0 AS level FROM calls c
  WHERE NOT EXISTS (FROM calls d WHERE d.conv_id = c.conv_id AND d.turn = c.ref)
  UNION ALL
  SELECT c.conv_id, c.turn, level + 1 FROM chain JOIN calls c ON c.conv_id = chain.conv_id AND c.ref = chain.turn),
placed AS (
  SELECT calls.*, coalesce(level, 0) AS level,
    row_number() OVER (PARTITION BY conv_id ORDER BY coalesce(level, 0), turn) AS position
  FROM calls LEFT JOIN chain USING (conv_id, turn)),
joined AS (
  SELECT coalesce(p.conv_id, r.conv_id) AS conv_id, coalesce(p.call_id, r.call_id) AS call_id, coalesce(p.turn, r.turn) AS turn,
    position, level, p.call_id IS NOT NULL AS called, r.call_id IS NOT NULL AS answered, tool, lim, q, ref, r.text AS result,
    CASE WHEN p.call_id IS NULL THEN 'no_call' WHEN r.call_id IS NULL THEN 'no_result' ELSE 'linked' END AS status
  FROM placed p FULL JOIN results r ON p.call_id = r.call_id AND p.conv_id = r.conv_id),
checked AS (
  SELECT *, CASE WHEN NOT called THEN '' WHEN tool = 2 THEN '$: unknown tool'
    WHEN tool = 1 THEN CASE WHEN length(q) > 1000 THEN '$.query: too long' ELSE '' END
    ELSE concat_ws('; ', CASE WHEN lim < 1 THEN '$.limit: below minimum' WHEN lim > 30 THEN '$.limit: above maximum' END,
      CASE WHEN length(q) < 1 THEN '$.query: too short' END) END AS errors
  FROM joined)
SELECT conv_id, call_id, turn, position, level, status, called AND errors = '' AS valid, errors,
  CAST(called AS BIGINT) AS n_calls, CAST(answered AS BIGINT) AS n_results,
  '{"arguments":' || CASE WHEN called THEN '{"after":{"$ref":"c' || conv_id || '-' || ref || '"},"limit":' || lim
      || ',"query":' || CAST(to_json(q) AS VARCHAR) || '}' ELSE 'null' END
    || ',"id":"' || call_id || '","name":' || CASE WHEN called THEN '"' || (['lookup', 'search', 'recall'])[tool + 1] || '"' ELSE 'null' END
    || ',"result":' || coalesce(CAST(to_json(result) AS VARCHAR), 'null') || ',"status":"' || status || '"}' AS json
FROM checked
"""


def conversation_turns(talk: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Tool calls and results that carry every turn of plain conversations, each with its whole text.

    An assistant's turn is a call whose tool and arguments come from its text and which refers to the
    assistant's turn before it, or, in every seventh conversation, after it; the user's next turn is its
    result.  Turns that answer no call (a system's, an opening user's, any other role's) are results
    under their role's name.
    """
    answers = F.coalesce((F.col("role") == "user") & (F.col("turn") > 0), F.lit(False))
    ident = F.when(answers, F.concat(F.lit("c"), "conv_id", F.lit("-"), F.col("turn") - 1)).otherwise(
        F.concat(F.coalesce("role", F.lit("none")), "conv_id", F.lit("-"), "turn"))
    results = talk.where("not role <=> 'assistant'").select(
        F.col("conv_id").alias("conv"), "turn", ident.alias("call_id"), F.col("text").alias("content"))
    return _assistant_calls(talk), results


@query("op10_tool_calls", _CALLS_SQL)
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls, results = conversation_turns(table(spark, sf_dir, "conversations"))
    return link_tool_calls(calls, results, TOOLS).withColumnRenamed("conv", "conv_id")


# crc32 over the code points' UTF-8 bytes, its table built from the polynomial.  Near words share a
# word with one letter masked or left out.
_SPELLING_SQL = """
WITH RECURSIVE crc AS (
  SELECT list(v ORDER BY i) AS crc_table FROM (
    SELECT i, list_reduce([CAST(i AS BIGINT)] || range(8),
      lambda c, b: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v FROM range(256) t(i))),
runs AS (
  SELECT doc_id, run, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[A-Za-zÀ-ÿ]+')) AS run FROM documents)
  WHERE length(run) >= 6 GROUP BY ALL),
hashed AS (
  SELECT run, n, xor(4294967295, list_reduce([CAST(4294967295 AS BIGINT)] || list_transform(
      range(CAST(octet_length(encode(ident)) AS BIGINT)), lambda i: CAST('0x' || substr(hex(ident), 2 * i + 1, 2) AS BIGINT)),
    lambda c, b: xor(c >> 8, crc_table[CAST(xor(c & 255, b) AS BIGINT) + 1]))) AS h
  FROM (SELECT *, coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run AS ident FROM runs), crc),
vocabulary AS (
  SELECT word, CAST(sum(n) AS BIGINT) AS n FROM (
    SELECT n, CASE WHEN h % 199 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word
    FROM hashed)
  WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
places AS (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM vocabulary),
masked AS (SELECT word, n, i, substr(word, 1, i - 1) || '*' || substr(word, i + 1) AS m FROM places),
shorter AS (SELECT DISTINCT word, n, substr(word, 1, i - 1) || substr(word, i + 1) AS m FROM places),
near AS (
  SELECT a.word, b.word AS other, b.n AS other_n FROM masked a JOIN masked b ON a.m = b.m AND a.word <> b.word
  UNION ALL SELECT s.word, v.word, v.n FROM shorter s JOIN vocabulary v ON s.m = v.word
  UNION ALL SELECT v.word, s.word, s.n FROM shorter s JOIN vocabulary v ON s.m = v.word),
best AS (
  SELECT word, count(*) AS n_near, max(other_n) AS most FROM near GROUP BY word),
forms AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN most >= 5 * v.n THEN most END AS form_n,
    CASE WHEN most >= 5 * v.n THEN (SELECT min(other) FROM near x WHERE x.word = v.word AND x.other_n = best.most) END AS form
  FROM vocabulary v LEFT JOIN best USING (word)),
led AS (
  SELECT word, word AS root, 0 AS steps FROM forms
  UNION ALL SELECT led.word, forms.form, steps + 1 FROM led JOIN forms ON forms.word = led.root WHERE forms.form IS NOT NULL)
SELECT forms.word, form, root, n, n_near, form_n
FROM forms JOIN (SELECT word, arg_max(root, steps) AS root FROM led GROUP BY word) USING (word)
"""


@query("op11_spelling", _SPELLING_SQL)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling_groups(table(spark, sf_dir, "documents"))


# Plays every order on every document: a document goes at the first step whose filter it fails.
_AUDIT_SQL = r"""
WITH RECURSIVE docs AS (
  SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS body,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[ \t-\r]+'), lambda w: w <> '') AS words FROM documents),
facts AS (
  SELECT part,
    CASE WHEN len(words) < 200 THEN 'A' ELSE '' END
    || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
    || CASE WHEN 100 * len(regexp_replace(body, '[^A-Z]', '', 'g')) > 2 * length(body) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(body, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN doc_id > min(doc_id) OVER (PARTITION BY body) THEN 'E' ELSE '' END AS fails,
    coalesce((SELECT max(quality) FROM labels l WHERE l.doc_id = docs.doc_id) = 1, false) AS good,
    coalesce((SELECT max(toxic) FROM labels l WHERE l.doc_id = docs.doc_id) = 1, false) AS bad
  FROM docs),
kinds AS (SELECT part, fails, good, bad, count(*) AS n FROM facts GROUP BY ALL),
orders AS (
  SELECT '' AS filter_order
  UNION ALL SELECT filter_order || f FROM orders, (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f) WHERE NOT contains(filter_order, f)),
steps AS (
  SELECT filter_order, step, substr(filter_order, CAST(step AS BIGINT), 1) AS f
  FROM orders, (SELECT unnest(range(1, 6)) AS step) WHERE length(filter_order) = 5),
gone AS (
  SELECT kinds.*, filter_order, (SELECT min(strpos(filter_order, l)) FROM (SELECT unnest(string_split(fails, '')) AS l) WHERE l <> '') AS goes
  FROM kinds, orders WHERE length(filter_order) = 5),
played AS (
  SELECT part, filter_order, step, f,
    coalesce(sum(n) FILTER (goes IS NULL OR goes > step), 0) AS kept,
    coalesce(sum(n) FILTER (goes = step), 0) AS removed,
    coalesce(sum(n) FILTER (contains(fails, f) AND goes < step), 0) AS redundant,
    coalesce(sum(n) FILTER (fails = f), 0) AS unique_fails,
    coalesce(sum(n) FILTER (goes = step AND good), 0) AS good_lost,
    coalesce(sum(n) FILTER (goes = step AND bad), 0) AS toxic_lost
  FROM gone JOIN steps USING (filter_order) GROUP BY part, filter_order, step, f)
SELECT part, filter_order, CAST(step AS INTEGER) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, f) AS BIGINT) AS shapley
FROM played
"""


@query("op12_filter_audit", _AUDIT_SQL)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_filters(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op13_lm_score")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_texts(table(spark, sf_dir, "documents"), crc_bucket(F.col("doc_id"), 5) != 1)
