"""The registered queries of the operators, each over its whole table, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plenum.llm import exact_dedup, filter_audit, html_text, language, language_model, mixing, ngram_join, packing, quality, repair, sharding, toxicity, url_filter
from plenum.plans.tables import Tables
from plenum.session import split_skewed_joins

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

TOKENIZER = "word_bpe_49k.json"
SHARDS = 8


def query(name: str, sql: str | None = None):
    def register(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            split_skewed_joins(spark)
            return fn(Tables(spark, sf_dir))

        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return fn

    return register


@query("op1_ngram_jaccard_join")
def op1_ngram_jaccard_join(t):
    return ngram_join.near_duplicates(t("documents", "doc_id", "text"))


@query("op2_packing")
def op2_packing(t):
    packed = packing.pack(t("documents", "doc_id", "text"), tokenizer_path())
    return packed.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


def tokenizer_path() -> str:
    """The vocabulary file, as every machine of the cluster has it."""
    return public_tokenizers.path(TOKENIZER)


@query("op3_toxicity")
def op3_toxicity(t):
    return toxicity.score(t("documents", "doc_id", "text"), t("labels", "doc_id", "toxic"))


@query("op4_quality_rules")
def op4_quality_rules(t):
    return quality.judge(t("documents", "doc_id", "text"), t("labels", "doc_id", "quality")).drop("anomaly")


@query("op5_lm_scoring")
def op5_lm_scoring(t):
    return language_model.score(t("documents", "doc_id", "text"))


@query("op6_language_id")
def op6_language_id(t):
    return language.identify(t("documents", "doc_id", "text", "lang"))


@query("op7_sharding")
def op7_sharding(t):
    shards = sharding.kd_shards(t("documents", "doc_id", "text"), SHARDS)
    return shards.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


@query("op8_html_extraction")
def op8_html_extraction(t):
    found = html_text.main_text(t("pages", "page_id", "url", "html"))
    return found.withColumn("n_chars", F.char_length("text").cast("bigint"))


MIX_SQL = """
WITH sized AS (
  SELECT doc_id, source, md5(coalesce(CAST(doc_id AS VARCHAR), ''))[1:15] AS h,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents),
totals AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source),
weighed AS (SELECT *, CAST(source_size AS DOUBLE) * 3.0 AS cap,
    [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INT) + 1] AS w
  FROM totals),
levels AS (SELECT *, ((sum(source_size) OVER ())::DOUBLE - coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0.0))
    / sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lv FROM weighed),
plan AS (SELECT source, source_size, CASE WHEN cap <= lv * w THEN cap
    ELSE least(cap, (max(lv) FILTER (cap > lv * w) OVER ()) * w) END AS target FROM levels),
placed AS (SELECT s.doc_id, s.size, p.source_size, p.target,
    CASE WHEN p.source_size > 0 THEN CAST(floor(p.target / p.source_size) AS BIGINT) ELSE 0 END AS passes,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.h, s.doc_id NULLS LAST, s.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, size, source_size, target, CAST(size * (passes + CASE WHEN size > 0
    AND before * 2 + size <= (target - passes * source_size) * 2 THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM placed
"""


@query("op9_mixing", MIX_SQL)
def op9_mixing(t):
    mixed = mixing.mixed(t("documents", "doc_id", "text", "source"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken")


DEDUP_SQL = """
WITH n AS (SELECT doc_id, regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]+', ' ', 'g') AS body FROM documents),
g AS (SELECT body, min(doc_id) AS keep_id, count(*) AS group_size FROM n GROUP BY body)
SELECT doc_id, keep_id, group_size, doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(n.body) AS text_sha256
FROM n JOIN g ON n.body = g.body
"""


@query("op10_exact_dedup", DEDUP_SQL)
def op10_exact_dedup(t):
    return exact_dedup.exact_duplicates(t("documents", "doc_id", "text"))


# Fixed values.
URL_RULES = [
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
]


@query("op11_url_filters")
def op11_url_filters(t):
    return url_filter.verdicts(t("pages", "page_id", "url", "html"), URL_RULES)


REPAIR_SQL = """
WITH RECURSIVE drawn AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(
        coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda c: ord(c)::BIGINT)),
      lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0],
        lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END)), 4294967295) % 20 AS code
  FROM conversations),
damaged AS (SELECT conv_id, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role,
    CASE WHEN code = 1 THEN '' WHEN code = 2 THEN translate(text, '.!?', '') ELSE text END AS text,
    unnest(CASE WHEN code = 0 THEN [] WHEN code = 3 THEN [1, 2] ELSE [1] END) AS copy FROM drawn),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(text), copy) AS pos FROM damaged),
seen AS (SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS is_blank,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS is_copy,
    NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') AS is_cut,
    left(lag(role) OVER (PARTITION BY conv_id ORDER BY pos), 1) || left(role, 1) AS pair FROM placed),
flagged AS (SELECT *, coalesce(conv_id, -1) AS conv, is_blank OR is_copy AS must, is_cut AND NOT is_blank AND NOT is_copy AS cut,
    CASE left(role, 1) WHEN 's' THEN 1 WHEN 'u' THEN 2 WHEN 'a' THEN 3 ELSE 0 END AS initial FROM seen),
moves(state, ins, inserted, via) AS (VALUES (0, '', [], 0), (0, 'I', ['user:'], 2), (0, 'II', ['user:', 'assistant:'], 3),
  (1, '', [], 1), (1, 'I', ['user:'], 2), (1, 'II', ['user:', 'assistant:'], 3),
  (2, '', [], 2), (2, 'I', ['assistant:'], 3), (2, 'II', ['assistant:', 'user:'], 2),
  (3, '', [], 3), (3, 'I', ['user:'], 2), (3, 'II', ['user:', 'assistant:'], 3)),
acts AS (SELECT *, unnest(['D', 'K', 'R']) AS act, CASE WHEN via = 2 THEN 3 ELSE 2 END AS following FROM moves),
sizes AS (SELECT conv, max(pos) AS rows FROM flagged GROUP BY conv),
paths AS (
  SELECT conv, 0::BIGINT AS pos, 0 AS state, {'cost': 0, 'audit': '', 'lines': CAST([] AS VARCHAR[])} AS best FROM sizes
  UNION ALL
  SELECT conv, pos, state, min(best) FROM (
    SELECT p.conv, p.pos + 1 AS pos, CASE act WHEN 'D' THEN via WHEN 'K' THEN initial ELSE following END AS state,
      {'cost': best.cost + 2 * length(ins) + CASE act WHEN 'D' THEN 3 WHEN 'R' THEN 2 ELSE 0 END
         + CASE WHEN act <> 'D' AND cut THEN 1 ELSE 0 END,
       'audit': best.audit || ins || act,
       'lines': best.lines || CAST(inserted AS VARCHAR[]) || CASE act WHEN 'D' THEN CAST([] AS VARCHAR[]) WHEN 'K' THEN [role || ':' || text]
         ELSE [CASE following WHEN 2 THEN 'user:' ELSE 'assistant:' END || text] END} AS best
    FROM paths p JOIN flagged f ON f.conv = p.conv AND f.pos = p.pos + 1 JOIN acts a ON a.state = p.state
    WHERE act = 'D' OR (NOT must AND (act = 'R' OR initial = following OR (initial = 1 AND via = 0))))
  GROUP BY conv, pos, state),
ended AS (SELECT p.conv, min({'cost': best.cost + CASE state WHEN 1 THEN 4 WHEN 2 THEN 2 ELSE 0 END,
    'audit': best.audit || CASE state WHEN 1 THEN 'II' WHEN 2 THEN 'I' ELSE '' END,
    'lines': best.lines || CASE state WHEN 1 THEN ['user:', 'assistant:'] WHEN 2 THEN ['assistant:'] ELSE CAST([] AS VARCHAR[]) END}) AS best
  FROM paths p JOIN sizes s ON p.conv = s.conv AND p.pos = s.rows GROUP BY p.conv),
counts AS (SELECT conv, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps,
    count(*) FILTER (is_blank) AS blank, count(*) FILTER (is_copy AND NOT is_blank) AS duplicate, count(*) FILTER (cut) AS truncated,
    count(*) FILTER (pos > 1 AND pair NOT IN ('su', 'ua', 'au')) AS illegal FROM flagged GROUP BY conv)
SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(coalesce(best.cost, 0) AS BIGINT) AS cost,
  coalesce(best.audit, '') AS audit, sha256(coalesce(array_to_string(best.lines, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, coalesce(conv_id, -1) AS conv FROM conversations) c
LEFT JOIN counts n ON c.conv = n.conv LEFT JOIN ended e ON c.conv = e.conv
"""


@query("op12_conversation_repair", REPAIR_SQL)
def op12_conversation_repair(t):
    return repair.repair(t("conversations", "conv_id", "turn", "role", "text"))


AUDIT_SQL = """
WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS body FROM documents),
w AS (SELECT *, regexp_extract_all(body, '[^\\x20\\x09-\\x0D]+') AS words, min(doc_id) OVER (PARTITION BY body) AS least FROM d),
marks AS (SELECT doc_id, max(CAST(coalesce(quality = 1, false) AS INT)) AS good, max(CAST(coalesce(toxic = 1, false) AS INT)) AS toxic
  FROM labels GROUP BY doc_id),
f AS (SELECT w.part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(words) < 200 THEN 'A' ELSE '' END
    || CASE WHEN 100 * len(list_distinct(words)) < 50 * len(words) THEN 'B' ELSE '' END
    || CASE WHEN 100 * length(regexp_replace(body, '[^A-Z]', '', 'g')) > 2 * length(body) THEN 'C' ELSE '' END
    || CASE WHEN regexp_matches(body, '[#$%&*|]') THEN 'D' ELSE '' END
    || CASE WHEN w.doc_id > least THEN 'E' ELSE '' END AS fails
  FROM w LEFT JOIN marks ON w.doc_id = marks.doc_id),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
letters AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS l),
orders AS (SELECT v.l || w.l || x.l || y.l || z.l AS o FROM letters v, letters w, letters x, letters y, letters z
  WHERE len(list_distinct([v.l, w.l, x.l, y.l, z.l])) = 5),
steps AS (SELECT o, s, o[s] AS l, o[1:s - 1] AS earlier FROM orders, (SELECT unnest([1, 2, 3, 4, 5]) AS s)),
met AS (SELECT part, o, s, l, fails, n, good, toxic, contains(fails, l) AS here,
    length(translate(fails, earlier, '')) < length(fails) AS gone FROM c, steps),
r AS (SELECT part, o, s, l, sum(CASE WHEN NOT here AND NOT gone THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN here AND NOT gone THEN n ELSE 0 END) AS removed, sum(CASE WHEN here AND gone THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN fails = l THEN n ELSE 0 END) AS unique_fails, sum(CASE WHEN here AND NOT gone THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN here AND NOT gone THEN toxic ELSE 0 END) AS toxic_lost FROM met GROUP BY part, o, s, l)
SELECT part, o AS filter_order, CAST(s AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed,
  CAST(redundant AS BIGINT) AS redundant, CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost,
  CAST(toxic_lost AS BIGINT) AS toxic_lost, CAST(sum(removed) OVER (PARTITION BY part, l) AS BIGINT) AS shapley FROM r
"""


@query("op13_filter_interaction_audit", AUDIT_SQL)
def op13_filter_interaction_audit(t):
    return filter_audit.audit(t("documents", "doc_id", "text", "source"), t("labels", "doc_id", "quality", "toxic"))
