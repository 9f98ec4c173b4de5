"""The registered queries of the corpus operators: ``opN_<name>(spark, sf_dir)``."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigilspark.llm import lang_id, quality
from vigilspark.llm.bpe_codec import bpe_round_trip, encode_decode_digest
from vigilspark.llm.common import crc_remainder
from vigilspark.llm.conversations import damaged, repair_conversations
from vigilspark.llm.decontam import contamination
from vigilspark.llm.line_dedup import line_dedup
from vigilspark.llm.lm import interpolated_scores
from vigilspark.llm.pii import pseudonymise
from vigilspark.llm.repeats import without_repeats
from vigilspark.llm.runs import damage_cycle, run_digests, word_runs
from vigilspark.llm.simhash import simhash_components
from vigilspark.llm.token_counts import token_counts
from vigilspark.llm.vectors import near_duplicate_vectors

CONTEXT_TOKENS = 1024
LM_ORDER = 3
PREDICT_AT = 0.7
REPEAT_BYTES = 50
#: A key for the registered query; production passes its own secret.
SURROGATE_KEY = b"example key of the registered query"


def tokenizer_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    counts = token_counts(table(spark, sf_dir, "documents"), tokenizer_path())
    return counts.withColumn("over_limit", F.col("n_tokens") > CONTEXT_TOKENS)


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup(table(spark, sf_dir, "documents"))
    return cleaned.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def op4_pii_surrogates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pseudonymise(table(spark, sf_dir, "documents"), SURROGATE_KEY)


def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_remainder("doc_id", 3) == 1, F.lit(False))
    model = lang_id.fit(docs.where(~held_out))
    return lang_id.predict(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")


def op6_vector_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicate_vectors(table(spark, sf_dir, "embeddings"))


def op7_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode_digest(bpe_round_trip(table(spark, sf_dir, "documents"), tokenizer_path()))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash_components(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def op9_lm_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_remainder("doc_id", 7) == 2, F.lit(False))
    scored = interpolated_scores(docs, ~held_out, order=LM_ORDER)
    return scored.select(
        "doc_id", held_out.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score"
    )


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    held_out = F.coalesce(crc_remainder("doc_id", 4) == 2, F.lit(False))
    # a label that is repeated teaches once, labels that contradict each other teach both; other columns are not read
    labels = table(spark, sf_dir, "labels").select("doc_id", "quality").distinct()
    rows = docs.select("doc_id", "text").where(~held_out).join(labels, "doc_id")
    weights = quality.fit(rows)
    scored = quality.score(docs, weights)
    return scored.select(
        "doc_id", held_out.alias("held_out"), "score", (F.col("score") >= PREDICT_AT).cast("int").alias("predicted")
    )


def op11_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, live = damaged(table(spark, sf_dir, "conversations"))
    return repair_conversations(rows, live=live)


def op12_periodic_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return run_digests(word_runs(table(spark, sf_dir, "documents"), cycle=damage_cycle))


def op13_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = without_repeats(table(spark, sf_dir, "documents"), width=REPEAT_BYTES)
    return cleaned.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


QUERIES = {
    "op1_decontamination": op1_decontamination,
    "op2_token_counts": op2_token_counts,
    "op3_line_dedup": op3_line_dedup,
    "op4_pii_surrogates": op4_pii_surrogates,
    "op5_language_id": op5_language_id,
    "op6_vector_near_dups": op6_vector_near_dups,
    "op7_bpe_round_trip": op7_bpe_round_trip,
    "op8_simhash": op8_simhash,
    "op9_lm_scores": op9_lm_scores,
    "op10_quality": op10_quality,
    "op11_conversation_repair": op11_conversation_repair,
    "op12_periodic_runs": op12_periodic_runs,
    "op13_repeats": op13_repeats,
}



def _crc_sql(text: str) -> str:
    """crc32 of an ASCII text, bit by bit."""
    bits = "list_reduce([xor(c, x), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)"
    return f"xor(list_reduce(list_prepend(4294967295, list_transform(string_split({text}, ''), lambda y: CAST(unicode(y) AS BIGINT))), lambda c, x: {bits}), 4294967295)"


def _state_sql(old: str, cost: str, letter: str, line: str = "") -> str:
    """A (cost, audit, text) struct one edit further."""
    return f"{{'c': {old}.c + {cost}, 'a': {old}.a || '{letter}', 't': {old}.t{line and ' || ' + line}}}"


_FAR_SQL = "{'c': 1000000000, 'a': '~', 't': ''}"
_LINE_SQL, _USER_SQL, _ASSISTANT_SQL = "chr(10) || role || ':' || text", "chr(10) || 'user:'", "chr(10) || 'assistant:'"

ORACLE = {
    "op11_conversation_repair": f"""
WITH RECURSIVE b AS (SELECT conv_id, coalesce(CAST(conv_id AS VARCHAR), ' ') AS conv, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text FROM conversations),
k AS (SELECT *, {_crc_sql("(conv || ':' || coalesce(CAST(turn AS VARCHAR), ' '))")} % 20 AS kind FROM b),
d AS (SELECT conv_id, conv, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
  unnest(CASE WHEN kind = 3 THEN [1, 2] ELSE [1] END) AS copy FROM k WHERE kind <> 0),
n AS (SELECT *, row_number() OVER (PARTITION BY conv ORDER BY turn NULLS FIRST, role, text) AS n FROM d),
f AS (SELECT *, substr(role, 1, 1) AS ini, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'blank' WHEN row_number() OVER (PARTITION BY conv, role, text ORDER BY n) > 1 THEN 'duplicate'
  WHEN regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) NOT IN ('.', '!', '?') THEN 'truncated' END AS fault, lag(substr(role, 1, 1)) OVER (PARTITION BY conv ORDER BY n) AS prior FROM n),
dp(conv, k, s0, s1, s2, s3) AS (
  SELECT DISTINCT conv, CAST(0 AS BIGINT), {{'c': 0, 'a': '', 't': ''}}, {_FAR_SQL}, {{'c': 3, 'a': 'I', 't': {_USER_SQL}}}, {{'c': 6, 'a': 'II', 't': {_USER_SQL} || {_ASSISTANT_SQL}}} FROM b
  UNION ALL
  SELECT conv, k, n0, n1, c2, list_min([n3, {_state_sql("c2", "3", "I", _ASSISTANT_SQL)}]) FROM (
    SELECT *, list_min([n2, {_state_sql("n0", "3", "I", _USER_SQL)}, {_state_sql("n1", "3", "I", _USER_SQL)}, {_state_sql("n3", "3", "I", _USER_SQL)}]) AS c2 FROM (
      SELECT conv, n AS k, {_state_sql("s0", "4", "D")} AS n0,
        list_min([{_state_sql("s1", "4", "D")}, CASE WHEN free AND ini = 's' THEN {_state_sql("s0", "e", "K", _LINE_SQL)} ELSE {_FAR_SQL} END]) AS n1,
        list_min([{_state_sql("s2", "4", "D")}, CASE WHEN NOT free THEN {_FAR_SQL} WHEN ini = 'u' THEN {_state_sql("p", "e", "K", _LINE_SQL)} ELSE {_state_sql("p", "e + 3", "R", _USER_SQL + " || text")} END]) AS n2,
        list_min([{_state_sql("s3", "4", "D")}, CASE WHEN NOT free THEN {_FAR_SQL} WHEN ini = 'a' THEN {_state_sql("s2", "e", "K", _LINE_SQL)} ELSE {_state_sql("s2", "e + 3", "R", _ASSISTANT_SQL + " || text")} END]) AS n3
      FROM (SELECT dp.*, f.n, role, text, ini, fault IS NULL OR fault = 'truncated' AS free, CASE WHEN fault = 'truncated' THEN 3 ELSE 0 END AS e, list_min([s0, s1, s3]) AS p
        FROM dp JOIN f ON f.conv = dp.conv AND f.n = dp.k + 1)))),
best AS (SELECT conv, list_min([s0, s3]) AS z FROM dp QUALIFY row_number() OVER (PARTITION BY conv ORDER BY k DESC) = 1),
counts AS (SELECT conv, CAST(coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS BIGINT) AS gaps, count(*) FILTER (WHERE fault = 'blank') AS blank, count(*) FILTER (WHERE fault = 'duplicate') AS duplicate,
  count(*) FILTER (WHERE fault = 'truncated') AS truncated, count(*) FILTER (WHERE prior IS NOT NULL AND prior || ini NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY 1)
SELECT o.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal,
  CAST(z.c AS BIGINT) AS cost, z.a AS audit, sha256(substr(z.t, 2)) AS repaired_sha256
FROM (SELECT DISTINCT conv_id, conv FROM b) o JOIN best USING (conv) LEFT JOIN counts USING (conv)
""",
    "op12_periodic_runs": f"""
WITH t AS (SELECT doc_id, {_crc_sql("CAST(doc_id AS VARCHAR)")} AS h, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
a AS (SELECT *, h % 10 = 0 AND len(w) > 0 AS hurt, (h // 10) % greatest(len(w), 1) AS a, (h // 10) % 8 AS g FROM t),
p AS (SELECT *, 1 + (len(w) - a) // (3 + g) AS p FROM a),
words AS (SELECT doc_id, len(w) AS n, i, w[1 + CASE WHEN hurt AND i >= a THEN a + (i - a) % p ELSE i END] AS word FROM (SELECT *, unnest(range(len(w))) AS i FROM p)),
same AS (SELECT x.doc_id, x.i, y.i - x.i AS q FROM words x JOIN words y ON x.doc_id = y.doc_id AND x.word = y.word AND y.i > x.i AND y.i - x.i <= x.n // 4),
island AS (SELECT doc_id, q, i, i - row_number() OVER (PARTITION BY doc_id, q ORDER BY i) AS g FROM same),
found AS (SELECT doc_id, min(i) AS s, count(*) + q AS l, q FROM island GROUP BY doc_id, q, g HAVING count(*) + q >= greatest(6, 4 * q)),
runs AS (SELECT doc_id, s, l, min(q) AS q FROM found GROUP BY doc_id, s, l),
gone AS (SELECT DISTINCT doc_id, unnest(range(s + q, s + l)) AS i FROM runs),
kept AS (SELECT w.doc_id, string_agg(word, ' ' ORDER BY w.i) AS text FROM words w ANTI JOIN gone g ON g.doc_id = w.doc_id AND g.i = w.i GROUP BY 1),
listed AS (SELECT doc_id, count(*) AS n_runs, string_agg(s || ',' || l || ',' || q || chr(10), '' ORDER BY s, q) AS runs FROM runs GROUP BY 1),
longest AS (SELECT * FROM runs QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY l DESC, s, q) = 1)
SELECT t.doc_id, coalesce(n_runs, 0) AS n_runs, s AS start, l AS length, q AS period, 1000 * l // q AS exponent_milli,
  sha256(coalesce(runs, '')) AS runs_sha256, sha256(coalesce(kept.text, '')) AS collapsed_sha256
FROM t LEFT JOIN listed USING (doc_id) LEFT JOIN longest USING (doc_id) LEFT JOIN kept USING (doc_id)
""",
    "op6_vector_near_dups": """
WITH RECURSIVE usable AS (
  SELECT vec_id, label, v, sqrt(list_sum(list_transform(v, lambda x: x * x))) AS norm
  FROM (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)
  WHERE label IS NOT NULL AND v IS NOT NULL AND len(v) > 0 AND len(v) = len(list_filter(v, lambda x: x IS NOT NULL AND isfinite(x)))
), pairs AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM usable a JOIN usable b ON a.label = b.label AND len(a.v) = len(b.v) AND a.vec_id <> b.vec_id
  WHERE a.norm > 0 AND b.norm > 0 AND list_dot_product(a.v, b.v) / (a.norm * b.norm) >= 0.98
), reach(node, other) AS (
  SELECT vec_id, vec_id FROM embeddings UNION SELECT r.node, p.b FROM reach r JOIN pairs p ON p.a = r.other
), components AS (SELECT node, min(other) AS component_id FROM reach GROUP BY node),
links AS (SELECT a AS node, count(*) AS n FROM pairs GROUP BY a)
SELECT e.vec_id, coalesce(l.n, 0) AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN components c ON c.node = e.vec_id LEFT JOIN links l ON l.node = e.vec_id
""",
    "op13_repeats": """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
s AS (SELECT doc_id, i, b[i + 1:i + 50] AS string FROM (SELECT doc_id, b, unnest(range(octet_length(b) - 49)) AS i FROM d)),
f AS (SELECT string, min(doc_id) AS low FROM s GROUP BY 1 HAVING min(doc_id) < max(doc_id)),
hit AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS p FROM (SELECT DISTINCT doc_id, i FROM s JOIN f USING (string) WHERE low < doc_id)),
run AS (SELECT doc_id, i, sum(CASE WHEN p IS NULL OR i > p + 50 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS r FROM hit),
span AS (SELECT doc_id, min(i) AS a, max(i) + 50 AS z FROM run GROUP BY doc_id, r),
gap AS (SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS x, a AS y FROM span UNION ALL SELECT d.doc_id, coalesce(max(z), 0), octet_length(any_value(b)) FROM d LEFT JOIN span USING (doc_id) GROUP BY 1),
kept AS (SELECT doc_id, string_agg(CASE WHEN y > x THEN hex(b[x + 1:y]) ELSE '' END, '' ORDER BY x) AS h FROM gap JOIN d USING (doc_id) GROUP BY 1),
sums AS (SELECT doc_id, sum(z - a) AS n_removed, count(*) AS n_spans FROM span GROUP BY 1)
SELECT d.doc_id, CAST(octet_length(b) AS BIGINT) AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(n_spans, 0) AS BIGINT) AS n_spans, sha256(unhex(h)) AS kept_sha256
FROM d JOIN kept USING (doc_id) LEFT JOIN sums USING (doc_id)
""",
    "op3_line_dedup": """
WITH rows AS (
  SELECT doc_id, coalesce(text, '') AS text FROM documents
), lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line,
         generate_subscripts(string_split(text, chr(10)), 1) AS pos
  FROM rows
), keyed AS (
  SELECT doc_id, pos, line,
         translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines
), wide AS (
  SELECT key, min(doc_id) AS keeper FROM keyed WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), marked AS (
  SELECT k.doc_id, k.pos, k.line, (w.key IS NOT NULL AND k.doc_id <> w.keeper) AS gone
  FROM keyed k LEFT JOIN wide w ON k.key = w.key
)
SELECT doc_id, CAST(count(*) AS BIGINT) AS n_lines,
       CAST(count(*) FILTER (WHERE gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id
""",
}
