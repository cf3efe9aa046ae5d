"""One query per operator, over the whole given tables, and SQL answers where SQL can give them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assayer.llm import language_id, toxicity
from assayer.llm.conversation_repair import repaired_conversations
from assayer.llm.decontaminate import contaminated
from assayer.llm.license_scan import scan_licenses
from assayer.llm.frames import staged
from assayer.llm.line_dedup import remove_boilerplate
from assayer.llm.near_dedup import NearDedup, near_duplicates
from assayer.llm.periodic_runs import periodic, periodic_runs, strongest
from assayer.llm.quality_classifier import score, train
from assayer.llm.quality_rules import quality_rules
from assayer.llm.repeats import repeated_passages
from assayer.llm.sentence_pieces import encode
from assayer.llm.token_counts import TokenRollup, count_tokens, deletes, inserts, revisions
from assayer.sources.workspace import new_folder

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ANSWERS: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def _documents(spark: SparkSession, folder: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/documents.parquet")


@query
def op9_quality_rules(spark: SparkSession, folder: str) -> DataFrame:
    return quality_rules(_documents(spark, folder)).drop("text_key")


_WORD = r"[^\x20\x09-\x0D]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Base counts and verdict; also the first stage of the pipeline.
QUALITY_SQL = rf"""
SELECT b.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, lost_words, base_failed,
       NOT base_failed AND 100 * lost_words <= 50 * n_words AS kept
FROM (
  SELECT t.doc_id, len(t.ws)::BIGINT AS n_words,
         coalesce(list_sum(list_transform(t.ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
         length(regexp_replace(t.txt, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(l.n_dup, 0)::BIGINT AS n_dup_lines,
         coalesce(r.n, 0)::BIGINT AS n_repeat_words,
         coalesce(f.lost, 0)::BIGINT AS lost_words,
         len(t.ws) < 20 OR 100 * coalesce(r.n, 0) > 30 * len(t.ws) AS base_failed
  FROM (SELECT doc_id, coalesce(text, '') AS txt, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS ws FROM documents) t
  LEFT JOIN (
    SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup
    FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM documents)
    WHERE regexp_matches(line, '{_WORD}') GROUP BY doc_id
  ) l ON l.doc_id = t.doc_id
  LEFT JOIN (
    SELECT doc_id, count(*) AS n FROM (
      SELECT doc_id, bool_or(hit) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS covered
      FROM (
        SELECT doc_id, p, len(g) = 8 AND count(*) OVER (PARTITION BY doc_id, g) > 1 AS hit
        FROM (
          SELECT doc_id, p, list(w) OVER (PARTITION BY doc_id ORDER BY p ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING) AS g
          FROM (
            SELECT doc_id, unnest(ws) AS w, generate_subscripts(ws, 1) AS p
            FROM (SELECT doc_id, regexp_extract_all(text, '{_WORD}') AS ws FROM documents WHERE text IS NOT NULL)
          )
        )
      )
    ) WHERE covered GROUP BY doc_id
  ) r ON r.doc_id = t.doc_id
  LEFT JOIN (
    SELECT a.doc_id, sum(a.n) AS lost
    FROM (
      SELECT doc_id, source, array_to_string(ws, ' ') AS line, len(ws) AS n
      FROM (SELECT doc_id, source, regexp_extract_all({_LOWER.format("line")}, '{_WORD}') AS ws
            FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM documents))
    ) a
    JOIN (
      SELECT source, line, min(doc_id) AS first_document
      FROM (
        SELECT doc_id, source, array_to_string(ws, ' ') AS line
        FROM (SELECT doc_id, source, regexp_extract_all({_LOWER.format("line")}, '{_WORD}') AS ws
              FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line FROM documents))
        WHERE len(ws) > 0
      ) GROUP BY source, line HAVING count(DISTINCT doc_id) > 10
    ) b ON a.line = b.line AND a.source IS NOT DISTINCT FROM b.source AND a.doc_id <> b.first_document
    GROUP BY a.doc_id
  ) f ON f.doc_id = t.doc_id
) b
"""
ANSWERS["op9_quality_rules"] = QUALITY_SQL


@query
def op6_minhash_near_dedup(spark: SparkSession, folder: str) -> DataFrame:
    found = near_duplicates(_documents(spark, folder), NearDedup(shingle=3, similarity_pct=85))
    return found.drop("text_key")


NEAR_SQL = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_WORD}') AS ws FROM documents
), s AS (
  SELECT doc_id, CASE
    WHEN len(ws) >= 3 THEN list_distinct(list_transform(range(1, len(ws) - 1), lambda i: array_to_string(ws[i:i + 2], ' ')))
    WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS shingles
  FROM w
), u AS (
  SELECT doc_id, len(shingles) AS n, unnest(shingles) AS shingle FROM s
), link AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id
  GROUP BY 1, 2 HAVING 100 * count(*) >= 85 * (any_value(a.n) + any_value(b.n) - count(*))
), reach AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
), least AS (
  SELECT a, min(b) AS component_id FROM reach GROUP BY a
)
SELECT s.doc_id, len(shingles)::BIGINT AS n_shingles, component_id, s.doc_id = component_id AS kept
FROM s JOIN least ON s.doc_id = least.a
"""
ANSWERS["op6_minhash_near_dedup"] = NEAR_SQL


@query
def op7_benchmark_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    found = contaminated(_documents(spark, folder), spark.read.parquet(f"{folder}/benchmark.parquet"))
    return found.drop("text_key")


@query
def op3_sentencepiece(spark: SparkSession, folder: str) -> DataFrame:
    encoded = encode(_documents(spark, folder))
    return encoded.select("doc_id", F.size("ids").cast("long").alias("n_ids"), "ids", "exact")


def _held_out() -> Column:
    """Without an id a document is not held out."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 3 == 1, F.lit(False))


@query
def op4_quality_classifier(spark: SparkSession, folder: str) -> DataFrame:
    docs = _documents(spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet").filter(~_held_out())
    weights = train(docs, labels.select("doc_id", F.col("quality").alias("label")))
    return score(docs, weights).select("doc_id", _held_out().alias("held_out"), "score", "predicted")


@query
def op2_language_id(spark: SparkSession, folder: str) -> DataFrame:
    docs = _documents(spark, folder)
    model = language_id.train(docs.filter(~_held_out()))
    return language_id.predict(docs, model).select("doc_id", _held_out().alias("held_out"), "lang_pred", "score")


@query
def op5_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    left = remove_boilerplate(_documents(spark, folder), removed="n_removed")
    return left.select("doc_id", "n_removed", F.length("text").cast("long").alias("n_left"), F.md5("text").alias("digest"))


#: Texts without boilerplate, for a table `kept` of documents.
LINES_SQL = r"""
  each_line AS (
    SELECT doc_id, source, line, pos, trim(lower(regexp_replace(line, '[\t\x0B\f\r ]+', ' ', 'g')), ' ') AS norm
    FROM (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line,
                 generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM kept)
  ), spread AS (
    SELECT norm, min(doc_id) AS first FROM each_line WHERE norm <> '' GROUP BY norm HAVING count(DISTINCT source) >= 10
  ), rest AS (
    SELECT doc_id, count(*) FILTER (WHERE lost) AS n_removed,
           coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT lost), '') AS left_text
    FROM (SELECT l.*, s.first IS NOT NULL AND s.first <> doc_id AS lost FROM each_line l LEFT JOIN spread s USING (norm))
    GROUP BY doc_id
  ), unlined AS (
    SELECT k.* REPLACE (coalesce(left_text, text) AS text), coalesce(n_removed, 0) AS n_removed
    FROM kept k LEFT JOIN rest USING (doc_id)
  )
"""
ANSWERS["op5_line_dedup"] = f"""
WITH kept AS (SELECT * FROM documents), {LINES_SQL}
SELECT doc_id, n_removed::BIGINT AS n_removed, length(text)::BIGINT AS n_left, md5(text) AS digest FROM unlined
"""


@query
def op10_suffix_array_repeats(spark: SparkSession, folder: str) -> DataFrame:
    return repeated_passages(_documents(spark, folder)).drop("text_key")


@query
def op8_license_scan(spark: SparkSession, folder: str) -> DataFrame:
    found = scan_licenses(_documents(spark, folder))
    return found.select("doc_id", "licence", "first_sentence", "last_sentence", F.concat_ws(", ", "sentences").alias("sentences"))


@query
def op1_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """All documents are loaded with an estimate, revised to exact counts (sent twice); toxic ones are deleted and loaded again.

    The totals cover all documents.
    """
    docs = _documents(spark, folder)
    toxic = spark.read.parquet(f"{folder}/labels.parquet").filter("toxic = 1").select("doc_id")
    counts = staged(count_tokens(docs).withColumn("estimate", F.ceil(F.col("n_chars") / 4)), "tokens")
    rollup = TokenRollup(spark, new_folder(spark, "llm-rollup"))
    rollup.commit("load", inserts(counts.withColumn("n_tokens", F.col("estimate"))))
    for _ in range(2):
        rollup.commit("exact counts", revisions(counts, "estimate"))
    rollup.compact()
    taken = counts.join(toxic, "doc_id", "left_semi")
    rollup.commit("take down", deletes(taken))
    rollup.commit("put back", inserts(taken))
    return rollup.totals()


@query
def op11_conversation_repair(spark: SparkSession, folder: str) -> DataFrame:
    return repaired_conversations(spark.read.parquet(f"{folder}/conversations.parquet"))


#: The CRC-32 of a string of ASCII characters, bit by bit (reversed polynomial 0xEDB88320).
_CRC = """
  xor(4294967295::UBIGINT, list_reduce(list_transform(string_split({}, ''), lambda ch: ord(ch)::UBIGINT), lambda c, b:
    list_reduce([0,0,0,0,0,0,0,0]::UBIGINT[], lambda x, zero:
      xor(x >> 1, CASE WHEN x & 1 = 1 THEN 3988292384 ELSE 0 END)::UBIGINT, xor(c, b)), 4294967295::UBIGINT))
"""


def _candidates(state: int, due: int, kept: str) -> str:
    """The least (cost, letters, lines) of keeping, changing or removing row i, in front of the best rest."""
    role = "user" if due == 2 else "assistant"
    return f"""list_min([
      {{'c': v[{state + 1}].c + 4, 'a': 'D' || v[{state + 1}].a, 'o': v[{state + 1}].o}},
      {{'c': v[{due + 1}].c + 3 + extra, 'a': 'R' || v[{due + 1}].a, 'o': list_prepend('{role}:' || text, v[{due + 1}].o)}},
      {kept}
    ])"""


def _kept(state: int, to: str) -> str:
    return f"{{'c': v[{to}].c + keep, 'a': 'K' || v[{to}].a, 'o': list_prepend(role || ':' || text, v[{to}].o)}}"


def _inserted(state: int, rest: str) -> str:
    due = (2, 2, 3, 2)[state]
    role = "user" if due == 2 else "assistant"
    at = f"{rest}[{due + 1}]"
    return f"list_min([p[{state + 1}], {{'c': {at}.c + 3, 'a': 'I' || {at}.a, 'o': list_prepend('{role}:', {at}.o)}}])"


def _repair_sql() -> str:
    never = "{'c': 1000000000000, 'a': '', 'o': []::VARCHAR[]}"
    targets = {
        0: "CASE initial WHEN 's' THEN 2 WHEN 'u' THEN 3 END",
        1: "CASE initial WHEN 'u' THEN 3 END",
        2: "CASE initial WHEN 'a' THEN 4 END",
        3: "CASE initial WHEN 'u' THEN 3 END",
    }
    kept = {s: f"CASE WHEN ({t}) IS NULL THEN {never} ELSE {_kept(s, f'coalesce({t}, 1)')} END" for s, t in targets.items()}
    plain = ", ".join(_candidates(s, (2, 2, 3, 2)[s], kept[s]) for s in range(4))
    once = ", ".join(_inserted(s, "p") for s in range(4))
    twice = ", ".join(_inserted(s, "q") for s in range(4))
    return rf"""
WITH RECURSIVE given AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
         ({_CRC.format("coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ')")}) % 20 AS part
  FROM conversations
), rows_left AS (
  SELECT conv_id, turn, CASE WHEN part = 4 THEN 'user' ELSE role END AS role,
         CASE part WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM (SELECT *, unnest(CASE WHEN part = 3 THEN [0, 1] ELSE [0] END) AS copy FROM given WHERE part <> 0)
), placed AS (
  SELECT *, left(role, 1) AS initial, regexp_extract_all(text, '[^ 	-
]') AS solid,
         row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, left(text, 32), md5(text)) AS i
  FROM rows_left
), told AS (
  SELECT *, len(solid) = 0 AS blank,
         len(solid) > 0 AND row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS duplicate,
         lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS pair
  FROM placed
), faults AS (
  SELECT *, NOT blank AND NOT duplicate AND solid[-1] NOT IN ('.', '!', '?') AS truncated FROM told
), edges AS (
  SELECT conv_id, i, initial, role, text,
         CASE WHEN blank OR duplicate THEN 1000000 WHEN truncated THEN 3 ELSE 0 END AS extra,
         CASE WHEN blank OR duplicate THEN 1000000 WHEN truncated THEN 3 ELSE 0 END AS keep
  FROM faults
), best AS (
  SELECT conv_id, count(*) + 1 AS i, [
    {{'c': 0, 'a': '', 'o': []::VARCHAR[]}}, {{'c': 6, 'a': 'II', 'o': ['user:', 'assistant:']}},
    {{'c': 3, 'a': 'I', 'o': ['assistant:']}}, {{'c': 0, 'a': '', 'o': []::VARCHAR[]}}] AS v
  FROM edges GROUP BY conv_id
  UNION ALL
  SELECT conv_id, i, [{twice}] AS v FROM (
    SELECT conv_id, i, p, [{once}] AS q FROM (
      SELECT e.conv_id, e.i, [{plain}] AS p FROM best b JOIN edges e ON b.conv_id IS NOT DISTINCT FROM e.conv_id AND b.i = e.i + 1
    )
  )
), counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count_if(blank) AS blank,
         count_if(duplicate) AS duplicate, count_if(truncated) AS truncated,
         count_if(pair NOT IN ('su', 'ua', 'au')) AS illegal
  FROM faults GROUP BY conv_id
)
SELECT g.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(v[1].c, 0)::BIGINT AS cost,
       coalesce(v[1].a, '') AS audit, sha256(coalesce(array_to_string(v[1].o, chr(10)), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) g
LEFT JOIN counted c ON g.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN (SELECT * FROM best WHERE i = 1) b ON g.conv_id IS NOT DISTINCT FROM b.conv_id
"""


ANSWERS["op11_conversation_repair"] = _repair_sql()


@query
def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    docs = _documents(spark, folder).withColumn("text", periodic(F.col("text"), F.col("doc_id")))
    found = periodic_runs(docs).withColumn("best", strongest(F.col("runs")))
    best = F.col("best")
    listed = F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n")))
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        *(best[c].alias(c) for c in ("start", "length", "period")),
        F.floor(1000 * best["length"] / best["period"]).cast("long").alias("exponent_milli"),
        F.sha2(F.array_join(listed, ""), 256).alias("runs_sha256"),
        F.sha2("collapsed", 256).alias("collapsed_sha256"),
    )


@query
def op12_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    docs = _documents(spark, folder)
    labels = spark.read.parquet(f"{folder}/labels.parquet").filter(~held_out)
    model = toxicity.train(docs, labels.select("doc_id", F.col("toxic").alias("label")))
    return toxicity.score(docs, model).select("doc_id", held_out.alias("held_out"), "score", "predicted")
