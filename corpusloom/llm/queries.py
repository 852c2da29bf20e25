"""Thin queries that apply the operators to the driver tables, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.llm import chat_format, decontaminate, exact_topk, language_id, line_dedup, minhash_dedup, packing, secret_scan, sentencepiece_codec, source_divergence, spelling, token_files, toxicity


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash_dedup.link(_read(spark, sf_dir, "documents"), k=4)


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = sentencepiece_codec.encode(_read(spark, sf_dir, "documents"), tokenizer_path("piece_bpe_32k.model"), dropout=0.1, seed=1)
    return encoded.select("row.doc_id", "ids", "n_tokens", "ids_crc32", "lossless")


def op3_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat_format.format_messages(_read(spark, sf_dir, "conversations"))


def tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages with tool calls, made of the conversations: every turn that is a multiple of 3 becomes two messages, a call of
    two tools and one whose argument has an exponent, and a later turn (for some conversations an earlier one) the result of the first.
    """
    turn, conv = F.col("turn"), F.col("conv_id")
    rows = _read(spark, sf_dir, "conversations").select("conv_id", "turn", F.char_length("text").alias("n"))
    call = lambda name, place: F.concat(F.lit(f'{{"id":"{name}'), turn.cast("string"), F.lit('","arguments":{"n":'), F.coalesce(F.col("n").cast("string"), F.lit("null")), F.lit(f'}},"name":"{place}"}}'))
    made = F.concat(F.lit('{"tool_calls": ['), call("a", "count"), F.lit(", "), call("b", "other"), F.lit("]}"))
    # the result of turn t names the call of turn t - 1, or of t + 1 in conversations of even number
    of = F.when(conv % 2 == 0, turn + 1).otherwise(turn - 1)
    result = F.concat(F.lit('\n{"content":[1,"x"],"tool_call_id":"a'), of.cast("string"), F.lit('"}'))
    is_call = turn % 3 == 0
    powers = F.concat(F.lit('{"tool_calls": [{"id":"w'), turn.cast("string"), F.lit('","arguments":{"n":'), F.coalesce(F.concat(F.col("n").cast("string"), F.lit(".50E1")), F.lit("null")), F.lit('},"name":"count"}]}'))
    text = F.when(is_call, F.array(made, powers)).otherwise(F.array(result))
    return rows.select("conv_id", "turn", F.when(is_call, "assistant").otherwise("tool").alias("role"), F.explode(text).alias("text"))


#: What the made calls may hold: the length of a text of at least 40 characters.
TOOLS = {"count": {"type": "object", "properties": {"n": {"type": "number", "minimum": 40, "exclusiveMaximum": 10**17}}, "required": ["n"], "additionalProperties": False}}


def tool_call_linking(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chat formatting of conversations with tool calls."""
    return chat_format.format_messages(tool_calls(spark, sf_dir), TOOLS)


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.identify(_read(spark, sf_dir, "documents"))


def op5_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_files.round_trip(_read(spark, sf_dir, "documents"), tokenizer_path("byte_bpe_50k.json"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.report(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "benchmark"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.scan_documents(_read(spark, sf_dir, "documents"))


def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.classify(_read(spark, sf_dir, "documents"), _read(spark, sf_dir, "labels"))


def op9_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.report(_read(spark, sf_dir, "documents"), min_words=1)


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_topk.search(_read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


def op11_source_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return source_divergence.audit(_read(spark, sf_dir, "documents"))


def op12_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(_read(spark, sf_dir, "documents"), tokenizer_path("word_bpe_49k.json"))
    return pieces.select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.group_variants(_read(spark, sf_dir, "documents"))


#: Canonical messages of conversations without tool calls; the tables hold none.
OP3_SQL = """
SELECT conv_id, turn, turn AS seq_turn, CAST(0 AS INTEGER) AS seq_after, role,
       CAST(0 AS BIGINT) AS n_calls, CAST(0 AS BIGINT) AS n_linked, CAST(0 AS BIGINT) AS n_invalid,
       '{"content":' || coalesce(CAST(to_json(text) AS VARCHAR), 'null') || ',"role":' || coalesce(CAST(to_json(role) AS VARCHAR), 'null') || '}' AS message
FROM conversations
"""

#: Calls of turns 0, 3, 6 and on; a result's call is the neighbour turn if that is one of them and there.
TOOL_SQL = """
WITH rows AS (SELECT conv_id, turn, length(text) AS n, turn % 3 = 0 AS is_call, CASE WHEN conv_id % 2 = 0 THEN turn + 1 ELSE turn - 1 END AS other FROM conversations),
calls AS (SELECT conv_id, turn, min(n) AS n FROM rows WHERE is_call GROUP BY ALL),
wanted AS (SELECT DISTINCT conv_id, other FROM rows WHERE NOT is_call),
made AS (
    SELECT r.conv_id, r.turn, r.turn AS seq_turn, 0 AS seq_after, 'assistant' AS role, 2 AS n_calls,
           CASE WHEN w.other IS NULL THEN 0 ELSE 1 END AS n_linked, CASE WHEN r.n >= 40 THEN 1 ELSE 2 END AS n_invalid,
           '{"content":null,"role":"assistant","tool_calls":[{"arguments":{"n":' || coalesce(CAST(r.n AS VARCHAR), 'null') || '}' ||
           CASE WHEN r.n >= 40 THEN '' WHEN r.n IS NULL THEN ',"error":"type of n"' ELSE ',"error":"value of n"' END || ',"id":"a' || r.turn ||
           '","name":"count"},{"arguments":{"n":' || coalesce(CAST(r.n AS VARCHAR), 'null') || '},"error":"unknown tool","id":"b' || r.turn || '","name":"other"}]}' AS message
    FROM rows r LEFT JOIN wanted w ON w.conv_id = r.conv_id AND w.other = r.turn WHERE r.is_call),
powers AS (
    SELECT conv_id, turn, turn AS seq_turn, 0 AS seq_after, 'assistant' AS role, 1 AS n_calls, 0 AS n_linked, CASE WHEN n >= 4 THEN 0 ELSE 1 END AS n_invalid,
           '{"content":null,"role":"assistant","tool_calls":[{"arguments":{"n":' || coalesce(CAST(10 * n + 5 AS VARCHAR), 'null') || '}' ||
           CASE WHEN n >= 4 THEN '' WHEN n IS NULL THEN ',"error":"type of n"' ELSE ',"error":"value of n"' END || ',"id":"w' || turn || '","name":"count"}]}' AS message
    FROM rows WHERE is_call),
results AS (
    SELECT r.conv_id, r.turn, CASE WHEN c.turn >= r.turn THEN c.turn ELSE r.turn END AS seq_turn, CASE WHEN c.turn >= r.turn THEN 1 ELSE 0 END AS seq_after, 'tool' AS role, 0 AS n_calls,
           CASE WHEN c.turn IS NULL THEN 0 ELSE 1 END AS n_linked, 0 AS n_invalid,
           '{"content":[1,"x"],"role":"tool","tool_call_id":"a' || r.other || '"}' AS message
    FROM rows r LEFT JOIN calls c ON c.conv_id = r.conv_id AND c.turn = r.other WHERE NOT r.is_call)
SELECT conv_id, turn, seq_turn, CAST(seq_after AS INTEGER) AS seq_after, role, CAST(n_calls AS BIGINT) AS n_calls, CAST(n_linked AS BIGINT) AS n_linked, CAST(n_invalid AS BIGINT) AS n_invalid, message
FROM (SELECT * FROM made UNION ALL SELECT * FROM powers UNION ALL SELECT * FROM results)
"""

#: Exact similarities by an inverted index, components by spreading the smallest id.
OP1_SQL = r"""
WITH RECURSIVE words AS (
    SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
sets AS (
    SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
        ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) END AS s FROM words),
each AS (SELECT doc_id, len(s) AS n, unnest(s) AS x FROM sets),
shared AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c, any_value(a.n) AS na, any_value(b.n) AS nb
    FROM each a JOIN each b ON a.x = b.x AND a.doc_id < b.doc_id AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n GROUP BY ALL),
links AS (SELECT a, b FROM shared WHERE 100 * c >= 80 * (na + nb - c)),
ends AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach(a, b) AS (SELECT a, b FROM ends UNION SELECT r.a, e.b FROM reach r JOIN ends e ON r.b = e.a),
least AS (SELECT a AS doc_id, min(b) AS m FROM reach GROUP BY a)
SELECT doc_id, CAST(len(s) AS BIGINT) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id, doc_id = least(doc_id, coalesce(m, doc_id)) AS kept
FROM sets LEFT JOIN least USING (doc_id)
"""

OP7_SQL = r"""
WITH rules AS (SELECT * FROM (VALUES ('assign', 0, 12), ('access', 1, 18), ('hex', 2, 16)) r(rule, ord, least)),
found AS (
    SELECT doc_id, rule, ord, least,
        CASE rule WHEN 'assign' THEN regexp_extract_all(t, '(?s)(.*?)(([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+))', 1)
                  WHEN 'access' THEN regexp_extract_all(t, '(?s)(.*?)(AKIA[A-Z0-9]+)', 1) ELSE regexp_extract_all(t, '(?s)(.*?)([0-9a-f]+)', 1) END AS gaps,
        CASE rule WHEN 'assign' THEN regexp_extract_all(t, '(?s)(.*?)(([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+))', 2)
                  WHEN 'access' THEN regexp_extract_all(t, '(?s)(.*?)(AKIA[A-Z0-9]+)', 2) ELSE regexp_extract_all(t, '(?s)(.*?)([0-9a-f]+)', 2) END AS hits,
        CASE rule WHEN 'assign' THEN regexp_extract_all(t, '(?s)(.*?)(([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+))', 4)
                  WHEN 'access' THEN regexp_extract_all(t, '(?s)(.*?)(AKIA[A-Z0-9]+)', 2) ELSE regexp_extract_all(t, '(?s)(.*?)([0-9a-f]+)', 2) END AS vals
    FROM (SELECT doc_id, coalesce(text, '') AS t FROM documents), rules),
each AS (
    SELECT doc_id, rule, ord, least, unnest(gaps) AS gap, unnest(hits) AS hit, unnest(vals) AS val, generate_subscripts(gaps, 1) AS i FROM found),
placed AS (
    SELECT doc_id, rule, ord, sum(length(gap) + length(hit)) OVER (PARTITION BY doc_id, rule ORDER BY i) AS stop, length(hit) AS n, length(val) >= least AS kept FROM each),
spans AS (
    SELECT doc_id, rule, ord, CAST(stop - n AS BIGINT) AS start, rule || ':' || CAST(CAST(stop - n AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(stop AS BIGINT) AS VARCHAR) AS span FROM placed WHERE kept),
digest AS (
    SELECT doc_id, count(*) FILTER (rule = 'assign') AS n_assign, count(*) FILTER (rule = 'access') AS n_access, count(*) FILTER (rule = 'hex') AS n_hex,
           string_agg(span, ',' ORDER BY start, ord) AS spans FROM spans GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(spans, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM documents d LEFT JOIN digest USING (doc_id)
"""

#: Words in order of frequency, candidates by a common prefix word, exact Jaccard.
OP9_SQL = r"""
WITH lines AS (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) - 1 AS line_no FROM documents WHERE text IS NOT NULL),
sets AS (
    SELECT doc_id, line_no, list_distinct(list_filter(string_split(lower(line), ' '), lambda x: x <> '')) AS s FROM lines),
big AS (SELECT doc_id, line_no, s, len(s) AS n FROM sets WHERE len(s) >= 1),
classes AS (
    SELECT min({'d': doc_id, 'l': line_no}) AS first, any_value(list_sort(s)) AS s, any_value(n) AS n FROM big GROUP BY list_sort(s)),
words AS (SELECT first, n, unnest(s) AS w FROM classes),
df AS (SELECT w, count(*) AS c FROM words GROUP BY w),
placed AS (SELECT first, n, w, row_number() OVER (PARTITION BY first ORDER BY c, w) AS p FROM words JOIN df USING (w)),
prefix AS (SELECT first, n, w FROM placed WHERE 100 * (n - p + 1) >= 80 * n),
candidates AS (
    SELECT DISTINCT b.first AS later, a.first AS earlier FROM prefix a JOIN prefix b ON a.w = b.w AND a.first < b.first AND 100 * a.n >= 80 * b.n AND 100 * b.n >= 80 * a.n),
near AS (
    SELECT DISTINCT later FROM candidates JOIN classes x ON x.first = later JOIN classes y ON y.first = earlier
    WHERE 100 * len(list_intersect(x.s, y.s)) >= 80 * (x.n + y.n - len(list_intersect(x.s, y.s)))),
gone AS (
    SELECT b.doc_id, b.line_no FROM big b JOIN classes c ON list_sort(b.s) = c.s
    WHERE {'d': b.doc_id, 'l': b.line_no} <> c.first OR c.first IN (SELECT later FROM near)),
marked AS (SELECT l.doc_id, l.line_no, g.doc_id IS NOT NULL AS removed FROM lines l LEFT JOIN gone g ON l.doc_id = g.doc_id AND l.line_no = g.line_no),
docs AS (
    SELECT doc_id, count(*) AS n_lines, count(*) FILTER (removed) AS n_removed, coalesce(string_agg(CAST(line_no AS VARCHAR), ',' ORDER BY line_no) FILTER (removed), '') AS removed
    FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(removed, '') AS removed FROM documents d LEFT JOIN docs USING (doc_id)
"""

OP10_SQL = """
WITH q AS (
    SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
pairs AS (
    SELECT a.r, a.vec_id AS query_id, b.vec_id, CAST(coalesce(list_sum(list_transform(list_zip(a.v, b.v), lambda z: z[1] * z[2])), 0) AS BIGINT) AS score
    FROM q a JOIN q b ON a.vec_id % 100 = 0 AND a.r <> b.r AND len(a.v) = len(b.v))
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score
FROM (SELECT *, row_number() OVER (PARTITION BY r ORDER BY score DESC, vec_id) AS rank FROM pairs) WHERE rank <= 10
"""

#: Every group has a row for every kept term of its language.
OP11_SQL = r"""
WITH docs AS (
    SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
each AS (SELECT r, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, CAST(count(*) AS HUGEINT) AS n FROM each GROUP BY ALL HAVING count(DISTINCT r) >= 10),
counts AS (SELECT lang, source, term, CAST(count(*) AS HUGEINT) AS n FROM each GROUP BY ALL),
langs AS (SELECT lang, term, 1 + 1000000000 * (n + 2) // (sum(n) OVER l + 2 * count(*) OVER l) AS q FROM kept WINDOW l AS (PARTITION BY lang)),
dense AS (
    SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n
    FROM (SELECT DISTINCT lang, source FROM docs) g JOIN kept k ON k.lang = g.lang LEFT JOIN counts c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
shares AS (SELECT lang, source, term, n, 1 + 1000000000 * (n + 2) // (sum(n) OVER g + 2 * count(*) OVER g) AS p FROM dense WINDOW g AS (PARTITION BY lang, source)),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p)) AS value FROM shares a JOIN shares b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (
    SELECT a.lang, a.source, b.source AS item FROM (SELECT DISTINCT lang, source FROM docs) a JOIN (SELECT DISTINCT lang, source FROM docs) b ON a.lang = b.lang AND a.source <> b.source),
found AS (
    SELECT lang, source, 'pair' AS part, item, coalesce(value, 0) AS value FROM pairs LEFT JOIN sums USING (lang, source, item)
    UNION ALL SELECT s.lang, s.source, 'term', s.term, (p - q) * (p - q) // (p + q) FROM shares s JOIN langs l ON l.lang = s.lang AND l.term = s.term WHERE s.n > 0 AND p > q)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM found QUALIFY part = 'pair' OR rank <= 10
"""

#: The checksum byte by byte; near words by deleting each character once.
OP13_SQL = r"""
WITH RECURSIVE crc AS (
    SELECT list_transform(range(256), lambda i: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, i)) AS t),
runs AS (
    SELECT r, doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run
    FROM (SELECT row_number() OVER () AS r, * FROM documents)),
counted AS (SELECT doc_id, run, count(*) AS n FROM runs WHERE length(run) >= 6 GROUP BY ALL),
hashed AS (
    SELECT run, n, xor(list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)), '..'), lambda x: CAST('0x' || x AS BIGINT)),
        lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295) AS h
    FROM counted, crc),
altered AS (SELECT CASE WHEN h % 199 = 0 THEN left(run, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word, n FROM hashed),
words AS (SELECT word, CAST(sum(n) AS BIGINT) AS n FROM altered WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5),
without AS (SELECT word, n, i, left(word, i) || substr(word, i + 2) AS key FROM (SELECT word, n, unnest(range(length(word))) AS i FROM words)),
near AS (
    SELECT a.word, a.n, b.word AS other, b.n AS m FROM without a JOIN words b ON b.word = a.key
    UNION SELECT b.word, b.n, a.word, a.n FROM without a JOIN words b ON b.word = a.key
    UNION SELECT a.word, a.n, b.word, b.n FROM without a JOIN without b ON a.key = b.key AND a.i = b.i AND a.word <> b.word),
best AS (SELECT word, count(*) OVER (PARTITION BY word) AS n_near, other, m, m >= 5 * n AS commoner FROM near QUALIFY row_number() OVER (PARTITION BY word ORDER BY m DESC, other) = 1),
named AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN commoner THEN other END AS form, CASE WHEN commoner THEN m END AS form_n FROM words LEFT JOIN best USING (word)),
path(word, place, form) AS (SELECT word, word, form FROM named UNION ALL SELECT p.word, p.form, n.form FROM path p JOIN named n ON n.word = p.form)
SELECT n.word, n.form, p.place AS root, n.n, n.n_near, n.form_n FROM named n JOIN path p ON p.word = n.word AND p.form IS NULL
"""


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_minhash_near_dedup": op1_minhash_near_dedup,
        "op2_sentencepiece": op2_sentencepiece,
        "op3_chat_formatting": op3_chat_formatting,
        "tool_call_linking": tool_call_linking,
        "op4_language_id": op4_language_id,
        "op5_token_files": op5_token_files,
        "op6_decontamination": op6_decontamination,
        "op7_secret_scan": op7_secret_scan,
        "op8_toxicity": op8_toxicity,
        "op9_line_dedup": op9_line_dedup,
        "op10_exact_topk": op10_exact_topk,
        "op11_source_divergence": op11_source_divergence,
        "op12_packing": op12_packing,
        "op13_spelling_variants": op13_spelling_variants,
    }


def oracle_sql() -> dict[str, str]:
    return {"op1_minhash_near_dedup": OP1_SQL, "op3_chat_formatting": OP3_SQL, "tool_call_linking": TOOL_SQL, "op7_secret_scan": OP7_SQL, "op9_line_dedup": OP9_SQL, "op10_exact_topk": OP10_SQL, "op11_source_divergence": OP11_SQL, "op13_spelling_variants": OP13_SQL}
