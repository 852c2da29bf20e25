"""Queries of the library's operators over the driver tables, with their SQL.

The driver's corpus is Latin script, so sentences are split at ``.!?`` and line
ends and tokens are runs of letters.  The global corpus is all documents, the
personal one those labelled with quality 1; anchors are the 150 tokens of at most four
letters that most sentences have.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom.functions import keys as K
from corpusloom.functions import lexicon as L
from corpusloom.functions import rewriting, segmentation
from corpusloom.functions import text as T
from corpusloom.functions import tokenizers as TK
from corpusloom.functions.statistics import emerged, mastery
from corpusloom.operators import anchor_pairs as AP
from corpusloom.operators import anchors as A
from corpusloom.operators import corpus as C
from corpusloom.operators import patterns as P
from corpusloom.operators import similarity as M
from corpusloom.operators import statistics as S
from corpusloom.plans import inspect
from corpusloom.plans import reports as R
from corpusloom.sources import readers

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

TOP_K, MAX_LEN, CAP, SEED = 150, 4, 5, 7
#: No text of 2 GB has more; ids beyond 2^32 would overflow, which is an error, never a collision.
SENTENCES_PER_DOCUMENT = 1 << 31

# SQL of the shared relations.
_W = T.WHITE
_CTE = {
    "sent": r"sent AS (SELECT doc_id * 2147483648 + i - 1 AS sid, doc_id, trim(s) AS text FROM (SELECT doc_id, unnest(regexp_split_to_array(text, '[.!?\n]+')) AS s, generate_subscripts(regexp_split_to_array(text, '[.!?\n]+'), 1) AS i FROM documents) WHERE trim(s) <> '')",
    "toks": r"toks AS (SELECT sid, doc_id, regexp_extract_all(lower(text), '\p{L}+') AS ts FROM sent)",
    "tok": "tok AS (SELECT sid, doc_id, ts, unnest(ts) AS t, generate_subscripts(ts, 1) - 1 AS i FROM toks)",
    "anc": f"anc AS (SELECT t, c FROM (SELECT t, count(DISTINCT sid) AS c FROM tok WHERE length(t) <= {MAX_LEN} GROUP BY t) ORDER BY c DESC, t LIMIT {TOP_K})",
    "occ": "occ AS (SELECT sid, ts, t, i, row_number() OVER (PARTITION BY sid ORDER BY i) AS k, lead(t) OVER (PARTITION BY sid ORDER BY i) AS nt, lead(i) OVER (PARTITION BY sid ORDER BY i) AS ni, lag(i) OVER (PARTITION BY sid ORDER BY i) AS pi FROM tok WHERE t IN (SELECT t FROM anc))",
    "ptok": "ptok AS (SELECT * FROM tok WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1))",
}


def _with(*names: str, more: str = "") -> str:
    need = {"sent": ("sent",), "toks": ("sent", "toks"), "tok": ("sent", "toks", "tok"), "anc": ("sent", "toks", "tok", "anc"), "occ": ("sent", "toks", "tok", "anc", "occ"), "ptok": ("sent", "toks", "tok", "ptok")}
    wanted = {x for n in names for x in need[n]}
    parts = [_CTE[n] for n in _CTE if n in wanted]
    return "WITH " + ",\n".join(parts + ([more] if more else [])) + "\n"


def _query(sql: str | None):
    def register(f: Query) -> Query:
        _QUERIES[f.__name__] = f
        if sql is not None:
            _SQL[f.__name__] = sql
        return f

    return register


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def sentences(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``sid, doc_id, text`` of the documents' sentences."""
    texts = readers.spread(_read(spark, sf_dir, "documents").select("doc_id", "text"), "doc_id")
    split = texts.select("doc_id", F.posexplode(F.split("text", "[.!?\n]+")).alias("i", "s"))
    return split.select((F.col("doc_id") * SENTENCES_PER_DOCUMENT + F.col("i")).alias("sid"), "doc_id", F.trim("s").alias("text")).where("text <> ''")


def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``sid, doc_id, tokens``."""
    return sentences(spark, sf_dir).select("sid", "doc_id", TK.words(F.col("text")).alias("tokens"))


def personal_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    good = _read(spark, sf_dir, "labels").where("quality = 1").select("doc_id").distinct()
    return tokens(spark, sf_dir).join(good, "doc_id", "left_semi")


def anchor_tokens(spark: SparkSession, sf_dir: str) -> list[str]:
    return A.anchor_list(A.top_tokens(tokens(spark, sf_dir), TOP_K, "df", MAX_LEN))


def _anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return A.top_tokens(tokens(spark, sf_dir), TOP_K, "df", MAX_LEN).select("token")


def extracted(spark: SparkSession, sf_dir: str, *families: str, personal: bool = False, **options) -> DataFrame:
    rows = personal_tokens(spark, sf_dir) if personal else tokens(spark, sf_dir)
    return P.extract(rows, anchor_tokens(spark, sf_dir), families=families or P.DEFAULT_FAMILIES, **options)


def pair_counts(spark: SparkSession, sf_dir: str, personal: bool = False) -> DataFrame:
    """Occurrences and sentences of each anchor pair."""
    rows = personal_tokens(spark, sf_dir) if personal else tokens(spark, sf_dir)
    return AP.key_counts(rows, anchor_tokens(spark, sf_dir))


def _benchmark_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "benchmark").select(F.explode(TK.words(F.col("text"))).alias("token")).distinct()


_BENCH = r"bench AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\p{L}+')) AS token FROM benchmark)"


# Text.


@_query(f"SELECT doc_id, regexp_replace(regexp_replace(coalesce(text, ''), '{_W}+', ' ', 'g'), '^ | $', '', 'g') AS text FROM documents")
def norm_whitespace(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", T.normalize(F.col("text")).alias("text"))


_NEWS = f"regexp_replace(regexp_replace(regexp_replace(CAST(turn AS VARCHAR) || chr(9) || text, '^{_W}+|{_W}+$', '', 'g'), '^[^\\t]*\\t', ''), '{_W}+', '', 'g')"


@_query(f"""SELECT conv_id, turn, regexp_replace({_NEWS}, '[“”"''‘’]', '', 'g') AS value FROM conversations""")
def clean_news_line(spark, sf_dir):
    numbered = F.concat(F.col("turn").cast("string"), F.lit("\t"), F.col("text"))
    return _read(spark, sf_dir, "conversations").select("conv_id", "turn", T.clean_news(numbered).alias("value"))


_WIKI_IN = "'（x） (' || role || ') [' || CAST(turn AS VARCHAR) || '] ' || text"


@_query(f"""SELECT conv_id, turn, regexp_replace(regexp_replace(regexp_replace(regexp_replace({_WIKI_IN}, '{_W}+', '', 'g'), '[“”"''‘’]', '', 'g'), '（.*?）|\\(.*?\\)', '', 'g'), '\\[[0-9]+\\]', '', 'g') AS value FROM conversations""")
def clean_wiki_line(spark, sf_dir):
    marked = F.concat(F.lit("（x） ("), "role", F.lit(") ["), F.col("turn").cast("string"), F.lit("] "), "text")
    return _read(spark, sf_dir, "conversations").select("conv_id", "turn", T.clean_wiki(marked).alias("value"))


@_query(_with("sent") + "SELECT sid, text FROM sent WHERE length(text) BETWEEN 6 AND 60 AND NOT regexp_matches(text, '[A-Za-z0-9]{6,}')")
def length_noise_filter(spark, sf_dir):
    return sentences(spark, sf_dir).where(T.good_length(F.col("text"))).select("sid", "text")


_ZH = "replace(replace(replace(text, '.', '。'), '!', '！'), '?', '？')"


@_query(f"SELECT doc_id, count(*) AS n, CAST(sum(length(s)) AS BIGINT) AS chars, count(*) FILTER (s LIKE '%。') AS ended FROM (SELECT doc_id, unnest(regexp_extract_all({_ZH}, '[^。！？]*[。！？]|[^。！？]+')) AS s FROM documents) GROUP BY doc_id")
def split_sentences(spark, sf_dir):
    text = F.replace(F.replace(F.replace("text", F.lit("."), F.lit("。")), F.lit("!"), F.lit("！")), F.lit("?"), F.lit("？"))
    each = _read(spark, sf_dir, "documents").select("doc_id", F.explode(T.split_sentences(text)).alias("s")).where("s <> ''")
    return each.groupBy("doc_id").agg(F.count("*").alias("n"), F.sum(F.char_length("s")).alias("chars"), F.count_if(F.col("s").endswith("。")).alias("ended"))


_SEEN = f"regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '\\[sound:[^\\]]+\\]', '', 'g'), '{T.UNSEEN}', ' ', 'g'), '<[^>]*>', ' ', 'g')"
_NAMES, _CHARACTERS = ("[" + ", ".join("'" + x.replace("'", "''") + "'" for x in xs) + "]" for xs in (T.ENTITIES.keys(), T.ENTITIES.values()))
_DIGITS, _NAME = f"regexp_extract(x, '{T.NUMERIC_ENTITY}', 1)", f"regexp_extract(x, '{T.NAMED_ENTITY}', 1)"
_CODE = f"CASE WHEN lower({_DIGITS}) LIKE 'x%' THEN TRY_CAST('0x' || substr({_DIGITS}, 2) AS INTEGER) ELSE TRY_CAST({_DIGITS} AS INTEGER) END"
_DECODED = f"CASE WHEN {_DIGITS} <> '' THEN chr({_CODE}) || regexp_replace(x, '{T.NUMERIC_ENTITY}', '') WHEN list_contains(names, {_NAME}) THEN characters[list_position(names, {_NAME})] || substr(x, length({_NAME}) + 2) ELSE '&' || x END"
_HTML = f"(SELECT page_id, p[1] || array_to_string(list_transform(p[2:], lambda x: {_DECODED}), '') AS t FROM (SELECT page_id, string_split({_SEEN}, '&') AS p, {_NAMES} AS names, {_CHARACTERS} AS characters FROM pages))"


@_query(f"SELECT page_id, regexp_replace(regexp_replace(t, '{_W}+', ' ', 'g'), '^ | $', '', 'g') AS text FROM {_HTML}")
def html_to_text(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("page_id", T.html_text(F.col("html")).alias("text"))


@_query(f"SELECT doc_id, regexp_extract(coalesce({_ZH}, ''), '[一-龯，。！？、；：“”‘’（）…—]+', 0) AS run FROM documents")
def first_run_extract(spark, sf_dir):
    text = F.replace(F.replace(F.replace("text", F.lit("."), F.lit("。")), F.lit("!"), F.lit("！")), F.lit("?"), F.lit("？"))
    return _read(spark, sf_dir, "documents").select("doc_id", T.first_cjk_run(text).alias("run"))


@_query(r"SELECT doc_id, array_to_string(regexp_extract_all(text, '[\x{4E00}-\x{9FFF}\p{Nd}]'), ' ') AS chars FROM documents")
def char_tokens(spark, sf_dir):
    return _read(spark, sf_dir, "documents").select("doc_id", F.array_join(TK.characters(F.col("text")), " ").alias("chars"))


@_query(_with("toks") + "SELECT sid, CAST(len(ts) AS INTEGER) AS n, array_to_string(ts, ' ') AS words FROM toks")
def word_tokens(spark, sf_dir):
    return tokens(spark, sf_dir).select("sid", F.size("tokens").alias("n"), F.array_join("tokens", " ").alias("words"))



@_query(r"SELECT p_partkey, array_to_string(regexp_extract_all(p_name || ' CHINA INDIA 42', '(?:GERMANY|INDIA|CHINA|blue|red|green|lace|box|[\x{4E00}-\x{9FFF}\p{Nd}])'), '/') AS tokens FROM part")
def lexicon_longest_match(spark, sf_dir):
    tokenize = TK.lexicon_words(["GERMANY", "INDIA", "CHINA", "blue", "red", "green", "lace", "box"])
    named = F.concat(F.col("p_name"), F.lit(" CHINA INDIA 42"))
    return _read(spark, sf_dir, "part").select("p_partkey", F.array_join(tokenize(named), "/").alias("tokens"))


#: The different words of all documents, and the words of the benchmark that may stand at each place of them.
_RUNS = "runs AS MATERIALIZED (SELECT row_number() OVER () AS sid, t AS r, length(t) AS n FROM (SELECT DISTINCT t FROM tok))"
_GRAPH = (
    _RUNS
    + r""",
freq AS (SELECT t, count(*) AS c FROM (SELECT unnest(regexp_extract_all(lower(text), '\p{L}+')) AS t FROM benchmark) GROUP BY t),
lex AS (SELECT t, CAST(length(t) AS INTEGER) AS l, CAST(round_even(ln(c / (SELECT sum(c) FROM freq)) * 1000000, 0) AS BIGINT) AS s FROM freq),
lone AS (SELECT CAST(round_even(ln(1 / sum(c)) * 1000000, 0) AS BIGINT) AS s FROM freq),
spots AS (SELECT sid, r, unnest(range(1, n + 1)) AS i FROM runs),
found AS MATERIALIZED (SELECT sid, i, lex.l, lex.s FROM (SELECT sid, r, i, unnest((SELECT list(DISTINCT l) FROM lex)) AS k FROM spots) JOIN lex ON lex.l = k AND lex.t = substr(r, i, k))"""
)


def _runs(spark, sf_dir):
    return tokens(spark, sf_dir).select(F.explode(F.array_distinct("tokens")).alias("r")).distinct()


def _benchmark_words(spark, sf_dir):
    return _read(spark, sf_dir, "benchmark").select(F.explode(TK.words(F.col("text"))).alias("simplified")).groupBy("simplified").agg(F.count("*").alias("frequency"))


@_query(
    _with("tok", more=_GRAPH).replace("WITH ", "WITH RECURSIVE ", 1)
    + """, edges AS MATERIALIZED (
    SELECT sid, i, list({'s': s, 'l': l}) AS es FROM (SELECT sid, i, l, s FROM found UNION ALL SELECT p.sid, p.i, 1, lone.s FROM spots p ANTI JOIN (SELECT sid, i FROM found WHERE l = 1) f ON f.sid = p.sid AND f.i = p.i, lone) GROUP BY sid, i),
path(sid, i, scores, steps) AS (
    SELECT sid, n + 1, [0::BIGINT], []::INTEGER[] FROM runs
    UNION ALL SELECT sid, i, list_prepend(b.s, scores), list_prepend(b.l, steps) FROM (
        SELECT e.sid, e.i, scores, steps, list_max(list_transform(e.es, lambda x: {'s': x.s + scores[x.l], 'l': x.l})) AS b FROM path p JOIN edges e ON e.sid = p.sid AND e.i = p.i - 1)),
walk(sid, place, words) AS (
    SELECT sid, 1, []::VARCHAR[] FROM runs
    UNION ALL SELECT w.sid, w.place + p.steps[w.place], list_append(w.words, substr(r, w.place, p.steps[w.place])) FROM walk w JOIN path p ON p.sid = w.sid AND p.i = 1 JOIN runs r ON r.sid = w.sid WHERE w.place <= n)
SELECT r AS word, array_to_string(words, '/') AS words FROM walk w JOIN runs r ON r.sid = w.sid WHERE place = n + 1"""
)
def segment_words(spark, sf_dir):
    """All words of the documents, taken apart by the frequencies of the benchmark's words."""
    cut = segmentation.lexicon(_benchmark_words(spark, sf_dir), unit=segmentation.CHARACTERS).words()
    return _runs(spark, sf_dir).select(F.col("r").alias("word"), F.array_join(cut(F.col("r")), "/").alias("words"))


_WALK = """, longest AS MATERIALIZED (SELECT sid, i, max(l) AS l FROM found GROUP BY sid, i),
walk(sid, place, words) AS (
    SELECT sid, 1, []::VARCHAR[] FROM runs
    UNION ALL SELECT w.sid, w.place + coalesce(f.l, 1), CASE WHEN f.l IS NULL THEN w.words ELSE list_append(w.words, substr(r, w.place, f.l)) END
    FROM walk w JOIN runs r ON r.sid = w.sid LEFT JOIN longest f ON f.sid = w.sid AND f.i = w.place WHERE w.place <= n)
"""


@_query(_with("tok", more=_GRAPH).replace("WITH ", "WITH RECURSIVE ", 1) + _WALK + "SELECT r AS word, array_to_string(words, '/') AS words FROM walk w JOIN runs r ON r.sid = w.sid WHERE place = n + 1")
def lexicon_words(spark, sf_dir):
    """All words of the documents, matched with the longest words of the benchmark."""
    # a vocabulary
    listed = [r["simplified"] for r in _benchmark_words(spark, sf_dir).select("simplified").collect()]
    return _runs(spark, sf_dir).select(F.col("r").alias("word"), F.array_join(TK.lexicon_words(listed)(F.col("r")), "/").alias("words"))


#: Words of the benchmark are put into brackets, pairs of letters that begin one are turned round, and an e gets an accent.
_MAPPING = r"""bench AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '\p{L}+')) AS t FROM benchmark),
mapping AS (SELECT s, min(t) AS t FROM (SELECT t AS s, '<' || t || '>' AS t FROM bench WHERE length(t) > 2 UNION ALL SELECT DISTINCT left(t, 2), reverse(left(t, 2)) FROM bench WHERE length(t) > 1 UNION ALL SELECT 'e', 'é') GROUP BY s)"""


@_query(
    f"""WITH RECURSIVE {_MAPPING},
lines AS MATERIALIZED (SELECT row_number() OVER () AS k, conv_id, turn, text, length(text) AS n FROM conversations WHERE text IS NOT NULL),
found AS MATERIALIZED (
    SELECT k, i, arg_max(m.t, w) AS t, max(w) AS w FROM (SELECT k, text, i, unnest((SELECT list(DISTINCT length(s)) FROM mapping)) AS w FROM (SELECT k, text, unnest(range(1, n + 1)) AS i FROM lines))
    JOIN mapping m ON length(m.s) = w AND m.s = substr(text, i, w) GROUP BY k, i),
walk(k, place, out) AS (
    SELECT k, 1, '' FROM lines
    UNION ALL SELECT w.k, w.place + coalesce(f.w, 1), w.out || coalesce(f.t, substr(l.text, w.place, 1)) FROM walk w JOIN lines l ON l.k = w.k LEFT JOIN found f ON f.k = w.k AND f.i = w.place WHERE w.place <= n)
SELECT conv_id, turn, out AS text, out = text AS is_unchanged FROM walk w JOIN lines l ON l.k = w.k WHERE place = n + 1"""
)
def phrase_rewriting(spark, sf_dir):
    """Messages rewritten by a table of words, pairs of letters and a letter."""
    t = F.col("token")
    bench = _benchmark_tokens(spark, sf_dir)
    words = bench.where(F.char_length(t) > 2).select(t.alias("source"), F.concat(F.lit("<"), t, F.lit(">")).alias("target"))
    pairs = bench.where(F.char_length(t) > 1).select(F.left(t, F.lit(2)).alias("source"), F.reverse(F.left(t, F.lit(2))).alias("target"))
    rewrite = rewriting.rewriter(words.unionByName(pairs).unionByName(spark.createDataFrame([("e", "é")], "source string, target string")))
    rows = _read(spark, sf_dir, "conversations").where("text is not null")
    return rows.select("conv_id", "turn", rewrite(F.col("text")).alias("new"), "text").select("conv_id", "turn", F.col("new").alias("text"), (F.col("new") == F.col("text")).alias("is_unchanged"))


@_query(f"SELECT conv_id, turn, len(regexp_extract_all(text, '[^{_W[1:-1]}]')) AS n, array_to_string(regexp_extract_all(text, '[^{_W[1:-1]}]'), ' ') AS tokens FROM conversations")
def scoring_tokens(spark, sf_dir):
    """Every visible character of a message, punctuation included."""
    found = TK.visible_characters(F.col("text"))
    return _read(spark, sf_dir, "conversations").select("conv_id", "turn", F.size(found).cast("long").alias("n"), F.array_join(found, " ").alias("tokens"))


_PUNCTUATED = T.PUNCTUATION.replace("'", "''")


@_query(f"SELECT conv_id, turn, regexp_replace(text, '{_PUNCTUATED}+', '|', 'g') AS parted, length(text) - length(regexp_replace(text, '{_PUNCTUATED}', '', 'g')) AS n FROM conversations")
def punctuation(spark, sf_dir):
    """What parts the words of a message."""
    bare = F.regexp_replace("text", T.PUNCTUATION, "")
    return _read(spark, sf_dir, "conversations").select("conv_id", "turn", F.regexp_replace("text", f"{T.PUNCTUATION}+", "|").alias("parted"), (F.char_length("text") - F.char_length(bare)).cast("long").alias("n"))


@_query(_with("tok") + "SELECT g, count(*) AS n FROM (SELECT array_to_string(ts[i + 1:i + 3], ' ') AS g FROM tok WHERE i + 3 <= len(ts)) GROUP BY g")
def token_ngrams(spark, sf_dir):
    grams = tokens(spark, sf_dir).select(F.explode(TK.ngrams(F.col("tokens"), 3)).alias("g"))
    return grams.select(F.array_join("g", " ").alias("g")).groupBy("g").agg(F.count("*").alias("n"))


@_query(r"SELECT event_id, coalesce(from_json_strict, '') AS keys FROM (SELECT event_id, array_to_string(list_sort(json_keys(props)), ',') AS from_json_strict FROM events)")
def json_props(spark, sf_dir):
    names = F.array_sort(F.coalesce(F.json_object_keys("props"), F.array().cast("array<string>")))
    return _read(spark, sf_dir, "events").select("event_id", F.array_join(names, ",").alias("keys"))


# Keys.

_ESC = r"replace(replace(replace(replace({}, '\', '\\'), '|', '\|'), ',', '\,'), '=', '\=')"


@_query("SELECT page_id, " + _ESC.format("html") + " AS escaped FROM pages")
def escape_component(spark, sf_dir):
    return _read(spark, sf_dir, "pages").select("page_id", K.escape(F.col("html")).alias("escaped"))


@_query("SELECT p_partkey, 'fam|a=' || replace(p_name, ' ', ',') || '|p=brand=' || " + _ESC.format("p_brand || '=|'") + " || ',size=' || p_size AS pattern_key FROM part")
def key_of_parameters(spark, sf_dir):
    """Keys of parameters given as a map: names trimmed and in order, blank ones left out."""
    params = F.create_map(F.lit(" size "), F.col("p_size").cast("string"), F.lit("brand"), F.concat("p_brand", F.lit("=|")), F.lit("  "), F.lit("x"))
    return _read(spark, sf_dir, "part").select("p_partkey", K.key_of(F.lit("fam"), F.split("p_name", " "), params).alias("pattern_key"))


def _sql_bucket(gap: str) -> str:
    return f"CASE WHEN {gap} <= 0 THEN '0' WHEN {gap} = 1 THEN '1' WHEN {gap} <= 3 THEN '2-3' WHEN {gap} <= 7 THEN '4-7' ELSE '8+' END"


@_query(f"SELECT {_sql_bucket('l_quantity - 5')} AS bucket, count(*) AS n FROM lineitem GROUP BY 1")
def gap_bucket_dist(spark, sf_dir):
    return _read(spark, sf_dir, "lineitem").groupBy(K.gap_bucket(F.col("l_quantity") - 5).alias("bucket")).agg(F.count("*").alias("n"))


_SOME_KEY = "CASE event_id % 4 WHEN 0 THEN '' WHEN 1 THEN event_type || '|a=|p=' WHEN 2 THEN event_type || ':old' ELSE event_type END"


def _some_keys(spark, sf_dir):
    kind = F.col("event_id") % 4
    t = F.col("event_type")
    key = F.when(kind == 0, "").when(kind == 1, F.concat(t, F.lit("|a=|p="))).when(kind == 2, F.concat(t, F.lit(":old"))).otherwise(t)
    return _read(spark, sf_dir, "events").select(key.alias("pattern_key"))


@_query(f"SELECT family, legacy, count(*) AS n FROM (SELECT CASE WHEN k = '' THEN 'unknown' ELSE split_part(k, '|', 1) END AS family, CASE WHEN contains(k, '|') THEN split_part(k, '|', 1) WHEN contains(k, ':') THEN split_part(k, ':', 1) ELSE 'unknown' END AS legacy FROM (SELECT {_SOME_KEY} AS k FROM events)) GROUP BY ALL")
def family_from_key(spark, sf_dir):
    key = F.col("pattern_key")
    return _some_keys(spark, sf_dir).groupBy(K.family_of(key).alias("family"), K.legacy_family_of(key).alias("legacy")).agg(F.count("*").alias("n"))


@_query(f"SELECT count(*) AS n_keys, count(*) FILTER (k <> '' AND contains(k, '|a=') AND contains(k, '|p=')) AS n_valid, count(*) - count(*) FILTER (k <> '' AND contains(k, '|a=') AND contains(k, '|p=')) AS n_invalid FROM (SELECT {_SOME_KEY} AS k FROM events)")
def key_validity(spark, sf_dir):
    return R.key_validity(_some_keys(spark, sf_dir))


@_query("SELECT sha256('7:' || p_name) AS digest, count(*) AS n FROM part GROUP BY 1")
def sha256_text(spark, sf_dir):
    return _read(spark, sf_dir, "part").groupBy(F.sha2(F.concat(F.lit("7:"), "p_name"), 256).alias("digest")).agg(F.count("*").alias("n"))


# Anchors.


@_query(_with("tok") + "SELECT t AS token, count(*) AS tf FROM tok GROUP BY t")
def token_tf(spark, sf_dir):
    return A.token_tf(tokens(spark, sf_dir))


@_query(_with("tok") + "SELECT t AS token, count(DISTINCT sid) AS df FROM tok GROUP BY t")
def token_df(spark, sf_dir):
    return A.token_df(tokens(spark, sf_dir))


@_query(_with("anc") + "SELECT t AS token, c AS n FROM anc")
def anchor_topk_df(spark, sf_dir):
    return A.top_tokens(tokens(spark, sf_dir), TOP_K, "df", MAX_LEN)


@_query(_with("tok") + f"SELECT t AS token, count(*) AS n FROM tok WHERE length(t) <= {MAX_LEN} GROUP BY t ORDER BY n DESC, t LIMIT {TOP_K}")
def anchor_topk_tf(spark, sf_dir):
    return A.top_tokens(tokens(spark, sf_dir), TOP_K, "tf", MAX_LEN)


@_query(_with("tok", more=_BENCH) + f"SELECT t AS token, count(DISTINCT sid) AS n FROM tok WHERE length(t) <= {MAX_LEN} AND t IN (SELECT token FROM bench) GROUP BY t ORDER BY n DESC, t LIMIT 60")
def anchor_allowed(spark, sf_dir):
    return A.top_tokens(tokens(spark, sf_dir), 60, "df", MAX_LEN, _benchmark_tokens(spark, sf_dir))


_SIDES = "sides AS (SELECT o.t, 'l' AS side, CASE WHEN i = 0 THEN '<BOS>' ELSE ts[i] END AS n FROM occ o UNION ALL SELECT o.t, 'r', CASE WHEN i + 1 = len(ts) THEN '<EOS>' ELSE ts[i + 2] END FROM occ o),\nh AS (SELECT t, side, ln(sum(c)) - sum(c * ln(c)) / sum(c) AS h FROM (SELECT t, side, n, count(*) AS c FROM sides GROUP BY ALL) GROUP BY t, side)"


@_query(_with("occ", more=_SIDES) + "SELECT t AS token, round(coalesce(max(h) FILTER (side = 'l'), 0), 6) AS h_left, round(coalesce(max(h) FILTER (side = 'r'), 0), 6) AS h_right FROM h GROUP BY t")
def anchor_neighbors_entropy(spark, sf_dir):
    found = A.neighbour_entropy(tokens(spark, sf_dir), anchor_tokens(spark, sf_dir))
    return found.select("token", F.round("h_left", 6).alias("h_left"), F.round("h_right", 6).alias("h_right"))


_SCORED = (
    _SIDES
    + ",\nlines AS (SELECT count(*) AS n FROM toks WHERE len(ts) > 0),\nscored AS (SELECT a.t AS token, count(DISTINCT o.sid) AS df, count(*) AS tf, count(DISTINCT o.sid) / any_value(lines.n) AS df_rate FROM anc a JOIN occ o ON a.t = o.t, lines GROUP BY a.t),\nfinal AS (SELECT s.*, (l.h + r.h) / 2 AS entropy, 2.0 * df_rate + 0.25 * (l.h + r.h) / 2 + 0.10 * ln(1 + tf) AS score FROM scored s JOIN h l ON l.t = token AND l.side = 'l' JOIN h r ON r.t = token AND r.side = 'r')"
)


@_query(_with("occ", more=_SCORED) + "SELECT token, df, tf, round(df_rate, 6) AS df_rate, round(entropy, 6) AS entropy, round(score, 6) AS score FROM final WHERE df >= 20 AND entropy >= 2.0 ORDER BY final.score DESC, token LIMIT 100")
def anchor_score_final(spark, sf_dir):
    scored = A.score_candidates(tokens(spark, sf_dir), anchor_tokens(spark, sf_dir))
    best = A.final_anchors(scored, 100, min_df=20, min_entropy=2.0)
    return best.select("token", "df", "tf", *[F.round(c, 6).alias(c) for c in ("df_rate", "entropy", "score")])


@_query(_with("tok", more=_BENCH) + "SELECT token FROM bench WHERE token NOT IN (SELECT t FROM tok)")
def zero_df_anchors(spark, sf_dir):
    return A.zero_df(_benchmark_tokens(spark, sf_dir), tokens(spark, sf_dir))


@_query(_with("tok", more=_BENCH) + "SELECT token, coalesce(c, 0) AS df FROM bench LEFT JOIN (SELECT t, count(DISTINCT sid) AS c FROM tok GROUP BY t) ON t = token ORDER BY df DESC, token LIMIT 25")
def top_df_candidates(spark, sf_dir):
    return R.top_df_candidates(tokens(spark, sf_dir), _benchmark_tokens(spark, sf_dir))


@_query(_with("tok") + "SELECT t AS token, count(DISTINCT sid) AS df, count(*) AS tf FROM tok GROUP BY t ORDER BY df DESC, token LIMIT 25")
def top_df_tokens(spark, sf_dir):
    return R.top_df_tokens(tokens(spark, sf_dir))


# Patterns: occurrences, sentences and realizations of each key.


def _pattern_stats(spark, sf_dir, *families, personal=False, **options):
    rows = extracted(spark, sf_dir, *families, personal=personal, **options)
    return S.pattern_counts(rows)


def _pattern_sql(rows: str, *, before: str = "") -> str:
    return _with("occ", more=(before + ",\n" if before else "") + f"pat AS ({rows})") + "SELECT pattern_key, count(*) AS count_occurrences, count(DISTINCT sid) AS count_sentences, count(DISTINCT nullif(realization, '')) AS n_realizations FROM pat GROUP BY pattern_key"


_ANCSET = "aset AS (SELECT list(t) AS a FROM anc)"


def _slotted(tokens_: str) -> str:
    return f"array_to_string(list_transform({tokens_}, lambda x: CASE WHEN list_contains(a, x) THEN x ELSE '<X>' END), ' ')"


def _kept(tokens_: str) -> str:
    return f"array_to_string(list_filter({tokens_}, lambda x: list_contains(a, x)), ',')"


_NG = " UNION ALL ".join(f"SELECT sid, {n} AS n, ts[i + 1:i + {n}] AS g FROM tok WHERE i + {n} <= len(ts)" for n in (2, 3))
_TOK_NG = f"SELECT sid, 'tok_ng|a=' || {_kept('g')} || '|p=n=' || n || ',sig=' || {_slotted('g')} AS pattern_key, array_to_string(g, ' ') AS realization FROM ({_NG}), aset WHERE len(list_filter(g, lambda x: list_contains(a, x))) > 0"
_WIN = f"SELECT sid, 'anch_win|a=' || {_kept('w')} || '|p=l=' || l || ',r=' || r || ',sig=' || {_slotted('w')} AS pattern_key, array_to_string(w, ' ') AS realization FROM (SELECT sid, least(i, 2) AS l, least(len(ts) - i - 1, 2) AS r, ts[greatest(i - 2, 0) + 1:i + 3] AS w FROM occ), aset"
_PAIR = f"SELECT x.sid, 'anch_pair|a=' || x.t || ',' || y.t || '|p=gap=' || {_sql_bucket('(y.i - x.i - 1)')} AS pattern_key, array_to_string(x.ts[x.i + 1:y.i + 1], ' ') AS realization FROM occ x JOIN occ y ON x.sid = y.sid AND y.i > x.i AND y.i - x.i - 1 <= 20"
_SEQ = "SELECT sid, 'anch_seq|a=' || string_agg(t, ',' ORDER BY i) || '|p=' AS pattern_key, string_agg(t, ' ' ORDER BY i) AS realization FROM occ GROUP BY sid HAVING count(*) >= 2"
_CLASSES = "CASE WHEN list_contains(a, x) THEN x WHEN regexp_full_match(x, '\\p{Nd}+(\\.\\p{Nd}+)?') THEN '<NUM>' WHEN length(x) = 1 THEN '<C1>' WHEN length(x) = 2 THEN '<C2>' ELSE '<W>' END"
_SKEL = f"SELECT sid, 'skel|a=' || {_kept('ts')} || '|p=sig=' || array_to_string(list_transform(ts, lambda x: {_CLASSES}), ' ') AS pattern_key, array_to_string(ts, ' ') AS realization FROM toks, aset"
_CSKEL = "SELECT sid, 'cskel|a=' || string_agg(t, ',' ORDER BY i) || '|p=sig=' || string_agg(CASE WHEN pi IS NOT NULL AND i - pi > 1 THEN '<SPAN> ' || t ELSE t END, ' ' ORDER BY i) AS pattern_key, array_to_string(any_value(ts), ' ') AS realization FROM occ GROUP BY sid"
_SPANS = "spans AS (SELECT sid, ts, t, i, CASE WHEN ni - i <= 20 THEN nt ELSE '<END>' END AS tail, CASE WHEN ni - i <= 20 THEN ni - i - 1 ELSE least(20, len(ts) - i - 1) END AS gap, CASE WHEN ni - i <= 20 THEN ni ELSE least(i + 20, len(ts) - 1) END AS last FROM occ)"
_SPAN = f"SELECT sid, 'anch_span|a=' || t || ',' || tail || '|p=gap=' || {_sql_bucket('gap')} AS pattern_key, array_to_string(ts[i + 1:last + 1], ' ') AS realization FROM spans"
_SIG = f"SELECT sid, 'span_sig|a=' || t || ',' || tail || '|p=gap=' || {_sql_bucket('gap')} || ',kA=0,kX=' || gap AS pattern_key, array_to_string(ts[i + 1:last + 1], ' ') AS realization FROM spans"
_SKIP2 = "SELECT x.sid, 'a_skip2|a=' || x.t || ',' || y.t || '|p=max_jump=10' AS pattern_key, x.t || ' ... ' || y.t AS realization FROM occ x JOIN occ y ON x.sid = y.sid AND y.i > x.i AND y.i - x.i <= 10"
_SKIP3 = "SELECT x.sid, 'a_skip3|a=' || x.t || ',' || y.t || ',' || z.t || '|p=max_jump=10' AS pattern_key, x.t || ' ... ' || y.t || ' ... ' || z.t AS realization FROM occ x JOIN occ y ON x.sid = y.sid AND y.i > x.i AND y.i - x.i <= 10 JOIN occ z ON y.sid = z.sid AND z.i > y.i AND z.i - y.i <= 10"


@_query(_pattern_sql(_TOK_NG, before=_ANCSET))
def pat_tok_ng(spark, sf_dir):
    return _pattern_stats(spark, sf_dir, "tok_ng", max_ngram_n=3)


@_query(_pattern_sql(_WIN, before=_ANCSET))
def pat_anch_win(spark, sf_dir):
    return _pattern_stats(spark, sf_dir, "anch_win")


@_query(_pattern_sql(_PAIR))
def pat_anch_pair(spark, sf_dir):
    return AP.pattern_counts(tokens(spark, sf_dir), anchor_tokens(spark, sf_dir))


@_query(_pattern_sql(_SEQ))
def pat_anch_seq(spark, sf_dir):
    return _pattern_stats(spark, sf_dir, "anch_seq")


@_query(_pattern_sql(_SKEL, before=_ANCSET))
def pat_skel(spark, sf_dir):
    return _pattern_stats(spark, sf_dir, "skel")


@_query(_pattern_sql(_CSKEL))
def pat_cskel(spark, sf_dir):
    return _pattern_stats(spark, sf_dir, "cskel")


@_query(_pattern_sql(_SPAN, before=_SPANS))
def pat_anch_span(spark, sf_dir):
    return _pattern_stats(spark, sf_dir, "anch_span")


@_query(_pattern_sql(_SIG, before=_SPANS))
def pat_span_sig(spark, sf_dir):
    return _pattern_stats(spark, sf_dir, "span_sig")


@_query(_pattern_sql(_SKIP2))
def pat_skip2(spark, sf_dir):
    return _pattern_stats(spark, sf_dir, "a_skip2")


@_query(_pattern_sql(_SKIP3))
def pat_skip3(spark, sf_dir):
    return _pattern_stats(spark, sf_dir, "a_skip3")


_DEFAULT = f"{_WIN} UNION ALL {_PAIR} UNION ALL {_SKEL} UNION ALL {_CSKEL}"


@_query(_pattern_sql(_DEFAULT, before=_ANCSET))
def pat_all_default(spark, sf_dir):
    rows, anchors = tokens(spark, sf_dir), anchor_tokens(spark, sf_dir)
    others = P.extract(rows, anchors, families=[f for f in P.DEFAULT_FAMILIES if f != "anch_pair"])
    # keys name their family, so no key is of both
    return S.pattern_counts(others).unionByName(AP.pattern_counts(rows, anchors))


# Statistics.

_PRIOR = f"pat AS ({_PAIR}),\nprior AS (SELECT pattern_key, count(*) AS count_occurrences, count(DISTINCT sid) AS count_sentences FROM pat GROUP BY pattern_key)"


def anchor_pair_prior(spark: SparkSession, sf_dir: str) -> DataFrame:
    stats = _prior(spark, sf_dir)
    return stats.select("pattern_key", "count_occurrences", "count_sentences", F.round("p_global", 6).alias("p_global"))


@_query(_with("occ", more=_PRIOR) + "SELECT pattern_key, count_occurrences, count_sentences, round(count_sentences / sum(count_sentences) OVER (), 6) AS p_global FROM prior")
def prior_stats(spark, sf_dir):
    return anchor_pair_prior(spark, sf_dir)


_EMIT = _PAIR.replace("SELECT x.sid,", "SELECT x.sid, x.i AS e1, y.i AS e2,", 1)


@_query(_with("occ", more=f"pat AS ({_EMIT})") + f"SELECT pattern_key, realization FROM (SELECT *, row_number() OVER (PARTITION BY pattern_key ORDER BY place) AS n FROM (SELECT pattern_key, realization, min({{'s': sid, 'a': e1, 'b': e2}}) AS place FROM pat WHERE realization <> '' GROUP BY 1, 2)) WHERE n <= {CAP}")
def prior_realizations_capped(spark, sf_dir):
    return AP.realizations(tokens(spark, sf_dir), anchor_tokens(spark, sf_dir), cap=CAP)


_PERSONAL = f"ppat AS (SELECT * FROM ({_PAIR}) WHERE sid // 2147483648 IN (SELECT doc_id FROM labels WHERE quality = 1)),\nown AS (SELECT pattern_key, count(*) AS count_seen, count(DISTINCT sid) AS distinct_sentence_count, count(*) >= 3 AND count(DISTINCT sid) >= 2 AS emerged FROM ppat GROUP BY pattern_key)"


def _personal(spark, sf_dir):
    counts = pair_counts(spark, sf_dir, personal=True)
    return S.personal_of_counts(counts.withColumnsRenamed({"count_occurrences": "own_occurrences", "count_sentences": "own_sentences"}))


@_query(_with("occ", more=_PERSONAL) + "SELECT pattern_key, 'anch_pair' AS family, count_seen, distinct_sentence_count, emerged FROM own")
def personal_stats(spark, sf_dir):
    return _personal(spark, sf_dir).drop("last_seen_at")


@_query("SELECT l_suppkey, count(*) AS c, count(DISTINCT l_orderkey) AS s, count(*) >= 3 AND count(DISTINCT l_orderkey) >= 2 AS emerged, round(ln(1 + count(*)), 6) AS mastery FROM lineitem GROUP BY l_suppkey")
def emerged_mastery(spark, sf_dir):
    n = _read(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(F.count("*").alias("c"), F.countDistinct("l_orderkey").alias("s"))
    return n.select("l_suppkey", "c", "s", emerged(F.col("c"), F.col("s")).alias("emerged"), F.round(mastery(F.col("c")), 6).alias("mastery"))


_LEX = "lex AS (SELECT token AS simplified, CAST(ascii(token) % 8 AS INTEGER) AS level, CAST(length(token) AS INTEGER) AS frequency FROM bench),\nbest AS (SELECT * FROM lex WHERE level <= 6 AND level <> 7)"


def _lexicon(spark, sf_dir):
    t = F.col("token")
    return _benchmark_tokens(spark, sf_dir).select(t.alias("simplified"), (F.ascii(t) % 8).cast("int").alias("level"), F.char_length(t).alias("frequency"))


def _vocabulary(spark, sf_dir):
    return S.vocabulary(personal_tokens(spark, sf_dir), S.best_entries(_lexicon(spark, sf_dir)))


_VOCAB = _BENCH + ",\n" + _LEX + ",\nvocab AS (SELECT t AS word, count(*) AS count, ln(1 + count(*)) AS mastery, any_value(level) AS hsk_level, any_value(frequency) AS hsk_frequency FROM ptok LEFT JOIN best ON t = simplified GROUP BY t)"


@_query(_with("ptok", more=_VOCAB) + "SELECT word, count, round(mastery, 6) AS mastery, hsk_level, hsk_frequency FROM vocab")
def vocab_stats_lexicon(spark, sf_dir):
    return _vocabulary(spark, sf_dir).select("word", "count", F.round("mastery", 6).alias("mastery"), "hsk_level", "hsk_frequency")


@_query(_with("sent") + "SELECT min(sid) AS sid, text AS zh_text, 'corpus' AS source FROM sent GROUP BY text")
def sentences_keep_first(spark, sf_dir):
    rows = sentences(spark, sf_dir).select("sid", F.col("text").alias("zh_text"), F.lit("corpus").alias("source"))
    return S.keep_first(rows)


_HALVES = " UNION ALL ".join(f"(SELECT l_partkey, count(*) AS count_sentences, CAST(sum(l_linenumber) AS BIGINT) AS count_occurrences, CAST(max(l_linenumber) AS BIGINT) AS distinct_realization_count FROM lineitem WHERE l_orderkey % 2 = {h} GROUP BY 1)" for h in (0, 1))


@_query(f"SELECT CAST(l_partkey AS VARCHAR) AS pattern_key, CAST(sum(count_sentences) AS BIGINT) AS count_sentences, CAST(sum(count_occurrences) AS BIGINT) AS count_occurrences, max(distinct_realization_count) AS distinct_realization_count FROM ({_HALVES}) GROUP BY 1")
def merge_counts(spark, sf_dir):
    def half(h: int) -> DataFrame:
        own = _read(spark, sf_dir, "lineitem").where(f"l_orderkey % 2 = {h}").groupBy(F.col("l_partkey").cast("string").alias("pattern_key"))
        return own.agg(F.count("*").alias("count_sentences"), F.sum("l_linenumber").alias("count_occurrences"), F.max("l_linenumber").cast("long").alias("distinct_realization_count"))

    return S.merge_counts(half(0), half(1))


@_query("SELECT o_custkey AS key, max(o_orderkey) FILTER (o_custkey % 3 = 0 OR o_orderkey % 2 = 0) AS newest FROM orders GROUP BY 1 HAVING newest IS NOT NULL")
def replace_rows(spark, sf_dir):
    """The newest even order of each customer, replaced by the newest of all for a third of the customers."""
    orders = _read(spark, sf_dir, "orders")
    newest = lambda df: df.groupBy(F.col("o_custkey").alias("key")).agg(F.max("o_orderkey").alias("newest"))
    return S.replace_rows(newest(orders.where("o_orderkey % 2 = 0")), newest(orders.where("o_custkey % 3 = 0")), "key")


# Reports.

_BOTH = _PRIOR + ",\n" + _PERSONAL


def _prior(spark, sf_dir):
    return S.prior_of_counts(pair_counts(spark, sf_dir))


@_query(_with("occ", more=_BOTH) + "SELECT count(*) AS emerged_patterns, round(sum(coalesce(p, 0)), 6) AS coverage_mass FROM (SELECT * FROM own WHERE emerged) LEFT JOIN (SELECT pattern_key, count_sentences / sum(count_sentences) OVER () AS p FROM prior) USING (pattern_key)")
def coverage_mass(spark, sf_dir):
    good = _read(spark, sf_dir, "labels").where("quality = 1").select("doc_id").distinct().withColumn("own", F.lit(True))
    # both corpora in one pass
    counts = AP.key_counts(tokens(spark, sf_dir).join(good, "doc_id", "left"), anchor_tokens(spark, sf_dir), own=F.col("own"))
    found = M.coverage_mass(S.personal_of_counts(counts), S.with_share(counts))
    return found.select("emerged_patterns", F.round("coverage_mass", 6).alias("coverage_mass"))


@_query(_with("occ", more=_PERSONAL) + "SELECT count_seen AS value, count(*) AS n_patterns FROM own GROUP BY 1")
def count_histogram(spark, sf_dir):
    return R.count_histogram(_personal(spark, sf_dir), "count_seen")


_RANGES = ", ".join(f"({low}, '{low if low == high else f'{low}-{high or chr(0x221E)}'}', {high or 10**12})" for low, high in R.RANGES)


@_query(_with("occ", more=_PRIOR) + f"SELECT CAST(low AS BIGINT) AS low, label, count(pattern_key) AS n_patterns FROM (VALUES {_RANGES}) r(low, label, high) LEFT JOIN prior ON count_sentences BETWEEN low AND high GROUP BY low, label")
def bucket_histogram(spark, sf_dir):
    return R.range_histogram(_prior(spark, sf_dir), "count_sentences")


@_query(_with("occ", more=_PRIOR) + "SELECT count(*) AS total, count(*) FILTER (count_sentences = 1) AS eq_1, count(*) FILTER (count_sentences = 2) AS eq_2, count(*) FILTER (count_sentences = 3) AS eq_3, count(*) FILTER (count_sentences >= 5) AS ge_5, count(*) FILTER (count_sentences >= 10) AS ge_10, count(*) FILTER (count_sentences >= 100) AS ge_100 FROM prior")
def count_thresholds(spark, sf_dir):
    return R.count_thresholds(_prior(spark, sf_dir), "count_sentences")


@_query(_with("occ", more=f"{_ANCSET},\npat AS ({_DEFAULT})") + "SELECT split_part(pattern_key, '|', 1) AS family, count(DISTINCT pattern_key) AS n_patterns FROM pat GROUP BY 1 ORDER BY n_patterns DESC, family LIMIT 12")
def family_breakdown(spark, sf_dir):
    return R.family_breakdown(S.key_counts(extracted(spark, sf_dir, realizations=False)))


@_query(_with("occ", more=_PRIOR) + "SELECT quantile_disc(count_sentences, 0.5) AS p50, quantile_disc(count_sentences, 0.9) AS p90, quantile_disc(count_sentences, 0.99) AS p99 FROM prior")
def quantiles(spark, sf_dir):
    return R.quantiles(_prior(spark, sf_dir), "count_sentences")


@_query(_with("occ", more=_PRIOR) + "SELECT count(*) AS total, count(*) FILTER (count_sentences = 1) AS n_single, round(count(*) FILTER (count_sentences = 1) / count(*), 6) AS share FROM prior")
def singletons(spark, sf_dir):
    return R.singletons(_prior(spark, sf_dir)).select("total", "n_single", F.round("share", 6).alias("share"))


@_query(_with("occ", more=_PRIOR) + "SELECT pattern_key, count_sentences, count_occurrences FROM prior ORDER BY count_sentences DESC, pattern_key LIMIT 20")
def top_patterns(spark, sf_dir):
    return R.top_patterns(pair_counts(spark, sf_dir)).select("pattern_key", "count_sentences", "count_occurrences")


@_query(_with("occ", more=_PERSONAL) + "SELECT pattern_key, count_seen, distinct_sentence_count FROM own WHERE emerged ORDER BY count_seen DESC, distinct_sentence_count DESC, pattern_key LIMIT 20")
def top_emerged(spark, sf_dir):
    return R.top_emerged(_personal(spark, sf_dir)).select("pattern_key", "count_seen", "distinct_sentence_count")


@_query(_with("occ", more=_PRIOR + ",\ntop AS (SELECT pattern_key FROM prior ORDER BY count_sentences DESC, pattern_key LIMIT 12)") + f"SELECT pattern_key, realization FROM (SELECT pattern_key, realization, row_number() OVER (PARTITION BY pattern_key ORDER BY sha256('{SEED}:' || realization), realization) AS n FROM (SELECT DISTINCT pattern_key, realization FROM pat WHERE pattern_key IN (SELECT pattern_key FROM top))) WHERE n <= 6")
def top_realizations(spark, sf_dir):
    rows, listed = tokens(spark, sf_dir), anchor_tokens(spark, sf_dir)
    # twelve keys, so no other's texts are put together
    top = R.top_patterns(AP.key_counts(rows, listed), 12).select("pattern_key").collect()
    keys = spark.createDataFrame(top, "pattern_key string")
    return R.with_realizations(keys, AP.realizations(rows, listed, keys=[r["pattern_key"] for r in top]), 6, SEED)


@_query(_with("ptok", more=_VOCAB) + "SELECT word, count FROM vocab ORDER BY count DESC, word LIMIT 20")
def top_vocab(spark, sf_dir):
    return R.top_vocabulary(_vocabulary(spark, sf_dir)).select("word", "count")


@_query(_with("ptok", more=_VOCAB) + "SELECT count(*) AS n_words, count(*) FILTER (hsk_level IS NULL) AS n_unknown, count(*) FILTER (length(word) = 1) AS n_single, round(count(*) FILTER (hsk_level IS NULL) / count(*), 6) AS unknown_share, round(count(*) FILTER (length(word) = 1) / count(*), 6) AS single_share FROM vocab")
def unknown_vocab_ratio(spark, sf_dir):
    found = R.vocabulary_health(_vocabulary(spark, sf_dir))
    return found.select("n_words", "n_unknown", "n_single", F.round("unknown_share", 6).alias("unknown_share"), F.round("single_share", 6).alias("single_share"))


@_query(
    _with("occ", more=f"{_ANCSET},\npat AS ({_DEFAULT}),\nhits AS (SELECT (SELECT count(*) FROM sent) AS n, (SELECT count(DISTINCT sid) FROM pat) AS n_any, (SELECT count(DISTINCT sid) FROM pat WHERE starts_with(pattern_key, 'skel|')) AS n_skel)")
    + "SELECT n AS n_sentences, n_any, n_skel, round(n_any / n, 6) AS any_share, round(n_skel / n, 6) AS skel_share FROM hits"
)
def sentence_coverage(spark, sf_dir):
    rows = extracted(spark, sf_dir, realizations=False).select(F.transform("patterns", lambda p: p["pattern_key"]).alias("patterns"))
    found = R.sentence_coverage(rows)
    return found.select("n_sentences", "n_any", "n_skel", F.round("any_share", 6).alias("any_share"), F.round("skel_share", 6).alias("skel_share"))


@_query(_with("occ", more=_PRIOR + ",\ntop AS (SELECT pattern_key FROM prior ORDER BY count_sentences DESC, pattern_key LIMIT 200)") + "SELECT t AS token, count(pattern_key) AS n_keys FROM anc LEFT JOIN top ON contains(pattern_key, t) GROUP BY t")
def anchor_presence(spark, sf_dir):
    top = R.top_patterns(pair_counts(spark, sf_dir), 200)
    return M.anchor_presence(_anchors(spark, sf_dir), top)


_TOP_200 = _PRIOR + ",\ntop AS (SELECT pattern_key FROM prior ORDER BY count_sentences DESC, pattern_key LIMIT 200),\nfew AS (SELECT t FROM anc ORDER BY t LIMIT 80),\nhits AS (SELECT count(*) AS n_checked, count(*) FILTER (EXISTS (SELECT 1 FROM top WHERE contains(pattern_key, t))) AS n_found FROM few)"


@_query(_with("occ", more=_TOP_200) + "SELECT n_checked, n_found, round(n_found / n_checked, 6) AS share, n_found < greatest(5, floor(n_checked * 15 / 100)) AS is_low FROM hits")
def anchor_presence_summary(spark, sf_dir):
    top = R.top_patterns(_prior(spark, sf_dir), 200)
    listed = spark.createDataFrame(list(enumerate(anchor_tokens(spark, sf_dir))), "ordinal long, token string")
    return M.anchor_presence_summary(listed, top).withColumn("share", F.round("share", 6))


@_query(_with("occ", more=_PRIOR) + "SELECT pattern_key, count_sentences FROM prior ORDER BY count_sentences DESC, pattern_key LIMIT 5 OFFSET 100")
def patterns_page(spark, sf_dir):
    return R.page(_prior(spark, sf_dir).select("pattern_key", "count_sentences"), ["-count_sentences", "pattern_key"], 100, 5)


@_query(_with("occ", more=_PRIOR) + "SELECT pattern_key, count_sentences, count_occurrences FROM prior WHERE pattern_key = 'anch_pair|a=in,the|p=gap=0'")
def pattern_lookup(spark, sf_dir):
    return R.lookup(_prior(spark, sf_dir), "anch_pair|a=in,the|p=gap=0").select("pattern_key", "count_sentences", "count_occurrences")


_OVERLAP = f"low AS (SELECT t FROM tok WHERE length(t) <= {MAX_LEN} GROUP BY t ORDER BY count(*) DESC, t LIMIT {TOP_K})"


@_query(_with("anc", more=_OVERLAP) + "SELECT n_a, n_b, n_both, round(n_both / n_a, 6) AS share_of_a, round(n_both / (n_a + n_b - n_both), 6) AS jaccard FROM (SELECT (SELECT count(*) FROM anc) AS n_a, (SELECT count(*) FROM low) AS n_b, (SELECT count(*) FROM anc JOIN low USING (t)) AS n_both)")
def anchor_overlap(spark, sf_dir):
    by_tf = A.top_tokens(tokens(spark, sf_dir), TOP_K, "tf", MAX_LEN)
    found = M.list_overlap(_anchors(spark, sf_dir), by_tf)
    return found.select("n_a", "n_b", "n_both", F.round("share_of_a", 6).alias("share_of_a"), F.round("jaccard", 6).alias("jaccard"))


@_query(_with("anc", more=_BENCH) + "SELECT t AS token, t IN (SELECT token FROM bench) AS is_candidate FROM anc")
def anchors_against_candidates(spark, sf_dir):
    return R.anchors_against_candidates(_anchors(spark, sf_dir), _benchmark_tokens(spark, sf_dir))


_TABLES = ("documents", "labels", "benchmark", "pages", "conversations", "events", "embeddings")


@_query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n_rows FROM {t}" for t in _TABLES))
def table_health(spark, sf_dir):
    return R.table_health({t: _read(spark, sf_dir, t) for t in _TABLES})


@_query(f"SELECT count(*) AS lines_seen, count(*) FILTER (regexp_replace(l, '{_W}', '', 'g') <> '') AS lines_kept FROM (SELECT unnest(string_split(text, chr(10))) AS l FROM documents)")
def line_totals(spark, sf_dir):
    lines = _read(spark, sf_dir, "documents").select(F.explode(F.split("text", "\n")).alias("value"))
    return lines.agg(F.count("*").alias("lines_seen"), F.count_if(T.strip(F.col("value")) != "").alias("lines_kept"))


# Similarity.

_DOCSETS = _with("anc") + ",\nsets AS (SELECT doc_id, list_distinct(list(t)) AS s FROM tok WHERE t IN (SELECT t FROM anc) GROUP BY doc_id)"


def _document_sets(spark, sf_dir):
    own = tokens(spark, sf_dir).withColumn("tokens", F.filter("tokens", P.membership(anchor_tokens(spark, sf_dir))))
    return own.select("doc_id", F.explode("tokens").alias("t")).groupBy("doc_id").agg(F.collect_set("t").alias("s"))


def _neighbours(spark, sf_dir):
    """Pairs of a document and the next one."""
    sets = _document_sets(spark, sf_dir)
    following = sets.select((F.col("doc_id") - 1).alias("doc_id"), F.col("s").alias("b"))
    return sets.join(following, "doc_id").select(F.col("doc_id").alias("pair_id"), F.col("s").alias("a"), "b")


@_query(_DOCSETS + "\nSELECT x.doc_id AS pair_id, round(len(list_intersect(x.s, y.s)) / (len(x.s) + len(y.s) - len(list_intersect(x.s, y.s))), 6) AS similarity FROM sets x JOIN sets y ON y.doc_id = x.doc_id + 1")
def jaccard_pairs(spark, sf_dir):
    return _neighbours(spark, sf_dir).select("pair_id", F.round(M.jaccard(F.col("a"), F.col("b")), 6).alias("similarity"))


@_query(
    _DOCSETS
    + ",\nn AS (SELECT count(*) AS n FROM sets),\ndf AS (SELECT t, count(*) AS df FROM (SELECT doc_id, unnest(s) AS t FROM sets) GROUP BY t),\nboth AS (SELECT x.doc_id AS pair_id, unnest(list_distinct(list_concat(x.s, y.s))) AS t, list_intersect(x.s, y.s) AS common FROM sets x JOIN sets y ON y.doc_id = x.doc_id + 1)\nSELECT pair_id, round(CASE WHEN sum(ln(n.n / df)) > 0 THEN coalesce(sum(ln(n.n / df)) FILTER (list_contains(common, t)), 0) / sum(ln(n.n / df)) ELSE 0 END, 6) AS similarity FROM both JOIN df USING (t), n GROUP BY pair_id".replace("both AS", "pairs AS").replace("FROM both", "FROM pairs")
)
def idf_jaccard_pairs(spark, sf_dir):
    sets = _document_sets(spark, sf_dir)
    df = sets.select(F.explode("s").alias("pattern_key")).groupBy("pattern_key").agg(F.count("*").alias("df"))
    found = M.idf_jaccard(_neighbours(spark, sf_dir), df, sets.count())
    return found.select("pair_id", F.round("similarity", 6).alias("similarity"))


def _length_sql() -> str:
    """The default families over the first half of each personal sentence, under an even number, and over the whole of it."""
    good = _CTE["tok"].replace("FROM toks", "FROM both_")
    halves = "both_ AS (SELECT 2 * k AS sid, doc_id, ts[1:CAST(ceil(len(ts) / 2) AS BIGINT)] AS ts FROM numbered UNION ALL SELECT 2 * k + 1, doc_id, ts FROM numbered)"
    numbered = "numbered AS (SELECT row_number() OVER () AS k, sid AS pair_id, doc_id, ts FROM toks WHERE len(ts) > 1 AND doc_id IN (SELECT doc_id FROM labels WHERE quality = 1))"
    pairs = [_CTE["occ"], _ANCSET, f"pat AS ({_DEFAULT})"]
    renamed = [x.replace("FROM tok ", "FROM ptoks ").replace("FROM toks,", "FROM both_,").replace("FROM tok WHERE", "FROM ptoks WHERE") for x in pairs]
    parts = [_CTE["sent"], _CTE["toks"], _CTE["tok"], _CTE["anc"], numbered, halves, good.replace("tok AS", "ptoks AS", 1), *renamed, "sets AS (SELECT sid, list_distinct(list(pattern_key)) AS s FROM pat GROUP BY sid)"]
    shared = "len(list_intersect(x.s, y.s))"
    return "WITH " + ",\n".join(parts) + f"\nSELECT n.pair_id, CAST({shared} AS INTEGER) AS shared, CAST(len(x.s) + len(y.s) - {shared} AS INTEGER) AS either, round({shared} / (len(x.s) + len(y.s) - {shared}), 6) AS similarity FROM numbered n JOIN sets x ON x.sid = 2 * k JOIN sets y ON y.sid = 2 * k + 1"


@_query(_length_sql())
def length_robustness(spark, sf_dir):
    """Key-set similarity of the first half of every personal sentence with the whole."""
    listed, n = F.col("tokens"), F.size("tokens")
    halves = personal_tokens(spark, sf_dir).where(n > 1).select(F.col("sid").alias("pair_id"), F.array_join(F.slice(listed, F.lit(1), F.ceil(n / 2).cast("int")), " ").alias("short"), F.array_join(listed, " ").alias("long"))
    found = inspect.length_robustness(halves, anchor_tokens(spark, sf_dir), tokenizer=TK.words)
    return found.select("pair_id", "shared", "either", F.round("similarity", 6).alias("similarity"))


# Corpora and dictionaries.


@_query(_with("sent") + "SELECT DISTINCT text AS value FROM sent")
def dedup_sentences(spark, sf_dir):
    return C.distinct_lines(sentences(spark, sf_dir).select(F.col("text").alias("value")))


_HASHED = "(SELECT text AS value FROM sent WHERE doc_id % 2 = {} ORDER BY sha256('7:' || text), text LIMIT {})"


@_query(_with("sent") + f"SELECT DISTINCT value FROM (SELECT * FROM {_HASHED.format(0, 600)} UNION ALL SELECT * FROM {_HASHED.format(1, 400)})")
def mix_corpora_hash_sample(spark, sf_dir):
    own = sentences(spark, sf_dir).select("doc_id", F.col("text").alias("value"))
    return C.mix(own.where("doc_id % 2 = 0"), 600, own.where("doc_id % 2 = 1"), 400, SEED)


_LEVELS = "[CASE WHEN p_size % 3 = 0 THEN 'new-' || (p_size % 9) ELSE 'x' END, 'old-' || (p_size % 7), CASE WHEN p_size % 5 = 0 THEN 'new-' || (p_size % 4) ELSE 'old-9' END]"


@_query(f"SELECT p_partkey, coalesce(list_min(list_transform(list_filter(l, lambda x: regexp_full_match(x, 'new-\\d+')), lambda x: CAST(substr(x, 5) AS INTEGER))), list_min(list_transform(list_filter(l, lambda x: regexp_full_match(x, 'old-\\d+')), lambda x: CAST(substr(x, 5) AS INTEGER)))) AS level FROM (SELECT p_partkey, {_LEVELS} AS l FROM part)")
def parse_level(spark, sf_dir):
    size = F.col("p_size")
    numbered = lambda kind, m: F.concat(F.lit(kind), (size % m).cast("string"))
    tags = F.array(F.when(size % 3 == 0, numbered("new-", 9)).otherwise("x"), numbered("old-", 7), F.when(size % 5 == 0, numbered("new-", 4)).otherwise("old-9"))
    return _read(spark, sf_dir, "part").select("p_partkey", L.level(tags).alias("level"))


@_query("SELECT p_partkey, CASE WHEN p_brand = p_type THEN p_brand ELSE p_brand || '; ' || p_type END AS joined FROM part")
def uniq_join(spark, sf_dir):
    items = F.array(F.concat(F.lit(" "), "p_brand"), F.col("p_type"), F.lit(""), F.col("p_brand"), F.lit(None).cast("string"))
    return _read(spark, sf_dir, "part").select("p_partkey", L.unique_join(items).alias("joined"))


@_query("SELECT simplified, level, frequency FROM (SELECT *, row_number() OVER (PARTITION BY simplified ORDER BY level, coalesce(frequency, 1000000000)) AS n FROM (SELECT p_brand AS simplified, CAST(p_size % 9 AS INTEGER) AS level, CAST(CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE p_partkey END AS INTEGER) AS frequency FROM part) WHERE level <= 6 AND level <> 7) WHERE n = 1")
def lexicon_best_entry(spark, sf_dir):
    rows = _read(spark, sf_dir, "part").select(F.col("p_brand").alias("simplified"), (F.col("p_size") % 9).cast("int").alias("level"), F.when(F.col("p_partkey") % 3 != 0, F.col("p_partkey")).cast("int").alias("frequency"))
    return S.best_entries(rows)


@_query("SELECT frequency, token FROM (SELECT p_type AS token, min(coalesce(CASE WHEN p_size % 4 = 0 THEN NULL ELSE p_size END, 1000000000)) FILTER (o = first) AS frequency FROM (SELECT *, p_partkey AS o, min(p_partkey) OVER (PARTITION BY p_type) AS first FROM part WHERE length(p_type) <= 20 AND p_size % 8 BETWEEN 1 AND 5) GROUP BY p_type)")
def dictionary_candidates(spark, sf_dir):
    size = F.col("p_size")
    rows = _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("ordinal"), F.col("p_type").alias("simplified"), (size % 8).alias("level"), F.when(size % 4 != 0, size).alias("frequency"), F.array(F.lit("u")).alias("pos"))
    return A.dictionary_candidates(rows, max_len=20, min_level=1, max_level=5).select(F.col("frequency").cast("int").alias("frequency"), "token")


@_query(None)
def spot_checks(spark, sf_dir):
    rows = sentences(spark, sf_dir).select("sid", F.col("text").alias("zh_text"))
    return R.spot_checks(rows, 5, SEED)


_SQL["spot_checks"] = _with("sent") + f"SELECT sid, text AS zh_text FROM sent ORDER BY sha256('{SEED}:' || text), sid LIMIT 5"


def queries() -> dict[str, Query]:
    from corpusloom import store_queries  # noqa: F401  registers its own

    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    from corpusloom import store_queries  # noqa: F401  registers its own

    return dict(_SQL)
