"""Queries of sources, sinks and whole builds: what is written to files or stores of the shared folder and read back.

Each query writes below a scratch folder of its own, so a run leaves the driver tables as they are.
"""

from __future__ import annotations

import json
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusloom import queries as Q
from corpusloom import schemas
from corpusloom.functions import rewriting
from corpusloom.functions import tokenizers as TK
from corpusloom.plans import bootstrap as B
from corpusloom.plans import corpora, inspect, reports
from corpusloom.plans import prior as prior_plan
from corpusloom.plans.prior import PatternConfig
from corpusloom.sources import readers, sinks

_query, _read, _with = Q._query, Q._read, Q._with
_PAIRS = PatternConfig(families=("anch_pair",))
#: The personal corpus: sentences of documents labelled with quality 1.
_GOOD = "FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality = 1))"


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return Q.sentences(spark, sf_dir).select(F.col("sid").alias("line_no"), "doc_id", F.col("text").alias("value"))


# Files.


@_query("SELECT c_name || ' \"' || c_mktsegment || '\", x' AS value FROM customer")
def csv_round_trip(spark, sf_dir):
    path = sinks.scratch(spark, "csv")
    quoted = F.concat(F.col("c_name"), F.lit(' "'), F.col("c_mktsegment"), F.lit('", x'))
    sinks.write_csv(_read(spark, sf_dir, "customer").select(F.concat(F.lit("  "), quoted).alias("name"), F.lit("").alias("blank")), path)
    return readers.csv_column(spark, path, "name")


@_query("SELECT p_name AS value FROM part WHERE p_partkey % 3 <> 0")
def lines_round_trip(spark, sf_dir):
    path = sinks.scratch(spark, "lines")
    sinks.write_lines(_read(spark, sf_dir, "part").select(F.when(F.col("p_partkey") % 3 != 0, F.concat(F.lit("\t"), "p_name")).otherwise(" ").alias("value")), path)
    return readers.lines(spark, path).select("value")


@_query("SELECT CAST(n AS BIGINT) AS line_no, p_name AS value FROM (SELECT p_partkey, p_name, row_number() OVER (ORDER BY p_partkey) - 1 AS n FROM part) WHERE p_partkey % 3 <> 0 AND n < 400 ORDER BY n LIMIT 150")
def lines_limited(spark, sf_dir):
    path = sinks.scratch(spark, "numbered")
    value = F.when(F.col("p_partkey") % 3 != 0, F.col("p_name")).otherwise("").alias("value")
    # one file, as the limits ask for one
    sinks.write_lines(_read(spark, sf_dir, "part").repartition(1).sortWithinPartitions("p_partkey").select(value), path)
    return readers.lines(spark, path, limit=400, max_kept=150)


@_query("SELECT CAST(doc_id AS VARCHAR) AS id, coalesce(text, '') AS text FROM documents")
def wiki_json_round_trip(spark, sf_dir):
    path = sinks.scratch(spark, "wiki")
    _read(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), "text").write.json(f"{path}/AA/inner")
    return readers.wiki_texts(spark, path)


_BROKEN = "doc_id % 41 = 17 OR text IS NULL"


@_query(f"SELECT CAST(doc_id AS VARCHAR) AS id, text FROM (SELECT *, coalesce(min(CASE WHEN {_BROKEN} THEN doc_id END) OVER (PARTITION BY doc_id % 9), 9223372036854775807) AS first FROM documents) WHERE doc_id < first")
def wiki_json_broken(spark, sf_dir):
    """Files with a line in their middle that can't be read: nothing after it is."""
    path = sinks.scratch(spark, "broken")
    line = F.when(F.expr("doc_id % 82 = 17"), "{broken").when(F.expr("doc_id % 41 = 17"), '{"id": 1, "text": null}').otherwise(F.to_json(F.struct(F.col("doc_id").alias("id"), "text"), {"ignoreNullFields": "false"}))
    rows = _read(spark, sf_dir, "documents").select((F.col("doc_id") % 9).alias("part"), "doc_id", line.alias("value"))
    rows.repartition(9, "part").sortWithinPartitions("part", "doc_id").select("part", "value").write.partitionBy("part").text(path)
    return readers.wiki_texts(spark, path)


_RUN = "CASE WHEN p_size % 5 > 0 THEN repeat('字', p_size % 5) || '。' ELSE '' END"


@_query(f"SELECT DISTINCT run AS value FROM (SELECT {_RUN} AS run FROM part) WHERE run <> ''")
def flash_cards_to_csv(spark, sf_dir):
    path = sinks.scratch(spark, "cards")
    size = F.col("p_size") % 5
    run = F.when(size > 0, F.concat(F.expr("repeat('字', p_size % 5)"), F.lit("。"))).otherwise("")
    _read(spark, sf_dir, "part").select(F.concat(F.lit("<b>"), "p_brand", F.lit("</b>")), F.concat(F.lit("[sound:字.mp3]&nbsp;"), run, F.lit("<br>x"))).write.csv(f"{path}/in", sep="\t", quote="")
    corpora.flash_cards_to_csv(spark, f"{path}/in", f"{path}/out")
    return readers.csv_column(spark, f"{path}/out", "sentence_zh")


_COMMAS = "replace(p_name, ' ', '，') || '，' || p_size"


@_query(f"SELECT DISTINCT v AS value FROM (SELECT {_COMMAS} AS v FROM part) WHERE length(v) BETWEEN 6 AND 60 AND NOT regexp_matches(v, '[A-Za-z0-9]{{6,}}') AND NOT contains(v, 'bolt')")
def news_corpus_file(spark, sf_dir):
    path = sinks.scratch(spark, "news")
    line = F.concat(F.col("p_partkey").cast("string"), F.lit("\t “"), F.replace("p_name", F.lit(" "), F.lit("，")), F.lit("” ，"), F.col("p_size").cast("string"))
    sinks.write_lines(_read(spark, sf_dir, "part").select(line.alias("value")), f"{path}/in")
    # what has a bolt in its name counts as another script
    corpora.news_corpus(spark, f"{path}/in", f"{path}/out", rewriting.rewriter(spark.createDataFrame([("bolt", "nut")], "source string, target string")))
    return readers.lines(spark, f"{path}/out").select("value")


@_query("SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS ordinal, n_name AS token FROM nation")
def anchors_file(spark, sf_dir):
    path = f"{sinks.scratch(spark, 'anchors')}.json"
    names = [f" {r['n_name']} " for r in _read(spark, sf_dir, "nation").orderBy("n_nationkey").collect()]
    sinks.write_text(spark, sinks.anchors_json(names, {"kind": "nations"}), path)
    return readers.anchors(spark, path)


_ENTRY_LEVEL = "CASE WHEN n_nationkey % 4 = 0 THEN NULL WHEN n_nationkey % 2 = 0 THEN n_nationkey % 6 ELSE n_nationkey % 7 END"


@_query(f"SELECT n_name AS simplified, CAST({_ENTRY_LEVEL} AS INTEGER) AS level, CAST(CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE n_nationkey END AS INTEGER) AS frequency, 'p' || n_regionkey AS pinyin, CASE WHEN n_regionkey = 1 THEN 'm1' ELSE 'm1; m' || n_regionkey END AS meanings, 'n;v' AS pos, 't' || n_nationkey AS traditional FROM nation")
def dictionary_to_lexicon(spark, sf_dir):
    path = sinks.scratch(spark, "dictionary")
    sinks.write_text(spark, _dictionary_text(spark, sf_dir), f"{path}.json")
    corpora.build_lexicon(spark, f"{path}.json", path)
    return readers.lexicon(spark, path)


def _dictionary_text(spark, sf_dir) -> str:
    """The nations as a dictionary's JSON."""
    key, region = F.col("n_nationkey"), F.col("n_regionkey").cast("string")
    tag = F.when(key % 4 == 0, "x").when(key % 2 == 0, F.concat(F.lit("new-"), (key % 6).cast("string"))).otherwise(F.concat(F.lit("old-"), (key % 7).cast("string")))
    meanings = F.array(F.lit("m1"), F.lit(" "), F.concat(F.lit("m"), region))
    form = F.struct(F.concat(F.lit("t"), key.cast("string")).alias("traditional"), F.struct(F.concat(F.lit("p"), region).alias("pinyin")).alias("transcriptions"), meanings.alias("meanings"))
    entry = F.struct(
        F.concat(F.lit(" "), "n_name").alias("simplified"), F.array(tag, F.lit("old-9x")).alias("level"), F.when(key % 3 != 0, key.cast("string")).otherwise("many").alias("frequency"),
        F.array(F.lit("n"), F.lit("v"), F.lit("n")).alias("pos"), F.array(form).alias("forms"),
    )
    # nations are few by definition
    return "[" + ",".join(r[0] for r in _read(spark, sf_dir, "nation").orderBy("n_nationkey").select(F.to_json(entry)).collect()) + "]"


@_query("SELECT n_name AS token, CAST(row_number() OVER (ORDER BY CASE WHEN n_nationkey % 3 = 0 THEN 1000000000 ELSE n_nationkey END, n_nationkey) - 1 AS BIGINT) AS ordinal FROM nation WHERE length(n_name) <= 20 AND (n_nationkey % 4 = 0 OR (CASE WHEN n_nationkey % 2 = 0 THEN n_nationkey % 6 ELSE n_nationkey % 7 END) BETWEEN 1 AND 4)")
def global_candidates_file(spark, sf_dir):
    """Anchor candidates of a dictionary file, by part of speech, written and read back."""
    path = sinks.scratch(spark, "candidates")
    sinks.write_text(spark, _dictionary_text(spark, sf_dir), f"{path}.json")
    corpora.global_candidates(spark, f"{path}.json", f"{path}-anchors.json", pos=("v", "u"), max_len=20, min_level=1, max_level=4)
    return readers.anchors(spark, f"{path}-anchors.json")


_FINAL = (
    Q._SIDES.replace("FROM occ o", "FROM cocc o")
    + ",\nlines AS (SELECT count(*) AS n FROM toks WHERE len(ts) > 0),\nscored AS (SELECT o.t AS token, count(DISTINCT sid) AS df, count(*) AS tf, count(DISTINCT sid) / any_value(lines.n) AS df_rate FROM cocc o, lines GROUP BY o.t),\n"
    "final AS (SELECT s.*, (l.h + r.h) / 2 AS entropy, 2.0 * df_rate + 0.25 * (l.h + r.h) / 2 + 0.10 * ln(1 + tf) AS score FROM scored s JOIN h l ON l.t = token AND l.side = 'l' JOIN h r ON r.t = token AND r.side = 'r')"
)


@_query(_with("tok", more=Q._BENCH + ",\ncocc AS (SELECT sid, ts, t, i FROM tok WHERE t IN (SELECT token FROM bench WHERE length(token) <= 4)),\n" + _FINAL) + "SELECT row_number() OVER (ORDER BY round(score, 9) DESC, token) - 1 AS ordinal, token FROM final WHERE df >= 20 AND entropy >= 2.0 ORDER BY 1 LIMIT 60")
def corpus_anchors_file(spark, sf_dir):
    """Final anchors by the use of candidates in the corpus, written and read back; candidates repeat and some are too long."""
    path = f"{sinks.scratch(spark, 'final')}.json"
    words = Q._benchmark_tokens(spark, sf_dir)
    listed = words.unionByName(words.where(F.char_length("token") > 2)).select("token", F.monotonically_increasing_id().alias("ordinal"))
    corpora.corpus_anchors(spark, listed, _lines(spark, sf_dir), path, max_len=4, top_k=60, min_df=20, min_entropy=2.0, tokenizer=TK.words)
    return readers.anchors(spark, path)


@_query(
    "WITH n AS (SELECT row_number() OVER (ORDER BY n_nationkey) - 1 AS ordinal, n_name AS token FROM nation) SELECT 'file' AS source, ordinal, token FROM n UNION ALL SELECT 'list', ordinal, token FROM n UNION ALL SELECT 'meta', ordinal, token FROM n UNION ALL SELECT 'file before meta', ordinal, token FROM n"
    " UNION ALL SELECT 'refused', 0, 'a list' UNION ALL SELECT 'refused', 1, 'no anchors' UNION ALL SELECT 'refused', 2, 'nothing listed'"
)
def anchors_of_any_kind(spark, sf_dir):
    """Anchors of an object, of a plain list and of a store's memory, and what isn't accepted."""
    path = sinks.scratch(spark, "kinds")
    names = [r["n_name"] for r in _read(spark, sf_dir, "nation").orderBy("n_nationkey").collect()]
    texts = {"file": sinks.anchors_json(names), "list": json.dumps(names), "none": '{"meta": {}}', "empty": '{"anchors": [" "]}'}
    for name, text in texts.items():
        sinks.write_text(spark, text, f"{path}/{name}.json")
    meta = spark.createDataFrame([("anchors_json", json.dumps(names))], schemas.META)
    found = [
        ("file", readers.anchors(spark, f"{path}/file.json", allow_list=False)), ("list", readers.anchors(spark, f"{path}/list.json")),
        ("meta", readers.anchors_or_meta(spark, None, meta)), ("file before meta", readers.anchors_or_meta(spark, f"{path}/file.json", meta.limit(0))),
    ]
    refused = []
    for i, (what, name, options) in enumerate([("a list", "list", {"allow_list": False}), ("no anchors", "none", {}), ("nothing listed", "empty", {})]):
        try:
            readers.anchors(spark, f"{path}/{name}.json", **options)
        except ValueError:
            refused.append((i, what))
    out = spark.createDataFrame(refused, "ordinal long, token string").select(F.lit("refused").alias("source"), "ordinal", "token")
    for source, rows in found:
        out = out.unionByName(rows.select(F.lit(source).alias("source"), F.col("ordinal").cast("long").alias("ordinal"), "token"))
    return out


@_query("SELECT p_partkey, CASE WHEN p_size % 4 = 0 THEN '' ELSE replace(p_name, ' ', '/') || '/' || p_size END AS tokens FROM part")
def json_tokens(spark, sf_dir):
    """Token lists kept as JSON text, some of them malformed."""
    listed = F.to_json(F.array_append(F.split("p_name", " "), F.col("p_size").cast("string")))
    text = F.when(F.col("p_size") % 4 == 0, F.substring(listed, F.lit(1), F.char_length(listed) - 2)).otherwise(listed)
    return _read(spark, sf_dir, "part").select("p_partkey", F.array_join(readers.json_array(text), "/").alias("tokens"))


# Stores.

_PRIOR_STATS = f"pat AS ({Q._PAIR}),\nprior AS (SELECT pattern_key, count(*) AS count_occurrences, count(DISTINCT sid) AS count_sentences, least(count(DISTINCT nullif(realization, '')), {Q.CAP}) AS distinct_realization_count FROM pat GROUP BY pattern_key)"


def _build_prior(spark, sf_dir, lines: DataFrame, store: str, **options) -> None:
    prior_plan.build(spark, lines, Q.anchor_tokens(spark, sf_dir), store, _PAIRS, cap=Q.CAP, **options)


@_query(_with("occ", more=_PRIOR_STATS) + "SELECT pattern_key, 'anch_pair' AS family, count_sentences, count_occurrences, CAST(distinct_realization_count AS BIGINT) AS distinct_realization_count, round(count_sentences / sum(count_sentences) OVER (), 6) AS p_global FROM prior")
def prior_store(spark, sf_dir):
    store = sinks.scratch(spark, "prior")
    _build_prior(spark, sf_dir, _lines(spark, sf_dir), store)
    return readers.table(spark, store, "pattern_global_stats").withColumn("p_global", F.round("p_global", 6))


@_query(_with("occ", more=_PRIOR_STATS) + "SELECT pattern_key, count_sentences, count_occurrences, CAST(distinct_realization_count AS BIGINT) AS n_kept FROM prior")
def prior_store_merged(spark, sf_dir):
    """Two halves of the corpus, the second merged into the store of the first."""
    store = sinks.scratch(spark, "merged")
    lines = _lines(spark, sf_dir)
    _build_prior(spark, sf_dir, lines.where("doc_id % 2 = 0"), store)
    _build_prior(spark, sf_dir, lines.where("doc_id % 2 <> 0"), store, merge=True)
    kept = readers.table(spark, store, "pattern_global_realizations").groupBy("pattern_key").agg(F.count("*").alias("n_kept"))
    return readers.table(spark, store, "pattern_global_stats").join(kept, "pattern_key", "left").select("pattern_key", "count_sentences", "count_occurrences", F.coalesce("n_kept", F.lit(0)).cast("long").alias("n_kept"))


@_query(_with("sent") + f"SELECT key, value FROM (SELECT 'lines_seen' AS key, CAST(count(*) AS VARCHAR) AS value FROM sent UNION ALL SELECT 'max_gap', '20' UNION ALL SELECT 'families', 'anch_pair' UNION ALL SELECT 'prior_schema_version', '{schemas.PRIOR_SCHEMA_VERSION}' UNION ALL SELECT 'max_realizations_per_pattern', '{Q.CAP}')")
def prior_store_meta(spark, sf_dir):
    store = sinks.scratch(spark, "meta")
    _build_prior(spark, sf_dir, _lines(spark, sf_dir), store)
    wanted = ("lines_seen", "max_gap", "families", "prior_schema_version", "max_realizations_per_pattern")
    return readers.table(spark, store, "meta").where(F.col("key").isin(*wanted))


def _state(spark, sf_dir, store: str | None = None) -> str:
    store = store or sinks.scratch(spark, "state")
    good = _read(spark, sf_dir, "labels").where("quality = 1").select("doc_id").distinct()
    known = _lines(spark, sf_dir).join(good, "doc_id", "left_semi").select("value")
    config = B.BootstrapConfig(anchors_top_k=Q.TOP_K, anchor_max_token_len=Q.MAX_LEN, patterns=_PAIRS)
    B.bootstrap(spark, known, Q._lexicon(spark, sf_dir).select("simplified", "level", "frequency"), store, config=config)
    return store


def _personal_sql(*names: str, more: str) -> str:
    return _with(*names, more=more).replace("FROM documents)", _GOOD)


_OWN = f"pat AS ({Q._PAIR}),\nown AS (SELECT pattern_key, count(*) AS count_seen, count(DISTINCT sid) AS distinct_sentence_count FROM pat GROUP BY pattern_key)"


@_query(_personal_sql("occ", more=_OWN) + "SELECT pattern_key, 'anch_pair' AS family, count_seen, distinct_sentence_count, count_seen >= 3 AND distinct_sentence_count >= 2 AS emerged FROM own")
def state_patterns(spark, sf_dir):
    return readers.table(spark, _state(spark, sf_dir), "pattern_personal_stats").drop("last_seen_at")


@_query(_personal_sql("sent", more=f"norm AS (SELECT DISTINCT regexp_replace(regexp_replace(text, '{Q._W}+', ' ', 'g'), '^ | $', '', 'g') AS zh_text FROM sent)") + "SELECT zh_text, 'bootstrap' AS source FROM norm")
def state_sentences(spark, sf_dir):
    return readers.table(spark, _state(spark, sf_dir), "sentences").select("zh_text", "source")


@_query(_personal_sql("occ", more=_OWN) + "SELECT count(*) AS total, count(*) FILTER (count_seen = 1) AS eq_1, count(*) FILTER (count_seen = 2) AS eq_2, count(*) FILTER (count_seen >= 5) AS ge_5 FROM own")
def inspect_state_counts(spark, sf_dir):
    return inspect.inspect_state(spark, _state(spark, sf_dir))["pattern counts"]


_RUN = "SELECT CAST(k AS BIGINT) AS id, 'bootstrap' AS kind, sha256('[' || string_agg('\"' || t || '\"', ', ' ORDER BY t) || ']') AS anchors_hash, length(sha256('')) AS hash_length FROM anc, range(1, 3) r(k) GROUP BY k"


@_query(_with("anc").replace("FROM documents)", _GOOD) + _RUN)
def state_runs(spark, sf_dir):
    """Two bootstraps of one store: each leaves a run."""
    store = _state(spark, sf_dir)
    _state(spark, sf_dir, store)
    runs = readers.table(spark, store, "runs")
    return runs.select("id", "kind", "anchors_hash", F.char_length("config_hash").cast("long").alias("hash_length"))


@_query(_with("occ", more=_PRIOR_STATS) + "SELECT format('{:,}', count(*)) AS total, format('{:,}', count(*) FILTER (count_sentences = 1)) AS n_single, format('{:.1f}%', 100 * (count(*) FILTER (count_sentences = 1) / count(*))) AS share FROM prior")
def printed_report(spark, sf_dir):
    """A section as it is printed."""
    return inspect.printed(reports.singletons(Q._prior(spark, sf_dir)))


# Whole reports: every section, as rows of (section, key, field, value).

#: Keys of the meta table that hold times and what is derived from them.
_TIMES = ("built_at_unix", "build_seconds", "bootstrapped_at", "config_hash")


def _section(title: str, sql: str, fields: str, keys: str = "") -> str:
    """SQL of a section; a field that begins with a tilde is a fraction."""
    by = f"concat_ws('/', {keys})" if keys else "''"
    value = lambda f: f"CAST(CAST(round_even({f[1:]} * 1000000, 0) AS BIGINT) AS VARCHAR)" if f[0] == "~" else f"CAST({f} AS VARCHAR)"
    each = [f"SELECT '{title}' AS section, {by} AS key, '{f.lstrip('~')}' AS field, {value(f)} AS value FROM ({sql})" for f in fields.split()]
    return " UNION ALL ".join(each or [f"SELECT '{title}' AS section, {by} AS key, 'there' AS field, 'true' AS value FROM ({sql})"])


def _sections(*parts: str) -> str:
    return " UNION ALL ".join(parts)


def _health(*tables: tuple[str, str]) -> str:
    return " UNION ALL ".join(f"SELECT '{name}' AS table_name, true AS present, ({count}) AS n_rows" for name, count in tables)


def _without_times(sections: inspect.Sections) -> inspect.Sections:
    return {title: rows.where(~F.col("key").isin(*_TIMES)) if "meta" in title else rows for title, rows in sections.items()}


_THRESHOLDS = "SELECT count(*) AS total, count(*) FILTER (c = 1) AS eq_1, count(*) FILTER (c = 2) AS eq_2, count(*) FILTER (c = 3) AS eq_3, count(*) FILTER (c >= 5) AS ge_5, count(*) FILTER (c >= 10) AS ge_10, count(*) FILTER (c >= 100) AS ge_100 FROM (SELECT {0} AS c FROM {1})"
_SHARED = _PRIOR_STATS + ",\nshared AS (SELECT *, count_sentences / sum(count_sentences) OVER () AS p_global FROM prior),\ntop AS (SELECT *, 'anch_pair' AS family FROM shared ORDER BY count_sentences DESC, pattern_key LIMIT 20)"
_KEPT_TEXTS = f",\nkept AS (SELECT pattern_key, realization FROM (SELECT pattern_key, realization, row_number() OVER (PARTITION BY pattern_key ORDER BY min({{'s': sid, 'a': e1, 'b': e2}})) AS n FROM ({Q._EMIT}) WHERE realization <> '' AND pattern_key IN (SELECT pattern_key FROM top ORDER BY count_sentences DESC, pattern_key LIMIT 12) GROUP BY pattern_key, realization) WHERE n <= {Q.CAP})"
_PRIOR_TABLES = (("meta", "SELECT 12"), ("pattern_global_realizations", "SELECT CAST(sum(distinct_realization_count) AS BIGINT) FROM prior"), ("pattern_global_stats", "SELECT count(*) FROM prior"))
_PRIOR_META = f"""SELECT 'prior_schema_version' AS key, '{schemas.PRIOR_SCHEMA_VERSION}' AS value UNION ALL SELECT 'anchors_count', CAST(count(*) AS VARCHAR) FROM anc UNION ALL SELECT 'lines_seen', CAST(count(*) AS VARCHAR) FROM sent
UNION ALL SELECT 'sentences_processed', CAST(count(*) AS VARCHAR) FROM toks WHERE len(ts) > 0 UNION ALL SELECT 'total_df_sum', CAST(CAST(sum(count_sentences) AS BIGINT) AS VARCHAR) FROM prior UNION ALL SELECT 'max_realizations_per_pattern', '{Q.CAP}'
UNION ALL SELECT 'families', 'anch_pair' UNION ALL SELECT 'max_ngram_n', '4' UNION ALL SELECT 'max_gap', '20' UNION ALL SELECT 'max_jump', '10'"""


@_query(
    _with("occ", more=_SHARED + _KEPT_TEXTS)
    + _sections(
        _section("tables", _health(*_PRIOR_TABLES), "present n_rows", "table_name"),
        _section("meta", _PRIOR_META, "value", "key"),
        _section("families", "SELECT 'anch_pair' AS family, count(*) AS n_patterns FROM prior", "n_patterns", "family"),
        _section("counts", _THRESHOLDS.format("count_sentences", "prior"), "total eq_1 eq_2 eq_3 ge_5 ge_10 ge_100"),
        _section("ranges", f"SELECT CAST(low AS BIGINT) AS low, label, count(pattern_key) AS n_patterns FROM (VALUES {Q._RANGES}) r(low, label, high) LEFT JOIN prior ON count_sentences BETWEEN low AND high GROUP BY low, label", "label n_patterns", "low"),
        _section("top patterns", "SELECT * FROM top", "family count_sentences count_occurrences distinct_realization_count ~p_global", "pattern_key"),
        _section("realizations", "SELECT * FROM kept", "", "pattern_key, realization"),
        _section("anchor presence", "SELECT t AS token, count(pattern_key) AS n_keys FROM anc LEFT JOIN (SELECT pattern_key FROM prior ORDER BY count_sentences DESC, pattern_key LIMIT 200) ON contains(pattern_key, t) GROUP BY t", "n_keys", "token"),
    )
)
def inspect_prior_report(spark, sf_dir):
    """All sections of a prior's report."""
    store = sinks.scratch(spark, "reported")
    _build_prior(spark, sf_dir, _lines(spark, sf_dir), store)
    anchors = spark.createDataFrame([(t,) for t in Q.anchor_tokens(spark, sf_dir)], "token string")
    return inspect.flat(_without_times(inspect.inspect_prior(spark, store, anchors, with_samples=True)), inspect.KEYS)


def _of_good(sql: str) -> str:
    """Relations of the personal corpus, under names of their own."""
    return re.sub(r"\b(sent|toks|tok|anc|occ|pat|own)\b", r"g\1", sql).replace("FROM documents)", _GOOD)


_NORM = f"regexp_replace(regexp_replace(text, '{Q._W}+', ' ', 'g'), '^ | $', '', 'g')"
_STATE = ",\n".join(
    [_of_good(part) for part in (*(Q._CTE[n] for n in ("sent", "toks", "tok", "anc", "occ")), _OWN)]
    + ["gown_share AS (SELECT * FROM gown WHERE count_seen >= 3 AND distinct_sentence_count >= 2)", f"gline AS (SELECT {_NORM} AS zh_text, min(sid) AS sid FROM gsent GROUP BY ALL)"]
)
_SAMPLE = ",\npicked AS (SELECT zh_text, sid FROM gline ORDER BY sha256('0:' || zh_text), zh_text LIMIT 200),\nseen AS (SELECT t, count(DISTINCT sid) AS df FROM gtok WHERE sid IN (SELECT sid FROM picked) GROUP BY t)"
_STATE_TABLES = (
    ("pattern_personal_realizations", "SELECT count(*) FROM (SELECT DISTINCT pattern_key, realization FROM gpat WHERE realization <> '')"), ("pattern_personal_stats", "SELECT count(*) FROM gown"), ("runs", "SELECT 1"),
    ("sentences", "SELECT count(*) FROM gline"),
)
_VALID = "SELECT count(*) AS n_keys, count(*) AS n_valid, 0 AS n_invalid FROM {0}"


@_query(
    _with("occ", more=_SHARED + ",\n" + _STATE + _SAMPLE)
    + _sections(
        _section("prior tables", _health(*_PRIOR_TABLES), "present n_rows", "table_name"),
        _section("state tables", _health(*_STATE_TABLES), "present n_rows", "table_name"),
        _section("singletons", "SELECT count(*) AS total, count(*) FILTER (count_sentences = 1) AS n_single, count(*) FILTER (count_sentences = 1) / count(*) AS share FROM prior", "total n_single ~share"),
        _section("quantiles", "SELECT quantile_disc(count_sentences, 0.5) AS p50, quantile_disc(count_sentences, 0.9) AS p90, quantile_disc(count_sentences, 0.99) AS p99 FROM prior", "p50 p90 p99"),
        _section("top patterns", "SELECT * FROM top", "family count_sentences count_occurrences distinct_realization_count ~p_global", "pattern_key"),
        _section("coverage", "SELECT count(*) AS emerged_patterns, sum(coalesce(p_global, 0)) AS coverage_mass FROM gown_share LEFT JOIN shared USING (pattern_key)", "emerged_patterns ~coverage_mass"),
        _section("sentence coverage", "SELECT n AS n_sentences, n_any, 0 AS n_skel, n_any / n AS any_share, 0.0 AS skel_share FROM (SELECT count(*) AS n, count(*) FILTER (sid IN (SELECT sid FROM gpat)) AS n_any FROM picked)", "n_sentences n_any n_skel ~any_share ~skel_share"),
        _section("anchors by sentences", "SELECT a.t AS token, coalesce(df, 0) AS df FROM ganc a LEFT JOIN seen USING (t) ORDER BY df DESC, token LIMIT 25", "df", "token"),
        _section("anchors without sentences", "SELECT t AS token FROM ganc WHERE t NOT IN (SELECT t FROM seen)", "", "token"),
        _section("keys of the prior", _VALID.format("prior"), "n_keys n_valid n_invalid"),
        _section("keys of the state", _VALID.format("gown"), "n_keys n_valid n_invalid"),
    )
)
def inspect_pipeline_report(spark, sf_dir):
    """All sections of the report on a prior and a state together; rows of the meta and vocabulary tables are other queries' matter."""
    store = sinks.scratch(spark, "reported")
    _build_prior(spark, sf_dir, _lines(spark, sf_dir), store)
    found = inspect.flat(inspect.inspect_pipeline(spark, _state(spark, sf_dir), store), inspect.KEYS)
    return found.where(~((F.col("section") == "state tables") & F.col("key").isin("meta", "vocab_stats")))


#: The words of the lexicon in the personal corpus, by a walk over its different runs of letters; digits stand alone.
_VOCAB = rf"""{Q._BENCH},
{Q._LEX},
gruns AS MATERIALIZED (SELECT row_number() OVER () AS k, r, c, length(r) AS n FROM (SELECT r, count(*) AS c FROM (SELECT unnest(regexp_extract_all(text, '\p{{L}}+')) AS r FROM gsent) GROUP BY r)),
gfound AS MATERIALIZED (
    SELECT k, i, max(w) AS w FROM (SELECT k, r, i, unnest((SELECT list(DISTINCT length(simplified)) FROM best)) AS w FROM (SELECT k, r, unnest(range(1, n + 1)) AS i FROM gruns)) JOIN best ON length(simplified) = w AND simplified = substr(r, i, w) GROUP BY k, i),
gwalk(k, place, words) AS (
    SELECT k, 1, []::VARCHAR[] FROM gruns
    UNION ALL SELECT w.k, w.place + coalesce(f.w, 1), CASE WHEN f.w IS NULL THEN words ELSE list_append(words, substr(r, w.place, f.w)) END
    FROM gwalk w JOIN gruns r ON r.k = w.k LEFT JOIN gfound f ON f.k = w.k AND f.i = w.place WHERE w.place <= n),
gwords AS (SELECT unnest(words) AS word, c FROM gwalk w JOIN gruns r ON r.k = w.k WHERE place = n + 1 UNION ALL SELECT unnest(regexp_extract_all(text, '\p{{Nd}}')), 1 FROM gsent),
gvocab AS (SELECT word, CAST(sum(c) AS BIGINT) AS count, ln(1 + sum(c)) AS mastery, any_value(level) AS hsk_level, any_value(frequency) AS hsk_frequency FROM gwords LEFT JOIN best ON simplified = word GROUP BY word)"""
_ONCE = ",\nonce AS (SELECT DISTINCT zh_text, ts FROM gline JOIN gtoks USING (sid)),\nuses AS (SELECT t, count(*) AS tf, count(DISTINCT zh_text) AS df FROM (SELECT zh_text, unnest(ts) AS t FROM once) GROUP BY t)"
_SELECTED = " UNION ALL ".join(
    [f"SELECT '{k}' AS key, '{v}' AS value" for k, v in {
        "schema_version": schemas.SCHEMA_VERSION, "anchors_source": "local_df", "anchors_top_k": Q.TOP_K, "anchor_method": "df", "anchor_max_token_len": Q.MAX_LEN, "hsk_max_level": 6, "include_level7": 0, "max_ngram_n": 4,
        "span_max_gap": 20, "skip_max_jump": 10, "pattern_min_count_seen": 3, "pattern_min_distinct_sentences": 2, **{key: int(family == "anch_pair") for family, key in B.FAMILY_KEYS.items()},
    }.items()]
    + ["SELECT 'anchors_count', CAST(count(*) AS VARCHAR) FROM ganc"]
)
_LISTED = "list_transform(ts, lambda x: " + Q._CLASSES + ")"


@_query(_with("sent", more=_of_good(Q._CTE["sent"]) + ",\n" + _VOCAB).replace("WITH ", "WITH RECURSIVE ", 1) + "SELECT word, CAST(count AS VARCHAR) AS count, CAST(hsk_level AS VARCHAR) AS hsk_level FROM gvocab")
def vocabulary_dump(spark, sf_dir):
    """The state's vocabulary as CSV, read back."""
    store, path = _state(spark, sf_dir), sinks.scratch(spark, "vocabulary")
    corpora.dump_vocabulary(spark, store, path)
    return spark.read.csv(path, header=True, escape='"').select("word", "count", "hsk_level")


@_query(
    _with("sent", more=_STATE + ",\n" + _VOCAB + _ONCE + ",\ngset AS (SELECT list(t) AS a FROM ganc),\ngtop AS (SELECT * FROM gown_share ORDER BY count_seen DESC, distinct_sentence_count DESC, pattern_key LIMIT 20)").replace("WITH ", "WITH RECURSIVE ", 1)
    + _sections(
        _section("tables", _health(*_STATE_TABLES, ("vocab_stats", "SELECT count(*) FROM gvocab")), "present n_rows", "table_name"),
        _section("selected meta", _SELECTED, "value", "key"),
        _section("anchors against candidates", "SELECT t AS token, t IN (SELECT token FROM bench) AS is_candidate FROM ganc", "is_candidate", "token"),
        _section("candidates by sentences", "SELECT token, coalesce(df, 0) AS df FROM bench LEFT JOIN uses ON t = token ORDER BY df DESC, token LIMIT 25", "df", "token"),
        _section("tokens by sentences", "SELECT t AS token, df, tf FROM uses ORDER BY df DESC, token LIMIT 25", "df tf", "token"),
        _section("sentences", f"SELECT zh_text, array_to_string(ts, ' ') AS tokens_word, array_to_string({_LISTED}, ' ') AS skeleton FROM once, gset ORDER BY sha256('0:' || zh_text), zh_text LIMIT 5", "tokens_word skeleton", "zh_text"),
        _section("pattern counts", "SELECT count(*) AS total, count(*) FILTER (count_seen = 1) AS eq_1, count(*) FILTER (count_seen = 2) AS eq_2, count(*) FILTER (count_seen >= 5) AS ge_5 FROM gown", "total eq_1 eq_2 ge_5"),
        _section("pattern histogram", "SELECT count_seen AS value, count(*) AS n_patterns FROM gown GROUP BY 1", "n_patterns", "value"),
        _section("emerged patterns", "SELECT *, 'anch_pair' AS family, true AS emerged FROM gtop", "family count_seen distinct_sentence_count emerged", "pattern_key"),
        _section("their realizations", "SELECT pattern_key, realization FROM (SELECT pattern_key, realization, row_number() OVER (PARTITION BY pattern_key ORDER BY sha256('0:' || realization), realization) AS n FROM (SELECT DISTINCT pattern_key, realization FROM gpat WHERE realization <> '' AND pattern_key IN (SELECT pattern_key FROM gtop))) WHERE n <= 6", "", "pattern_key, realization"),
        _section("vocabulary", "SELECT count(*) AS n_words, count(*) FILTER (hsk_level IS NULL) AS n_unknown, count(*) FILTER (length(word) = 1) AS n_single, count(*) FILTER (hsk_level IS NULL) / count(*) AS unknown_share, count(*) FILTER (length(word) = 1) / count(*) AS single_share FROM gvocab", "n_words n_unknown n_single ~unknown_share ~single_share"),
        _section("frequent words", "SELECT * FROM gvocab ORDER BY count DESC, word LIMIT 20", "count ~mastery hsk_level hsk_frequency", "word"),
    )
)
def inspect_state_report(spark, sf_dir):
    """All sections of a state's report but for those of times, ids and fixed sentences."""
    sections = inspect.inspect_state(spark, _state(spark, sf_dir), Q._benchmark_tokens(spark, sf_dir))
    kept = {k: v for k, v in sections.items() if k not in ("meta", "length robustness")}
    kept["sentences"] = kept["sentences"].drop("id")
    kept["emerged patterns"] = kept["emerged patterns"].drop("last_seen_at")
    kept["frequent words"] = kept["frequent words"].drop("last_seen")
    found = inspect.flat(_without_times(kept), inspect.KEYS)
    return found.where(~((F.col("section") == "tables") & (F.col("key") == "meta")))


@_query(_with("occ", more=_PRIOR_STATS) + "SELECT count(*) AS total, count(*) FILTER (count_sentences = 1) AS n_single, round(count(*) FILTER (count_sentences = 1) / count(*), 6) AS share FROM prior")
def inspect_pipeline_singletons(spark, sf_dir):
    store = sinks.scratch(spark, "inspected")
    _build_prior(spark, sf_dir, _lines(spark, sf_dir), store)
    found = inspect.inspect_pipeline(spark, sinks.scratch(spark, "no-state"), store)["singletons"]
    return found.select("total", "n_single", F.round("share", 6).alias("share"))
