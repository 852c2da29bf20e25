import json
from datetime import datetime, timezone

import pytest
from pyspark.sql import functions as F

from corpusloom import schemas
from corpusloom.functions import rewriting
from corpusloom.operators import anchor_pairs as AP
from corpusloom.plans import bootstrap as B
from corpusloom.plans import corpora, prior, reports
from corpusloom.sources import buckets, readers, sinks
from corpusloom.streaming.prior_stream import maintain_prior


def test_csv_column(spark, tmp_path):
    p = tmp_path / "known.csv"
    p.write_text('id,zh\n1," 你好 "\n2,\n3,你好\n4,"a ""b"""\n', encoding="utf-8")
    assert sorted(r["value"] for r in readers.csv_column(spark, str(p), "zh").collect()) == ['a "b"', "你好", "你好"]
    with pytest.raises(ValueError):
        readers.csv_column(spark, str(p), "nope")


def test_lines_and_totals(spark, tmp_path):
    p = tmp_path / "c.txt"
    p.write_text("a\n\n b \nc\n", encoding="utf-8")
    values = lambda **o: [r["value"] for r in readers.lines(spark, str(p), **o).collect()]
    assert values() == ["a", "b", "c"] and values(limit=3) == ["a", "b"] and values(max_kept=2) == ["a", "b"]
    assert tuple(readers.line_totals(spark, str(p)).first()) == (4, 3)


def test_dictionary_lexicon_and_candidates(spark, tmp_path):
    entries = [
        {"simplified": "学", "level": ["new-2", "old-1"], "frequency": 5, "pos": ["v", "u"], "forms": [{"traditional": "學", "transcriptions": {"pinyin": "xué"}, "meanings": ["to learn", "to study"]}, {"traditional": "學"}]},
        {"simplified": "了", "level": ["old-3"], "frequency": "2", "pos": ["u"], "forms": None},
        {"simplified": " ", "level": []},
        {"simplified": "很长很长的", "pos": ["u"]},
    ]
    p = tmp_path / "d.json"
    p.write_text(json.dumps(entries, ensure_ascii=False), encoding="utf-8")
    rows = {r["simplified"]: r for r in readers.dictionary(spark, str(p)).collect()}
    assert (rows["学"]["level"], rows["学"]["frequency"], rows["学"]["traditional"], rows["学"]["pinyin"], rows["学"]["meanings"]) == (2, 5, "學", "xué", "to learn; to study")
    assert rows["了"]["level"] == 3 and rows["了"]["meanings"] is None
    corpora.build_lexicon(spark, str(p), str(tmp_path / "lex"))
    assert readers.lexicon(spark, str(tmp_path / "lex")).where("simplified = '学'").first()["pos"] == "v;u"
    out = tmp_path / "candidates.json"
    corpora.global_candidates(spark, str(p), str(out))
    assert json.loads(out.read_text(encoding="utf-8"))["anchors"] == ["了", "学"]
    p.write_text(" \n[\n" + ",\n".join(json.dumps({"simplified": f"w{i}", "forms": [{"meanings": ["[x]", "{"]}]}, indent=1) for i in range(500)) + "\n]\n", encoding="utf-8")
    assert [(r["ordinal"], r["simplified"], r["meanings"]) for r in readers.dictionary(spark, str(p)).orderBy("ordinal").collect()] == [(i, f"w{i}", "[x]; {") for i in range(500)]
    p.write_text("[]", encoding="utf-8")
    assert readers.dictionary(spark, str(p)).count() == 0
    for i, broken in enumerate(("{}", '{"a": [{"simplified": "x"}]}', "", " \n", '[{"simplified": "x"}, {"sim', '"x"', "[1]")):
        own = tmp_path / f"broken-{i}.json"
        own.write_text(broken, encoding="utf-8")
        with pytest.raises(ValueError):
            readers.dictionary(spark, str(own))


def test_anchor_files(spark, tmp_path):
    p = tmp_path / "a.json"
    for payload, ok in (({"anchors": ["了", " "]}, True), (["了"], True), ({"x": 1}, False), ([], False)):
        p.write_text(json.dumps(payload), encoding="utf-8")
        if ok:
            assert [r["token"] for r in readers.anchors(spark, str(p)).collect()] == ["了"]
        else:
            with pytest.raises(ValueError):
                readers.anchors(spark, str(p))
    meta = spark.createDataFrame([("anchors_json", '["x","y"]')], schemas.META)
    assert [r["token"] for r in readers.anchors_or_meta(spark, None, meta).collect()] == ["x", "y"]


def test_wiki_news_and_flash_cards(spark, tmp_path):
    (tmp_path / "w" / "AA").mkdir(parents=True)
    (tmp_path / "w" / "AA" / "wiki_00").write_text('{"id": "1", "text": "这是一个很好的句子。短。这个句子里有學字。"}\nnot json\n{"id": "2"}\n', encoding="utf-8")
    simplify = rewriting.rewriter(spark.createDataFrame([("學", "学")], "source string, target string"))
    corpora.wiki_corpus(spark, str(tmp_path / "w"), str(tmp_path / "wiki"), simplify)
    assert [r["value"] for r in spark.read.text(str(tmp_path / "wiki")).collect()] == ["这是一个很好的句子。"]
    cards = tmp_path / "cards.txt"
    cards.write_text("<b>你好。</b>[sound:a.mp3]\thello\nonly\n", encoding="utf-8")
    assert [r["sentence_zh"] for r in corpora.flash_card_sentences(readers.flash_cards(spark, str(cards))).collect()] == ["你好。"]


def test_store_modes(spark, tmp_path):
    store = str(tmp_path / "s")
    sinks.create_state(spark, store)
    sinks.put_meta(spark, store, {"a": 1})
    sinks.put_meta(spark, store, {"a": 2})
    meta = readers.meta(spark, f"{store}/meta")
    assert meta["a"] == "2" and meta["schema_version"] == str(schemas.SCHEMA_VERSION)
    rows = spark.createDataFrame([("k", "r"), ("k", "r")], schemas.PATTERN_PERSONAL_REALIZATIONS)
    for _ in range(2):
        sinks.insert_new(rows, store, "pattern_personal_realizations", ["pattern_key", "realization"])
    assert readers.table(spark, store, "pattern_personal_realizations").count() == 1
    assert readers.first_table(spark, store, "nope", "runs") == "runs"
    health = {r["table_name"]: r["present"] for r in reports.store_health(spark, store, schemas.STATE_TABLES | {"zz": ""}).collect()}
    assert health["runs"] and not health["zz"]


def test_prior_rebuild_merge_and_stream(spark, tmp_path):
    lines = spark.createDataFrame([("a b a",), ("b c",), ("...",)], "value string")
    store = str(tmp_path / "prior")
    for _ in range(2):  # rebuilding replaces
        prior.build(spark, lines, ["a", "b"], store)
    once = {r["pattern_key"]: r for r in spark.read.parquet(f"{store}/pattern_global_stats").collect()}
    assert sum(r["p_global"] for r in once.values()) == pytest.approx(1.0)
    assert all(r["count_sentences"] <= r["count_occurrences"] for r in once.values())
    prior.build(spark, lines, ["a", "b"], store, merge=True)
    merged = readers.table(spark, store, "pattern_global_stats")
    assert merged.agg(F.sum("p_global")).first()[0] == pytest.approx(1.0) and "pattern_global_stats" in readers.tables(spark, store)
    twice = {r["pattern_key"]: r["count_occurrences"] for r in merged.collect()}
    assert twice == {k: 2 * r["count_occurrences"] for k, r in once.items()}
    meta = readers.meta(spark, f"{store}/meta")
    assert meta["lines_seen"] == "3" and meta["sentences_processed"] == "2"
    src = tmp_path / "in"
    src.mkdir()
    (src / "1.txt").write_text("a b a\nb c\n...\n", encoding="utf-8")
    streamed = str(tmp_path / "streamed")
    for _ in range(2):  # nothing new the second time
        maintain_prior(spark.readStream.text(str(src)), ["a", "b"], streamed, str(tmp_path / "cp")).awaitTermination()
    assert (readers.meta(spark, f"{streamed}/meta")["lines_seen"], readers.meta(spark, f"{streamed}/meta")["sentences_processed"]) == ("3", "2")
    got = {r["pattern_key"]: r["count_occurrences"] for r in readers.table(spark, streamed, "pattern_global_stats").collect()}
    assert got == {k: r["count_occurrences"] for k, r in once.items()}


def test_bootstrap(spark, tmp_path):
    known = spark.createDataFrame([("学 了 学",), ("学 了",), ("学 了",), ("",)], "value string")
    lexicon = spark.createDataFrame([("学", 1, 5, None, None, None, None), ("了", None, 1, None, None, None, None)], schemas.LEXICON)
    store = str(tmp_path / "state")
    B.bootstrap(spark, known, lexicon, store, config=B.BootstrapConfig(anchors_top_k=2))
    read = lambda t: spark.read.parquet(f"{store}/{t}")
    assert sorted(r["zh_text"] for r in read("sentences").collect()) == ["", "学 了", "学 了 学"]
    vocab = {r["word"]: (r["count"], r["hsk_level"]) for r in read("vocab_stats").collect()}
    assert vocab == {"学": (4, 1), "了": (3, None)}
    pair = read("pattern_personal_stats").where(F.col("pattern_key") == "anch_pair|a=学,了|p=gap=0").first()
    assert (pair["count_seen"], pair["distinct_sentence_count"], pair["emerged"]) == (3, 3, True)
    assert read("runs").count() == 1 and json.loads(readers.meta(spark, f"{store}/meta")["anchors_json"]) == ["了", "学"]
    assert reports.vocabulary_health(read("vocab_stats")).first()["n_unknown"] == 1


def test_inspections(spark, tmp_path):
    from corpusloom.plans import inspect

    known = spark.createDataFrame([("a b a",), ("b c",)], "value string")
    lexicon = spark.createDataFrame([("a", 1, 5, None, None, None, None)], schemas.LEXICON)
    state, store = str(tmp_path / "state"), str(tmp_path / "prior")
    B.bootstrap(spark, known, lexicon, state)
    prior.build(spark, known, ["a", "b"], store)
    candidates = spark.createDataFrame([("a",), ("zz",)], "token string")
    for sections in (inspect.inspect_state(spark, state, candidates, recompute=True), inspect.inspect_prior(spark, store, candidates, with_samples=True), inspect.inspect_pipeline(spark, state, store)):
        assert all(title in inspect.render(sections) for title in sections)
    sections = inspect.inspect_pipeline(spark, state, store)
    assert sections["keys of the prior"].first()["n_invalid"] == 0
    report = inspect.inspect_state(spark, state)
    chosen = {r["key"]: r["value"] for r in report["selected meta"].collect()}
    assert chosen["anchors_source"] == "local_df" and chosen["add_skeleton"] == "1" and chosen["add_span_signatures"] == "0" and chosen["span_max_gap"] == "20"
    assert [r["pair_id"] for r in report["length robustness"].collect()] != [] and "_tokenized" not in readers.tables(spark, state)
    assert inspect._stored_config(readers.meta(spark, f"{state}/meta")) == prior.PatternConfig()
    empty = str(tmp_path / "none")
    assert inspect.inspect_prior(spark, empty)["counts"].first()["total"] == 0


@pytest.mark.parametrize("complete", [True, False])
def test_a_broken_replacement_leaves_a_whole_table(spark, tmp_path, complete):
    store = str(tmp_path / "s")
    rows = lambda v: spark.createDataFrame([("k", v)], "key string, value string")
    sinks.replace(rows("old"), store, "meta")
    rows("new").write.parquet(f"{store}/meta__next")
    if not complete:
        (tmp_path / "s" / "meta__next" / "_SUCCESS").unlink()
    (tmp_path / "s" / "meta").rename(tmp_path / "s" / "meta__old")
    assert readers.tables(spark, store) == ["meta"]
    assert readers.meta(spark, f"{store}/meta") == {"k": "new" if complete else "old"}
    sinks.replace(rows("third"), store, "meta", mark="3")
    assert readers.meta(spark, f"{store}/meta") == {"k": "third"} and sinks.marked(spark, store, "meta", "3") and not sinks.marked(spark, store, "meta", "2")
    assert sorted(p.name for p in (tmp_path / "s").iterdir()) == ["meta"]


def test_a_stream_that_breaks_between_tables_counts_once(spark, tmp_path, monkeypatch):
    src, store = tmp_path / "in", str(tmp_path / "store")
    src.mkdir()
    (src / "1.txt").write_text("a b a\nb c\na x b\n", encoding="utf-8")
    run = lambda: maintain_prior(spark.readStream.text(str(src)), ["a", "b"], store, str(tmp_path / "cp"), cap=1).awaitTermination()
    def broken(*args, **options):
        raise OSError("lost")

    # both tables are written, but the switch doesn't come
    with monkeypatch.context() as m:
        m.setattr(buckets, "_commit", broken)
        with pytest.raises(Exception, match="lost"):
            run()
    assert readers.table(spark, store, "pattern_global_stats").isEmpty()
    # the switch comes, but not what follows it
    with monkeypatch.context() as m:
        m.setattr(sinks, "put_meta", lambda spark, store, values: broken() if "last_batch" in values else None)
        with pytest.raises(Exception, match="lost"):
            run()
    run()
    (src / "2.txt").write_text("a y b\n", encoding="utf-8")
    run()
    lines = spark.createDataFrame([("a b a",), ("b c",), ("a x b",), ("a y b",)], "value string")
    prior.build(spark, lines, ["a", "b"], str(tmp_path / "once"), cap=1)
    counts = lambda s: {r["pattern_key"]: (r["count_occurrences"], r["count_sentences"]) for r in readers.table(spark, s, "pattern_global_stats").collect()}
    assert counts(store) == counts(str(tmp_path / "once"))
    kept = readers.table(spark, store, "pattern_global_realizations").groupBy("pattern_key").count()
    assert kept.where("count > 1").count() == 0 and kept.count() == len(counts(store))


def test_a_merge_rewrites_the_buckets_it_touches(spark, tmp_path):
    store = str(tmp_path / "store")
    rows = lambda keys: spark.createDataFrame([(f"k{i}", 1) for i in keys], "key string, n long")
    add = lambda old, new: old.unionByName(new).groupBy("key").agg(F.sum("n").alias("n"))
    merge = lambda keys, mark=None: buckets.merge(spark, store, {"t": buckets.Merge(rows(keys), "key", add)}, mark, buckets=16)
    assert merge(range(300)) == {"t": 16}
    before = buckets.manifest(spark, store)["tables"]["t"]["at"]
    touched = {r[0] for r in rows([5, 6, 1000]).select(buckets.bucket_of("key", 16)).collect()}
    assert merge([5, 6, 6, 1000], "second") == {"t": len(touched)}
    after = buckets.manifest(spark, store)["tables"]["t"]["at"]
    assert {b for b in after if after[b] != before.get(b)} == {str(b) for b in touched}
    # a batch that comes again counts once, and one without rows rewrites nothing
    assert merge([5, 6, 6, 1000], "second") == {} and merge([], "third") == {"t": 0}
    counts = {r["key"]: r["n"] for r in buckets.table(spark, store, "t").collect()}
    assert counts == {f"k{i}": 1 for i in range(300)} | {"k5": 2, "k6": 3, "k1000": 1}
    # a manifest whose writer broke off is passed over; what no version names is cleared away
    (tmp_path / "store" / "_manifest" / "9").write_text('{"version": 9', encoding="utf-8")
    assert buckets.table(spark, store, "t").count() == 301
    merge([7], "fourth")
    merge([7], "fifth")
    kept = {(int(p.parent.name), p.name) for p in (tmp_path / "store" / "_buckets" / "t").glob("*/bucket=*")}
    assert {(v, f"bucket={b}") for b, v in buckets.manifest(spark, store)["tables"]["t"]["at"].items()} <= kept and len(kept) <= 17
    sinks.replace(rows([1]), store, "t")
    assert [r["key"] for r in readers.table(spark, store, "t").collect()] == ["k1"]


def test_a_build_reads_its_lines_once(spark, tmp_path):
    reads = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            reads.add(batch.num_rows)
            yield batch

    lines = spark.createDataFrame([("a b a",), ("b c",), ("...",)] * 50, "value string").mapInArrow(counted, "value string")
    prior.build(spark, lines, ["a", "b"], str(tmp_path / "p"), cap=2)
    assert reads.value == 150
    meta = readers.meta(spark, str(tmp_path / "p" / "meta"))
    assert (meta["lines_seen"], meta["sentences_processed"]) == ("150", "100")


def test_limits_number_the_lines_of_a_split_file(spark, tmp_path):
    path = tmp_path / "lines.txt"
    raw = [f"line {i}" if i % 3 else " " for i in range(200)]
    path.write_text("\n".join(raw), encoding="utf-8")
    before = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "200")
    try:
        got = [(r["line_no"], r["value"]) for r in readers.lines(spark, str(path), limit=150, max_kept=90).collect()]
        assert readers.lines(spark, str(path), limit=10**6).rdd.getNumPartitions() > 3
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before)
    assert got == [(i, x) for i, x in enumerate(raw[:150]) if x.strip()][:90]


def test_a_short_sample_warns(spark, tmp_path):
    from corpusloom.plans import corpora

    for name in ("a", "b"):
        (tmp_path / f"{name}.txt").write_text("one\ntwo\n", encoding="utf-8")
    with pytest.warns(UserWarning, match="2 lines, 3"):
        corpora.mixed_corpus(spark, str(tmp_path / "a.txt"), 3, str(tmp_path / "b.txt"), 2, str(tmp_path / "out"))
    assert sorted(r["value"] for r in readers.lines(spark, str(tmp_path / "out")).collect()) == ["one", "two"]


def test_a_later_bootstrap_makes_realizations_of_unmet_sentences(spark, tmp_path, monkeypatch):
    store, lexicon = str(tmp_path / "s"), spark.createDataFrame([("a", 1, 5, None, None, None, None)], schemas.LEXICON)
    made, texts = [], B._texts
    monkeypatch.setattr(B, "_texts", lambda sentences, *more: made.append(sorted(" ".join(r["tokens"]) for r in sentences.collect())) or texts(sentences, *more))

    def known(*values, config=B.BootstrapConfig(patterns=prior.PatternConfig(families=("anch_pair",))), **more):
        B.bootstrap(spark, spark.createDataFrame([(v,) for v in values], "value string"), lexicon, store, config=config, **more)
        return {(r["pattern_key"], r["realization"]) for r in readers.table(spark, store, "pattern_personal_realizations").collect()}

    def fresh(*values):
        rows = spark.createDataFrame([(v.split(),) for v in values], "tokens array<string>")
        return {(r["pattern_key"], r["realization"]) for r in AP.realizations(rows, ["a", "b", "c"]).collect()}

    assert known("a b", "b c", "a b") == fresh("a b", "b c")
    assert known("a b", "b c") == fresh("a b", "b c") and made == [["a b", "a b", "b c"]]
    # the same anchors, and a sentence more
    assert known("a b", "b c", "c a b") == fresh("a b", "b c", "c a b") and made[1:] == [["c a b"]]
    # other parameters: all again
    wide = B.BootstrapConfig(min_count=9, patterns=prior.PatternConfig(families=("anch_pair",)))
    assert known("a b", "b c", config=wide) == fresh("a b", "b c", "c a b") and made[2:] == [["a b", "b c"]]
    runs = readers.table(spark, store, "runs")
    assert sorted(r["id"] for r in runs.collect()) == [1, 2, 3, 4]
    counts = {r["word"]: r["count"] for r in readers.table(spark, store, "vocab_stats").collect()}
    assert counts == {"a": 1}


def test_sentences_of_a_run_at_the_time_of_another_count_as_unmet(spark, tmp_path):
    store, lexicon = str(tmp_path / "s"), spark.createDataFrame([("a", 1, 5, None, None, None, None)], schemas.LEXICON)
    at = datetime(2026, 1, 1, tzinfo=timezone.utc)
    pairs, keys = B.PatternConfig(families=("anch_pair",)), lambda: {r["pattern_key"] for r in readers.table(spark, store, "pattern_personal_realizations").collect()}
    rows = spark.createDataFrame([("a x b",)], "value string")
    B.bootstrap(spark, rows, lexicon, store, config=B.BootstrapConfig(patterns=B.PatternConfig(families=("anch_seq",))), now=at)
    B.bootstrap(spark, spark.createDataFrame([("b a",), ("x x",)], "value string"), lexicon, store, config=B.BootstrapConfig(patterns=pairs), now=at)
    B.bootstrap(spark, rows, lexicon, store, config=B.BootstrapConfig(patterns=pairs))
    assert {"anch_pair|a=a,x|p=gap=0", "anch_pair|a=a,b|p=gap=1"} <= keys()
