import random
from collections import Counter

import pytest

from corpusloom import queries as Q

RNG = random.Random(11)
SENTENCES = [[RNG.choice("ab ba abc cab dd eee ffff gggggg".split()) for _ in range(RNG.randint(0, 14))] for _ in range(40)]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    root = tmp_path_factory.mktemp("whole")
    spark.createDataFrame([(i, " ".join(s)) for i, s in enumerate(SENTENCES)] + [(101, "onlyodd"), (102, "onlyeven")], "doc_id long, text string").write.parquet(f"{root}/documents.parquet")
    spark.createDataFrame([(1, "onlyodd onlyeven absent")], "item_id long, text string").write.parquet(f"{root}/benchmark.parquet")
    return str(root)


def test_zero_df_anchors_reads_all_documents(spark, sf_dir):
    assert [r["token"] for r in Q.zero_df_anchors(spark, sf_dir).collect()] == ["absent"]


def test_token_ngrams_keeps_those_that_occur_once(spark, sf_dir):
    want = Counter(" ".join(s[i : i + 3]) for s in SENTENCES for i in range(len(s) - 2))
    assert 1 in want.values()
    assert {r["g"]: r["n"] for r in Q.token_ngrams(spark, sf_dir).collect()} == want


def test_pat_skip3_reaches_as_far_as_pat_skip2(spark, sf_dir):
    found = Counter()
    for s in SENTENCES:
        at = [(i, t) for i, t in enumerate(s) if len(t) <= Q.MAX_LEN]
        for i, a in at:
            for j, b in at:
                for k, c in at:
                    if 0 < j - i <= 10 and 0 < k - j <= 10:
                        found[f"a_skip3|a={a},{b},{c}|p=max_jump=10"] += 1
    assert {r["pattern_key"]: r["count_occurrences"] for r in Q.pat_skip3(spark, sf_dir).collect()} == found


def test_sentence_coverage_counts_skeletons(spark, sf_dir):
    n = sum(bool(s) for s in SENTENCES) + 2
    assert tuple(Q.sentence_coverage(spark, sf_dir).first()) == (n, n, n, 1.0, 1.0)
