import numpy as np
import pytest

from edgelake.llm import language

WORDS = {
    "aa": "kalo mirto senda polin karit sembla".split(), "bb": "xuzzy wovvex yquox zzuvv quwex vyxxu".split(),
    "cc": "ödräm bünëk ïthör gülâk òrmèn tâlë".split(),
}


def text(lang, n, seed=0):
    return " ".join(np.random.default_rng(seed).choice(WORDS[lang], n))


@pytest.fixture
def model(documents):
    rows = [(i, text(lang, 60, i), lang) for i, lang in enumerate(sorted(WORDS) * 5)]
    return language.fit(documents([*rows, (90, "nothing learned", None), (91, None, "aa"), (92, "", "bb")]))


def test_languages_and_proportions(documents, model):
    rows = [(1, text("aa", 80)), (2, text("bb", 5)), (3, text("cc", 80).upper()), (4, text("aa", 160) + " " + text("cc", 80)), (5, None), (6, " 12 34 !"), (7, ""), (7, "")]
    got = {r.doc_id: r for r in language.predict(documents(rows), model).collect()}
    assert [got[i].lang_pred for i in range(1, 8)] == ["aa", "bb", "cc", "aa", "und", "und", "und"]
    assert got[1].langs == ["aa"] and got[4].langs == ["aa", "cc"] and got[4].score == pytest.approx(2 / 3, abs=0.05)
    assert got[5].score == 0 and sum(got[4].shares) == pytest.approx(1)


def test_result_does_not_depend_on_partitions(documents, model):
    rows = [(i, text("abc"[i % 3] * 2, 30, i)) for i in range(40)]
    key = lambda r: (r.doc_id, r.lang_pred, round(r.score, 9))
    one = sorted(map(key, language.predict(documents(rows).repartition(1), model).collect()))
    assert one == sorted(map(key, language.predict(documents(rows).repartition(7), model).collect()))


def test_counts_cover_all_rows(documents):
    n = language.ngram_counts(documents([(i, "ab", "aa") for i in range(100)])).toPandas()
    assert n.n.tolist() == [100, 100]


def test_nothing_to_learn_from(documents):
    none = language.fit(documents([(1, "a", None)]))
    assert [r.lang_pred for r in language.predict(documents([(1, "abc")]), none).collect()] == ["und"]
    assert language.predict(documents([(1, "abc")]).where("false"), none).count() == 0


def test_held_out_accuracy(spark, sf):
    from edgelake.llm.queries import QUERIES

    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    rows = [r for r in QUERIES["op6_language_mixture"](spark, sf).collect() if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in rows) >= 0.95 * len(rows)
    assert all(0 <= r.score <= 1 for r in rows)
