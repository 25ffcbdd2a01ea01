import random
from collections import Counter

from edgelake.llm.quality_rules import apply_host_rules, base_rules, host_verdicts


def measures(text):
    words = (text or "").split()
    grams = [tuple(words[i : i + 3]) for i in range(len(words) - 2)]
    often = Counter(grams)
    places = {i + k for i, g in enumerate(grams) if often[g] > 1 for k in range(3)}
    lines = [x for x in (text or "").split("\n") if x.split()]
    return (
        len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text or ""), len(lines) - len(set(lines)), len(places)
    )


def test_measures_equal_a_plain_count(documents):
    rng = random.Random(3)
    texts = [None, "", " ", "a", "a a a a", "x\nx\n\n x\nx", "é# *$%&|<>", "a b c a b c"]
    texts += [" ".join(rng.choice("ab") for _ in range(rng.randint(1, 40))) for _ in range(40)]
    texts.append(" ".join(rng.choice("abcdefgh") for _ in range(20_000)))
    found = base_rules(documents([(i, t, None, "s") for i, t in enumerate(texts)])).collect()
    assert len(found) == len(texts)
    for r in found:
        want = measures(texts[r.doc_id])
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or want[4] * 100 > 50 * want[0])


def test_bad_hosts_take_their_documents_and_small_hosts_are_shrunk(documents):
    good = " ".join(f"w{i}" for i in range(60))
    rows = [(i, good, None, "clean") for i in range(60)]
    rows += [(100 + i, "junk" if i else good, None, "bad") for i in range(40)]
    rows += [(200 + i, good if i else "junk", None, f"h{i % 7}") for i in range(50)]
    rows += [(300, "junk", None, "tiny"), (301, good, None, None), (301, good, None, None), (None, None, None, "clean")]
    found = {(r.host, r.doc_id): r for r in apply_host_rules(documents(rows)).collect()}
    assert not found["bad", 100].kept and not found["bad", 100].base_failed and found["bad", 100].host_rejected
    assert found["clean", 0].kept and found[None, 301].kept and not found["clean", None].kept
    assert found["tiny", 300].host_rate < 1
    assert apply_host_rules(documents(rows)).count() == len(rows)


def test_prior_of_equal_hosts_pulls_to_the_mean(spark):
    rows = [(h, i < 5) for h in "abcd" for i in range(10)]
    found = host_verdicts(spark.createDataFrame(rows, "host string, base_failed boolean")).collect()
    assert {round(r.host_rate, 6) for r in found} == {0.5} and not any(r.host_rejected for r in found)


def test_no_rows(documents):
    assert apply_host_rules(documents([(1, "a")]).where("doc_id > 1")).count() == 0
