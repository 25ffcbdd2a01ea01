import hashlib
import math
import random
import re
import zlib
from collections import Counter

from edgelake.llm import resampling as rs

WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
ALPHABET = ["a", "The", "q7", " ", "\n", "\n", "\r\n", "é", "漢字", "-", "_", "Ä", "x" * 30, "it's", "\x7f", "🙂"]


def features(text):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    return len(w), Counter(zlib.crc32(f.encode()) % rs.BUCKETS for f in [*w, *(f"{x} {y}" for x, y in zip(w, w[1:]))])


def expected(docs, target, percent=25, least=20):
    found = [(i, *features(t)) for i, t in docs]
    s, t = Counter(), Counter()
    for _, _, f in found:
        s += f
    for text in target:
        t += features(text)[1]
    ns, nt = sum(s.values()), sum(t.values())
    gain = [math.floor(1000 * math.log((t[b] + 1) * (ns + rs.BUCKETS) / ((s[b] + 1) * (nt + rs.BUCKETS)))) for b in range(rs.BUCKETS)]
    rows = []
    for i, words, f in found:
        n = sum(f.values())
        weight = sum(gain[b] * c for b, c in f.items()) // n if n else 0
        h = int(hashlib.sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, n, weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, words])
    enough = sorted((r for r in rows if r[5] >= least), key=lambda r: (-r[3], r[0] is None, r[0] or 0, r[1]))
    for place, row in enumerate(enough[: len(enough) * percent // 100], 1):
        row[4] = place
    return sorted((tuple(r[:5]) for r in rows), key=str)


def run(spark, documents, docs, target):
    wanted = spark.createDataFrame([(t, "x", 1) for t in target], "text string, a string, n int")
    got = rs.resample(documents(docs), wanted)
    return sorted((tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect()), key=str)


def test_equal_to_plain_loops(spark, documents):
    rng = random.Random(3)
    lines = ["".join(rng.choice(ALPHABET) for _ in range(rng.choice([1, 5, 40]))) for _ in range(40)]
    text_of = lambda: "\n".join(rng.choice(lines) for _ in range(rng.choice([0, 1, 2, 9, 60])))
    docs = [(i, rng.choice([text_of, lambda: lines[0]])()) for i in range(150)]
    docs += [(500, None), (501, ""), (502, "\n\n"), (503, "a\nb"), (None, "a b " * 12), (7, docs[7][1]), (7, docs[7][1])]
    target = [text_of() for _ in range(5)] + [None, ""]
    assert run(spark, documents, docs, target) == expected(docs, target)


def test_frequent_lines_are_counted_like_others(spark, documents):
    docs = [(i, "\n".join(["one common line of seven words here"] * (i % 5) + [f"own {i} words"] * 8)) for i in range(120)]
    assert run(spark, documents, docs, ["common words"]) == expected(docs, ["common words"])


def test_long_text_empty_tables_and_clashing_columns(spark, documents):
    long = ("word " * 5 + "\n") * 200_000
    docs = [(1, long), (2, "w" * 3_000_000), (3, "a " * 30)]
    assert run(spark, documents, docs, ["word word"]) == expected(docs, ["word word"])
    assert run(spark, documents, docs, []) == expected(docs, [])
    assert run(spark, documents, [], ["a"]) == []
    rows = spark.createDataFrame(
        [(1, "a b", 5, "x", "y", 2.0, 3, "p")], "doc_id long, text string, row int, a string, _at string, weight double, rank int, _part string"
    )
    assert [r["n_features"] for r in rs.resample(rows, rows).collect()] == [3]
