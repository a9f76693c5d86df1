import hashlib
import math
import random
import re
import zlib
from collections import Counter

import pytest

from tracelake.llm import common, resampling

COLUMNS = ("doc_id", "n_features", "weight", "score", "rank")


def words_of(text):
    lowered = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lowered)


def features(text, max_n):
    words = words_of(text)
    return Counter(" ".join(words[i : i + n]) for n in range(1, max_n + 1) for i in range(len(words) - n + 1))


def brute(docs, target, max_n=1, n_buckets=10_000, min_words=20, percent=10, seed=2024):
    """Rows by plain counting over whole texts; repeated rows rank in some order."""
    bucket = lambda f: zlib.crc32(f.encode()) % n_buckets
    s, t = Counter(), Counter()
    for side, texts in ((s, [x for _, x in docs]), (t, target)):
        for text in texts:
            for f, n in features(text, max_n).items():
                side[bucket(f)] += n
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s.total() + n_buckets) / ((s[b] + 1) * (t.total() + n_buckets))))
    rows = []
    for doc, text in docs:
        found = features(text, max_n)
        weight = sum(n * gain(bucket(f)) for f, n in found.items())
        h = int(hashlib.sha256(f"{seed}:{'' if doc is None else doc}".encode()).hexdigest()[:8], 16)
        rows.append([doc, found.total(), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), None, len(words_of(text)) >= min_words])
    able = sorted((r for r in rows if r[5]), key=lambda r: (-r[3], r[0] is None, r[0]))
    for i, r in enumerate(able[: percent * len(able) // 100]):
        r[4] = i + 1
    return sorted((tuple(r[:5]) for r in rows), key=str)


def corpus(seed, n=140):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(60)] + ["É", "ß1", "日本", "O", "Zz"]
    lines = [" ".join(rng.choices(vocabulary, k=rng.choice([1, 3, 8]))) for _ in range(30)] + ["", " . ", "--"]
    docs = [(i, "\n".join(rng.choice(lines) if rng.random() < 0.7 else " ".join(rng.choices(vocabulary, k=5)) for _ in range(rng.randint(1, 12)))) for i in range(n)]
    return docs + [(n, None), (n + 1, ""), (n + 2, "\n\n"), (n + 3, "a-b_c\x7fd\r\ne\tf")]


@pytest.mark.parametrize(("max_n", "n_buckets", "share"), [(1, 10_000, 1000), (1, 7, 1), (3, 50, 10), (2, 10_000, 1)])
def test_against_plain_counting(spark, monkeypatch, max_n, n_buckets, share):
    monkeypatch.setattr(common, "HOT_SHARE", share)  # 1: nothing is joined by broadcast
    docs = corpus(5)
    target = ["w1 w2 W3 w4\nw5 é", "W1 w2", None, ""]
    frame = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, key string, rank int").repartition(5)
    goal = spark.createDataFrame([(t, i) for i, t in enumerate(target)], "text string, item_id int")
    rows = resampling.resample(frame, goal, max_n=max_n, n_buckets=n_buckets, percent=30).select(*COLUMNS).collect()
    assert sorted(map(tuple, rows), key=str) == brute(docs, target, max_n, n_buckets, percent=30)


def test_runs_across_lines_are_those_of_the_whole_text():
    rng = random.Random(3)
    for _ in range(200):
        text = "\n".join(" ".join(rng.choices("abcd", k=rng.randint(0, 4))) for _ in range(rng.randint(1, 5)))
        lines = resampling.segments(text.encode())
        for n in (1, 2, 3, 5):
            found = Counter(resampling.crossing_runs(lines, n))
            for line in lines:
                found.update(resampling.runs(resampling.WORD.findall(line), n))
            assert {f.decode(): k for f, k in found.items()} == features(text, n)


def test_repeated_rows_ties_missing_ids_and_empty_tables(spark):
    long = " ".join(f"t{i}" for i in range(25))
    docs = [(3, long)] * 5 + [(None, long), (None, None), (8, "short")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    goal = spark.createDataFrame([("t1 t2",)], "text string")
    rows = resampling.resample(frame, goal, percent=50).select(*COLUMNS).collect()
    assert sorted(map(tuple, rows), key=str) == brute(docs, ["t1 t2"], percent=50)
    assert resampling.resample(frame.limit(0), goal).collect() == []
    none = resampling.resample(frame, goal.limit(0)).select(*COLUMNS).collect()
    assert sorted(map(tuple, none), key=str) == brute(docs, [])


def test_draw_returns_whole_rows(spark):
    docs = corpus(6)
    frame = spark.createDataFrame([(*d, f"s{d[0]}") for d in docs], "doc_id long, text string, row string")
    goal = spark.createDataFrame([("w1 w2",)], "text string")
    drawn = resampling.draw(frame, goal, percent=20)
    assert drawn.columns == frame.columns
    want = {r[0] for r in brute(docs, ["w1 w2"], percent=20) if r[4]}
    assert {tuple(r) for r in drawn.collect()} == {(d, t, f"s{d}") for d, t in docs if d in want}


def test_very_long_text_and_line(spark):
    docs = [(0, " ".join(f"v{i % 5000}" for i in range(200_000))), (1, "x y\n" * 50_000), (2, "x y")]
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    rows = resampling.resample(frame, spark.createDataFrame([("x v1",)], "text string"), percent=50).select(*COLUMNS).collect()
    assert sorted(map(tuple, rows), key=str) == brute(docs, ["x v1"], percent=50)
