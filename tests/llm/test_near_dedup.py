import random

import numpy as np
import pytest

from tracelake.llm import graph, near_dedup


def brute(docs):
    """doc_id -> (set size, smallest doc_id reachable), by comparing all pairs."""
    sets = {}
    for doc, text in docs:
        words = (text or "").translate({c: c + 32 for c in range(65, 91)}).encode().split()
        n = len(words)
        sets[doc] = {tuple(words)} if 0 < n < 5 else {tuple(words[i : i + 5]) for i in range(n - 4)} if n else set()
    label = {d: d for d in sets}

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[i + 1 :]:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                label[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in ids}


def corpus(seed, n=120):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(3000)]
    base = [rng.choices(vocabulary, k=rng.choice([3, 5, 40, 200])) for _ in range(12)]
    docs = []
    for i in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 4, 8])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        docs.append((i, rng.choice([" ", "\n", "  "]).join(words)))
    return docs + [(n, None), (n + 1, ""), (n + 2, " \t "), (n + 3, "One"), (n + 4, "oNE"), (n + 5, "é one"), (n + 6, "É one")]


def assigned(spark, docs):
    rows = near_dedup.assign(spark.createDataFrame([(*d, "b", 1) for d in docs], "doc_id long, text string, band string, label int")).collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)
    return {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows}


@pytest.mark.parametrize(("rounds", "block", "few"), [(1, 1000, 1000), (3, 1000, 1000), (0, 1000, 1000), (0, 4, 1000), (0, 4, 0)])
def test_components_against_all_pairs(spark, monkeypatch, rounds, block, few):
    monkeypatch.setattr(near_dedup, "STAR_ROUNDS", rounds)  # 0: every pair is found by the last round
    monkeypatch.setattr(near_dedup, "BLOCK_MEMBERS", block)
    monkeypatch.setattr(near_dedup, "BROADCAST_IDS", few)  # 0: nothing of a counted size is broadcast
    docs = corpus(7)
    assert assigned(spark, docs) == brute(docs)


def test_a_chain_of_links_is_one_component(spark):
    words = [f"c{i}" for i in range(160)]
    docs = [(i, " ".join(words[4 * i : 4 * i + 60])) for i in range(20)]
    assert assigned(spark, docs) == brute(docs)


def test_large_group_of_near_copies(spark):
    rng = random.Random(11)
    base = [f"g{i}" for i in range(150)]
    docs = []
    for i in range(300):
        words = list(base)
        words[rng.randrange(150)] = f"x{i}"
        docs.append((i, " ".join(words)))
    assert {c for _, c in assigned(spark, docs).values()} == {0}


def test_repeated_rows_missing_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (None, "a b c d e f"), (None, None)], "doc_id long, text string")
    rows = near_dedup.assign(docs).collect()
    assert len(rows) == 4 and all(r["kept"] for r in rows)
    assert near_dedup.assign(docs.limit(0)).collect() == []
    assert near_dedup.deduplicate(docs.limit(0)).columns == ["doc_id", "text"]


def test_deduplicate_keeps_the_smallest_of_each_component(spark):
    docs = corpus(8, 60)
    frame = spark.createDataFrame([(*d, "x") for d in docs], "doc_id long, text string, digest string")
    out = near_dedup.deduplicate(frame)
    assert out.columns == frame.columns
    assert sorted(r["doc_id"] for r in out.collect()) == sorted({c for _, c in brute(docs).values()})


def test_very_long_text_is_read_whole(spark):
    words = [f"l{i}" for i in range(200_000)]
    rows = assigned(spark, [(0, " ".join(words)), (1, " ".join(words[:150_005])), (2, " ".join(words[:140_000]))])
    assert rows == {0: (199_996, 0), 1: (150_001, 0), 2: (139_996, 0)}


def test_signature_agreement_estimates_similarity():
    rng = np.random.default_rng(4)
    x = near_dedup.mix(np.arange(4000, dtype=np.uint64))
    for share in (0.5, 0.75, 0.9):
        k = int(1000 * share)
        a, b = x[:1000], np.concatenate([x[:k], x[2000 : 3000 - k]])
        jaccard = k / (2000 - k)
        m = near_dedup.signatures([np.sort(a), np.sort(b), np.sort(rng.permutation(a))])
        assert abs((m[0] == m[1]).mean() - jaccard) < 0.13
        assert (m[0] == m[2]).all()


def test_components_of_a_graph(spark):
    edges = [(5, 3), (3, 9), (9, 1), (20, 21), (21, 22), (22, 23), (23, 24), (24, 19)]
    rows = graph.components(spark.createDataFrame(edges, "a long, b long")).collect()
    assert {r["node"]: r["label"] for r in rows} == {1: 1, 3: 1, 5: 1, 9: 1, **dict.fromkeys(range(19, 25), 19)}


def test_centres_are_joined_in_shares_and_blocks_by_size(spark, monkeypatch):
    monkeypatch.setattr(near_dedup, "SHARE_ROWS", 7)
    monkeypatch.setattr(near_dedup, "BLOCK_MEMBERS", 6)
    rng = random.Random(21)
    base = [f"k{i}" for i in range(400)]
    docs = []
    for i in range(160):  # one passage with tails of all lengths: sizes from 60 to 400 in the same buckets
        words = base[: rng.randint(60, 400)]
        words[rng.randrange(len(words))] = f"y{i}"
        docs.append((i, " ".join(words)))
    assert assigned(spark, docs) == brute(docs)
    rows = near_dedup.assign(spark.createDataFrame([(*d, "x", 1, 2) for d in docs[:20]], "doc_id long, text string, component_id string, n_shingles int, share int")).collect()
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in rows} == brute(docs[:20])


def test_hubs_are_joined_in_shares(spark, monkeypatch):
    from tracelake.llm import graph

    monkeypatch.setattr(graph, "HUB_LINKS", 10)
    edges = [(5, i) for i in range(100, 300)] + [(299, 400), (400, 1), (600, 601), (602, 601)]
    labels = {r["node"]: r["label"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert labels == {n: 1 for n in (1, 5, 400, *range(100, 300))} | {600: 600, 601: 600, 602: 600}


def test_few_links_take_few_tasks(spark, monkeypatch):
    chain = [(i, i + 1) for i in range(1, 60)] + [(100, 90), (90, 95)]
    expected = {n: 1 for n in range(1, 61)} | dict.fromkeys((90, 95, 100), 90)
    edges = spark.createDataFrame(chain, "a long, b long").coalesce(1)
    tracker, taken = spark.sparkContext.statusTracker(), {}
    monkeypatch.setattr(graph, "HUB_LINKS", 1)
    key = "spark.sql.adaptive.coalescePartitions.enabled"
    before = spark.conf.get(key)
    spark.conf.set(key, "false")  # else the few rows here would lie in few partitions either way
    for few in (graph.FEW_LINKS, 0):  # 0: labels are joined by shuffles, hubs in shares
        monkeypatch.setattr(graph, "FEW_LINKS", few)
        spark.sparkContext.setJobGroup(f"links-{few}", "")
        try:
            assert {r["node"]: r["label"] for r in graph.components(edges).collect()} == expected
        finally:
            spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
        stages = [tracker.getStageInfo(s) for j in tracker.getJobIdsForGroup(f"links-{few}") for s in tracker.getJobInfo(j).stageIds]
        taken[few] = sum(s.numCompletedTasks for s in stages if s)
    monkeypatch.setattr(graph, "FEW_LINKS", 400_000)
    monkeypatch.setattr(graph, "TASK_ROWS", 20)
    rows = graph.components(edges)
    assert {r["node"]: r["label"] for r in rows.collect()} == expected and rows.rdd.getNumPartitions() > 1
    spark.conf.set(key, before)
    assert taken[400_000] < taken[0] / 2, taken
