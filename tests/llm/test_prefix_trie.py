import hashlib
import random
import zlib

import pytest

from tracelake.llm import common, prefix_trie

COLUMNS = ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256")


def brute(turns, block=20, heads=4):
    """Nodes by sets of rebuilt tuples; subtrees by comparing prefixes."""
    own = {}
    for conv, turn, role, text in turns:
        if conv is not None:
            role, text = role or "", text or ""
            own.setdefault(conv, []).append((turn is not None, turn or 0, hashlib.sha256(f"{len(role)}:{role}{text}".encode()).hexdigest(), (role, text)))
    own = {c: [x[3] for x in sorted(ts)] for c, ts in own.items()}
    built = {}
    for c, ts in own.items():
        h = zlib.crc32(str(c).encode()) % heads
        built[c] = tuple(own.get(c - c % block, [])[:h] + ts[h:])
    members = {}
    for c, ts in built.items():
        for d in range(len(ts) + 1):
            members.setdefault(ts[:d], []).append(c)
    words = lambda t: len(t.encode().split())
    rows = []
    for node, inside in members.items():
        below = [n for n in members if n[: len(node)] == node]
        children = [n for n in below if len(n) == len(node) + 1]
        leaves = [n for n in below if not any(len(m) == len(n) + 1 and m[: len(n)] == n for m in below)]
        saved = sum((len(members[n]) - 1) * words(n[-1][1]) for n in below if n)
        done = ",".join(str(c) for c in sorted(inside) if len(built[c]) == len(node))
        parent = min(members[node[:-1]]) if node else None
        rows.append((min(inside), len(node), parent, len(inside), len(children), len(leaves), saved, hashlib.sha256(done.encode()).hexdigest()))
    return sorted(rows, key=str)


def nodes(spark, turns, **more):
    frame = spark.createDataFrame([(*t, 1, "x") for t in turns], "conv_id long, turn long, role string, text string, depth int, f string")
    return sorted(map(tuple, prefix_trie.trie(frame, **more).select(*COLUMNS).collect()), key=str)


def talk(seed, n=90):
    rng = random.Random(seed)
    turns = []
    for c in range(n):
        if c in (20, 41):
            continue  # a base that is absent
        for t in range(rng.choice([0, 1, 2, 3, 5, 7])):
            turns.append((c, t, rng.choice(["user", "assistant", None]), rng.choice(["Hi you", "a  b\tc", "é", "", None])))
    return turns + [(None, 0, "user", "lost"), (7, None, "user", "first"), (7, 1, "user", "same number"), (7, 1, "user", "same number"), (-3, 0, "user", "Hi you"), (1 << 40, 0, "user", "Hi you")]


@pytest.mark.parametrize(("chunk", "piece", "share"), [(4096, 512, 1000), (2, 1, 1), (3, 2, 5)])
def test_against_sets_of_tuples(spark, monkeypatch, chunk, piece, share):
    monkeypatch.setattr(prefix_trie, "CHUNK", chunk)
    monkeypatch.setattr(prefix_trie, "PIECE", piece)
    monkeypatch.setattr(common, "HOT_SHARE", share)
    turns = talk(1)
    assert nodes(spark, turns) == brute(turns)


def test_other_blocks_and_heads(spark):
    turns = talk(2, 40)
    assert nodes(spark, turns, block=7, heads=3) == brute(turns, 7, 3)
    with pytest.raises(ValueError):
        nodes(spark, turns, heads=9)


def test_copies_of_a_long_conversation(spark):
    long = [(t, "user" if t % 2 else "assistant", f"turn {t % 11}") for t in range(150)]
    turns = [(c, *t) for c in (0, 1, 2, 45, 46) for t in long] + [(3, *t) for t in long[:100]] + [(4, 0, "user", "alone")]
    assert nodes(spark, turns) == brute(turns)


def test_texts_of_nodes_are_found_through_their_references(spark):
    turns = [(0, 0, "user", "a b"), (0, 1, "assistant", "c"), (1, 0, "user", "a b"), (1, 1, "assistant", "d")]
    frame = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    stored = {r["place"]: r for r in prefix_trie.contents(frame).collect()}
    found = prefix_trie.trie(frame).where("depth > 0").collect()
    assert {stored[r["place"]]["words"] for r in found if r["depth"] == 1} == {2}
    assert sorted(stored) == [0, 1, 2, 3]


def test_bases_that_fail_are_replaced(spark, monkeypatch):
    good = prefix_trie.bases
    monkeypatch.setattr(prefix_trie, "bases", lambda choice: [1] * 4 if not choice else good(choice))  # base 1: order of turns is lost
    turns = [(40 + i, t, "user", x) for i, xs in enumerate([("a", "b", "c", "d", "e"), ("b", "a", "c", "d", "e"), ("c", "d", "e", "b", "a")] * 3) for t, x in enumerate(xs)]
    assert nodes(spark, turns) == brute(turns)
    monkeypatch.setattr(prefix_trie, "bases", lambda choice: [1] * 4)
    with pytest.raises(prefix_trie.Unverified):
        nodes(spark, turns)


def test_empty_tables(spark):
    frame = spark.createDataFrame([(None, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    assert prefix_trie.trie(frame).collect() == [] and prefix_trie.trie(frame.limit(0)).collect() == []


def test_element_of_a_joined_sequence():
    """The element of a head joined with a run of another sequence is that of the whole."""
    p, b = prefix_trie.PRIME, prefix_trie.bases(0)[0]
    g = lambda ts: sum(t * pow(b, i, p) for i, t in enumerate(ts)) % p
    head, own = [5, 7], [11, 13, 17, 19]
    for h in range(4):
        run = (g(own) - g(own[:h])) * pow(b, len(head) - h, p) % p
        assert (g(head) + run) % p == g(head + own[h:])
