import random

import numpy as np
import pytest
import xxhash

from tracelake.llm import simhash


def plain_fingerprint(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    shingles = [b" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    hashes = [xxhash.xxh64(s, seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints):
    """index -> smallest index reachable, by comparing all pairs."""
    label = list(range(len(prints)))

    def find(x):
        while label[x] != x:
            x = label[x]
        return x

    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= 2:
                x, y = find(i), find(j)
                label[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(prints))]


def corpus(seed, n=150):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(500)]
    base = [rng.choices(vocabulary, k=rng.choice([2, 5, 60, 400])) for _ in range(15)]
    texts = []
    for _ in range(n):
        words = list(rng.choice(base))
        for _ in range(rng.choice([0, 0, 1, 2, 3])):
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
        texts.append(rng.choice([" ", "\n", "\t "]).join(words))
    return [*texts, None, "", " \x0b\x0c", "One", "oNE", "É one", "é one", "a\x1cb c d", "one two"]


def test_fingerprint_against_plain_bits():
    for text in corpus(1, 40):
        assert simhash.fingerprint(text) == plain_fingerprint(text)


@pytest.mark.parametrize(("cell", "few"), [(8192, 1_000_000), (3, 1_000_000), (3, 0)])
def test_classes_against_all_pairs(spark, monkeypatch, cell, few):
    monkeypatch.setattr(simhash, "CELL_ROWS", cell)
    monkeypatch.setattr(simhash, "BROADCAST_IDS", few)
    texts = corpus(2)
    docs = spark.createDataFrame([(i, t, "x", 1) for i, t in enumerate(texts)], "doc_id long, text string, fp string, label int")
    rows = {r["doc_id"]: r for r in simhash.assign(docs).collect()}
    prints = [plain_fingerprint(t) for t in texts]
    assert [rows[i]["fingerprint"] for i in range(len(texts))] == [f"{p:016x}" for p in prints]
    assert [rows[i]["component_id"] for i in range(len(texts))] == components(prints)


def clusters(seed, n):
    """Fingerprints around a few centres, and chains two bits apart."""
    rng = random.Random(seed)
    out = [rng.getrandbits(64) for _ in range(5)] + [0, (1 << 64) - 1]
    while len(out) < n:
        x = rng.choice(out[:7] if rng.random() < 0.5 else out)
        for _ in range(rng.choice([1, 2, 2, 3, 4])):
            x ^= 1 << rng.randrange(64)
        out.append(x)
    return sorted(set(out))


@pytest.mark.parametrize(("cell", "small"), [(8192, 48), (20, 48), (20, 2), (8192, 2)])
def test_links_join_what_all_pairs_join(spark, monkeypatch, cell, small):
    monkeypatch.setattr(simhash, "CELL_ROWS", cell)
    monkeypatch.setattr(simhash, "SMALL", small)  # workers have the module's own value; the tiles are compared here too
    prints = clusters(3, 700)
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    found = simhash.links(spark.createDataFrame([(signed(p),) for p in prints], "fp long")).collect()
    at = {signed(p): i for i, p in enumerate(prints)}
    a, b = np.array([at[r["a"]] for r in found]), np.array([at[r["b"]] for r in found])
    nodes, roots = simhash.forest(a, b)
    label = list(range(len(prints)))
    for x, y in zip(nodes, roots, strict=True):
        label[x] = y
    assert label == components(prints)
    assert all((prints[x] ^ prints[y]).bit_count() >= 1 for x, y in zip(a, b, strict=True))


def test_large_groups_find_the_pairs_of_their_cell():
    prints = np.array(clusters(4, 400), np.uint64)
    tiles = np.array([sum((int(p) >> 4 * k & 15).bit_count() << 3 * k for k in range(16)) for p in prints], np.int64)
    block = np.zeros(len(prints), np.int64)
    pairs = set()
    for cell in np.unique(tiles):
        a, b = simhash.large_group(cell, prints, tiles, block, (0, 0))
        pairs |= set(zip(a.tolist(), b.tolist(), strict=True))
    at = {int(p): i for i, p in enumerate(prints)}
    nodes, roots = simhash.forest(np.array([at[x] for x, _ in pairs]), np.array([at[y] for _, y in pairs]))
    label = np.arange(len(prints))
    label[nodes] = roots
    assert label.tolist() == components([int(p) for p in prints])


def test_repeated_rows_missing_ids_and_empty_tables(spark):
    docs = spark.createDataFrame([(4, "a b c d"), (4, "a b c d"), (None, "A b c d"), (None, "x y z v w"), (7, None), (9, "")], "doc_id long, text string")
    rows = sorted((tuple(r) for r in simhash.assign(docs).collect()), key=str)
    same, other = f"{plain_fingerprint('a b c d'):016x}", f"{plain_fingerprint('x y z v w'):016x}"
    assert rows == sorted([(4, same, 4), (4, same, 4), (None, same, 4), (None, other, None), (7, "0" * 16, 7), (9, "0" * 16, 7)], key=str)
    assert simhash.assign(docs.limit(0)).collect() == []


def test_very_long_text_is_read_whole(spark):
    words = " ".join(f"l{i % 977}x{i % 13}" for i in range(120_000))
    rows = simhash.assign(spark.createDataFrame([(0, words), (1, words[: len(words) // 2])], "doc_id long, text string")).collect()
    assert {r["doc_id"]: r["fingerprint"] for r in rows} == {0: f"{plain_fingerprint(words):016x}", 1: f"{plain_fingerprint(words[: len(words) // 2]):016x}"}
