import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from tracelake.llm import packing

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(PATH)


def ids_of(tokenizer, text):
    return [*tokenizer.encode(text or "", add_special_tokens=False).ids, 2]


def test_ids_equal_the_tokenizers_library_on_odd_texts(tokenizer):
    rng = random.Random(3)
    alphabet = list("ab'sT1é٣日 \t\n\r\x0b\x1c\x85\xa0\u2003\u3000.,!_-😀\u0301") + ["'s", "'ll", "  ", "\n\n", "<|endoftext|>", " word.,", "\nWord", "ɐ.", " don't.", "!'s", "Ġ", "\x00"]
    encoder = packing.TextIds(PATH)
    assert encoder.fast is not None
    texts = ["".join(rng.choices(alphabet, k=rng.randint(0, 14))) for _ in range(12_000)] + ["x" * 5000 + " y", "", "<|endoftext|>"]
    for text in texts:
        assert np.frombuffer(encoder.of(text), "<u4").tolist() == ids_of(tokenizer, text)[:-1], repr(text)


def test_long_runs_of_white_space(tokenizer):
    encoder = packing.TextIds(PATH)
    for text in ("a" + " " * 2_000_000 + "x", "\n" * 2_000_000, "<|endoftext|>" + " \n" * 600_000 + "\u3000y" + " " * 150_000):
        assert np.array_equal(np.frombuffer(encoder.of(text), "<u4"), ids_of(tokenizer, text)[:-1])


def test_cutting_runs_of_white_space_out_keeps_the_ids(tokenizer, monkeypatch):
    monkeypatch.setattr(packing, "LONG_RUN", 2)
    encoder, rng = packing.TextIds(PATH), random.Random(8)
    alphabet = list("a's1. \t\n\r\x0b\x1c\x1f\x85\xa0\u1680\u200b\u2003\u2028\u3000") + ["  ", "\n\n", "<|endoftext|>", " b"]
    for _ in range(12_000):
        text = "".join(rng.choices(alphabet, k=rng.randint(0, 14)))
        assert np.frombuffer(encoder.of(text), "<u4").tolist() == ids_of(tokenizer, text)[:-1], repr(text)


def test_other_files_are_left_to_the_tokenizers_library():
    path = public_tokenizers.path("word_bpe_49k.json")
    encoder = packing.TextIds(path)
    assert encoder.fast is None
    assert np.frombuffer(encoder.of("Some text"), "<u4").tolist() == Tokenizer.from_file(path).encode("Some text", add_special_tokens=False).ids


def test_cuts_fill_every_piece_but_the_first():
    assert packing.cuts(1, 4) == [(0, 1)]
    assert packing.cuts(8, 4) == [(0, 4), (4, 4)]
    assert packing.cuts(9, 4) == [(0, 1), (1, 4), (5, 4)]


def test_plan_uses_exact_complements_first():
    # 7+3, 6+2+2, 5+2+2+1: single, pair and triple complements of 10
    made = packing.plan({7: 2, 3: 2, 6: 1, 5: 1, 2: 4, 1: 1}, 10)
    assert sum(times for _, times in made) == 4
    assert all(sum(p) == 10 for p, _ in made)


def test_no_gap_is_left_that_an_exact_complement_fills():
    rng = random.Random(9)
    for _ in range(40):
        capacity = rng.choice([40, 100])
        counts = {n: rng.randint(1, 9) for n in rng.sample(range(1, capacity + 1), 15)}
        state = packing.Available(counts, capacity, packing.Sums(counts, capacity))
        first = max(counts)
        pattern = state.filled(first, 1)
        gap, free = capacity - first, counts | {first: counts[first] - 1}
        sizes = [(a,) for a in free if a == gap] + [(a, b) for a in free for b in free if a >= b and a + b == gap]
        sizes += [(a, b, c) for a in free for b in free for c in free if a >= b >= c and a + b + c == gap]
        fits = [s for s in sizes if s[0] <= first and all(free[n] >= s.count(n) for n in s)]
        if fits:
            assert sum(pattern) == capacity and len(pattern) == 1 + min(map(len, fits))


def test_dense_lengths_are_packed_by_the_indexes():
    for counts in ({n: 7 for n in range(1, 257)}, {n: 20 for n in range(1, 60)}):
        made = packing.plan(counts, 256)
        assert sum(t for p, t in made if sum(p) < 256) <= 1


def best_fit_decreasing(counts, capacity):
    """Sequences that plain best fit makes, piece by piece."""
    gaps = []
    for n in sorted((n for n, c in counts.items() for _ in range(c)), reverse=True):
        fits = [i for i, g in enumerate(gaps) if g >= n]
        if fits:
            gaps[min(fits, key=gaps.__getitem__)] -= n
        else:
            gaps.append(capacity - n)
    return len(gaps)


def test_plan_needs_no_more_sequences_than_best_fit():
    rng = random.Random(7)
    fewer = 0
    for _ in range(60):
        capacity = rng.choice([32, 64, 200])
        counts = {n: rng.randint(1, 12) for n in rng.sample(range(1, capacity + 1), rng.choice([5, 12, 30]))}
        made, plain = sum(t for _, t in packing.plan(counts, capacity)), best_fit_decreasing(counts, capacity)
        assert -(-sum(n * c for n, c in counts.items()) // capacity) <= made <= plain
        fewer += made < plain
    assert fewer  # exact complements make a difference


def test_sums_hold_every_combination():
    lengths = [2, 3, 5, 7, 11]
    sums = packing.Sums(lengths, 40)
    for total in range(2, 34):
        pairs = {(a, b) for a in lengths for b in lengths if a >= b and a + b == total}
        triples = {(a, b, c) for a in lengths for b in lengths for c in lengths if a >= b >= c and a + b + c == total}
        assert {tuple(r) for r in sums.pairs(total).tolist()} == pairs and len(sums.pairs(total)) == len(pairs)
        assert {tuple(r) for r in sums.triples(total).tolist()} == triples and len(sums.triples(total)) == len(triples)


def test_triples_kept_are_bounded(monkeypatch):
    wide = packing.Sums(range(1, 1025), 1024)
    monkeypatch.setattr(packing, "TRIPLE_BYTES", 1 << 20)
    narrow = packing.Sums(range(1, 1025), 1024)
    for total in (*range(900, 1000), *range(900, 1000, 7)):
        assert (narrow.triples(total) == wide.triples(total)).all()
        assert sum(rows.nbytes for rows in narrow._triples.values()) == narrow.kept <= 1 << 20
    counts = {n: 1 + n % 5 for n in range(3, 200, 2)}
    few = packing.plan(counts, 256)
    monkeypatch.setattr(packing, "TRIPLE_BYTES", 1 << 40)
    assert few == packing.plan(counts, 256)


def test_plan_places_every_piece_once():
    rng = random.Random(5)
    for _ in range(30):
        counts = {n: rng.randint(1, 50) for n in rng.sample(range(1, 65), 20)}
        made = packing.plan(counts, 64)
        placed = {}
        for pattern, times in made:
            assert sum(pattern) <= 64
            for n in pattern:
                placed[n] = placed.get(n, 0) + times
        assert placed == counts


def check_packed(rows, capacity):
    by = {}
    for r in rows:
        by.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= capacity
    return len(by)


def test_digests_against_brute_force(spark, tokenizer):
    rng = random.Random(1)
    texts = [" ".join(rng.choices(["alpha", "beta", "gamma", "naïve", "x"], k=rng.choice([1, 3, 40, 200, 900, 3000]))) for _ in range(80)]
    docs = [(i, t, "extra", i) for i, t in enumerate(texts)] + [(80, None, "", 0), (81, "", "", 0), (5, texts[5], "extra", 5), (None, "no id", "", 1)]
    frame = spark.createDataFrame(docs, "doc_id long, text string, piece string, length long")
    rows = packing.digests(frame, PATH).collect()
    want = []
    for doc, text, *_ in docs:
        ids = ids_of(tokenizer, text)
        for i, (s, n) in enumerate(packing.cuts(len(ids), 1024)):
            want.append((doc, i, s, n, zlib.crc32(np.array(ids[s : s + n], "<u4").tobytes())))
    key = lambda r: tuple((x is not None, x or 0) for x in r)
    assert sorted(((r["doc_id"], r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows), key=key) == sorted(want, key=key)
    n = check_packed(rows, 1024)
    assert n <= -(-sum(w[3] for w in want) // 1024) + 1


def test_sequences_hold_their_pieces_ids(spark, tokenizer):
    docs = spark.createDataFrame([(0, "one two three"), (1, "four five"), (2, None)], "doc_id long, text string")
    pieces = packing.tokenise(docs, PATH, capacity=16).cache()
    rows = packing.sequences(packing.pack(pieces, 16)).collect()
    assert sum(r["length"] for r in rows) == sum(len(ids_of(tokenizer, t)) for t in ("one two three", "four five", None))
    assert all(len(r["ids"]) == 4 * r["length"] for r in rows)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert packing.digests(docs, PATH).collect() == []


def test_hot_length_is_ranked_over_salts(spark):
    pieces = spark.createDataFrame([(i, 0, 100) for i in range(500)] + [(500 + i, 0, 24) for i in range(30)], "doc_id long, piece int, length long")
    rows = packing.pack(pieces, 1024).collect()
    assert len(rows) == 530
    assert check_packed(rows, 1024) == 50


def test_packed_pieces_carry_their_ids(spark, tokenizer):
    docs = spark.createDataFrame([(i, f"some words {i} " * (i % 50)) for i in range(60)], "doc_id long, text string")
    rows = packing.packed(docs, PATH, 64).collect()
    by = {}
    for r in sorted(rows, key=lambda r: (r["doc_id"], r["piece"])):
        by[r["doc_id"]] = by.get(r["doc_id"], b"") + bytes(r["ids"])
    assert {d: np.frombuffer(b, "<u4").tolist() for d, b in by.items()} == {i: ids_of(tokenizer, f"some words {i} " * (i % 50)) for i in range(60)}
    check_packed(rows, 64)
