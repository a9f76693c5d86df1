import random

from tracelake.llm import preference


def brute(turns, pairs):
    render = lambda ts: "".join(f"<|im_start|>{r}\n{t}<|im_end|>\n" for _, r, t in ts)

    def mask(ts):
        at, out = 0, []
        for _, r, t in ts:
            start = at + len(f"<|im_start|>{r}\n")
            at = start + len(f"{t}<|im_end|>\n")
            if r == "assistant":
                out.append(f"{start}:{at - 1}")
        return ",".join(out)

    convs = {}
    for c, n, r, t in turns:
        if c is not None and n is not None:
            convs.setdefault(c, []).append((n, r or "", t or ""))
    convs = {c: sorted(ts) for c, ts in convs.items()}
    out = []
    for p, a, b in pairs:
        x, y = convs.get(a, []), convs.get(b, [])
        k = 0
        while k < min(len(x), len(y)) and x[k][1:] == y[k][1:]:
            k += 1
        row = (p, a, b, k, render(x[:k]), render(x[k:]), mask(x[k:]), render(y[k:]), mask(y[k:]))
        out.append((*row, bool(row[6] and row[8] and row[5] != row[7])))
    return out


def test_against_brute_force(spark):
    rng = random.Random(6)
    turns = []
    for c in range(60):
        for n in range(rng.randint(0, 6)):
            turns.append((c, n, rng.choice(["user", "assistant", "assistant", "system", None]), rng.choice(["é😀", "b", "", None])))
    turns += [(3, 1, "user", "same number"), (None, 1, "user", "x"), (4, None, "user", "y"), (70, 0, "assistant", "z" * 50_000)]
    pairs = [(i, rng.randrange(62), rng.randrange(62)) for i in range(80)] + [(80, None, 3), (81, 70, 70), (81, 70, 70), (82, 1, 1)]
    frame = spark.createDataFrame([(*t, "e") for t in turns], "conv_id long, turn long, role string, text string, prompt string")
    named = spark.createDataFrame(pairs, "pair_id long, chosen_id long, rejected_id long")
    rows = preference.format_pairs(frame, named)
    assert sorted(map(str, map(tuple, rows.collect()))) == sorted(map(str, brute(turns, pairs)))


def test_neighbours_and_empty_tables(spark):
    frame = spark.createDataFrame([(0, 0, "user", "q"), (0, 1, "assistant", "good"), (1, 0, "user", "q"), (1, 1, "assistant", "bad"), (4, 0, "user", "alone")], "conv_id long, turn long, role string, text string")
    rows = {r["pair_id"]: r for r in preference.format_pairs(frame, preference.neighbouring_pairs(frame)).collect()}
    assert rows[0]["n_common"] == 1 and rows[0]["usable"] and rows[0]["chosen"] == "<|im_start|>assistant\ngood<|im_end|>\n"
    assert not rows[2]["usable"] and rows[2]["rejected"] == ""
    assert preference.format_pairs(frame.limit(0), preference.neighbouring_pairs(frame.limit(0))).collect() == []


def test_neighbouring_pairs_of_large_and_negative_ids(spark):
    big = 1 << 60
    turns = spark.createDataFrame([(c, 0, "assistant", str(c)) for c in (big + 2, big + 3, -3, -4, 7)], "conv_id long, turn long, role string, text string")
    pairs = {tuple(r) for r in preference.neighbouring_pairs(turns).collect()}
    assert pairs == {(big // 2 + 1, big + 2, big + 3), (-2, -4, -3), (3, 6, 7)}
    rows = {r["pair_id"]: r for r in preference.format_pairs(turns, preference.neighbouring_pairs(turns)).collect()}
    assert str(big + 2) in rows[big // 2 + 1]["chosen"] and str(big + 3) in rows[big // 2 + 1]["rejected"] and rows[3]["chosen"] == ""
