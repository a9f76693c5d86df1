import random
import tracemalloc
import zlib

import numpy as np
import public_tokenizers
import pytest
from sentencepiece import SentencePieceProcessor

from tracelake.llm import sentencepiece_nbest as sp

PATH = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def model():
    return sp.Lattice(PATH)


def all_paths(model, word):
    """Every segmentation of a word, by recursion."""
    if not word:
        return [(0.0, ())]
    out = []
    for start, ids, score in model.edges(word, len(word)):
        out += [(s + score, p + ids) for s, p in all_paths(model, word[:start])]
    return out


def forward_paths(model, word, n):
    """The n best scores by a forward pass that keeps n scores for every prefix."""
    best = [[0.0]]
    for end in range(1, len(word) + 1):
        best.append(sorted((s + score for start, _, score in model.edges(word, end) for s in best[start]), reverse=True)[:n])
    return best[-1]


def test_backward_search_equals_a_forward_pass(model):
    rng = random.Random(8)
    words = ["-" * 2_000, "#" * 300, "=-" * 200, " " * 50, *("".join(rng.choices("abcdeinorst-=é😀", k=rng.randint(1, 60))) for _ in range(60))]
    for word in words:
        for n in (1, 2, 7):
            found = model.search(word, n)
            assert [s for s, _ in found] == pytest.approx(forward_paths(model, word, n))
            assert len({ids for _, ids in found}) == len(found) and all(model.decode(list(ids)) == word.removeprefix(" ") for _, ids in found)


def test_unbroken_characters_equal_a_forward_pass(model):
    letters = "".join(random.Random(9).choices("abcdefghijklmnopqrstuvwxyz0123456789", k=100_000))
    assert [s for s, _ in model.search(letters, 3)] == pytest.approx(forward_paths(model, letters, 3))


def test_search_gives_the_best_paths_in_order(model):
    for word in (" there", " naïve", "a😀b", "  x", "ingly", "日本語"):
        want = sorted((s for s, _ in all_paths(model, word)), reverse=True)[:6]
        found = model.search(word, 6)
        assert [s for s, _ in found] == pytest.approx(want)
        assert len({ids for _, ids in found}) == len(found)


def test_equal_scores_give_the_exact_best_paths(model):
    for word in ("-" * 9, " " + "=" * 8, "#" * 10, "-=" * 5):
        want = sorted((s for s, _ in all_paths(model, word)), reverse=True)[:5]
        found = model.search(word, 5)
        assert [s for s, _ in found] == pytest.approx(want)
        assert len({ids for _, ids in found}) == len(found)
        assert all(model.decode(list(ids)) == word.removeprefix(" ") for _, ids in found)
        assert np.array(found[0][1], "<u4").tobytes() == model.together([word], len(word))[0][0]


def test_long_unbroken_runs_take_bounded_memory(model):
    letters = "".join(random.Random(6).choices("abcdefghijklmnopqrstuvwxyzABCDEFGH0123456789+/", k=100_000))
    for word in ("-" * 2_000, "#" * 700, letters):
        tracemalloc.start()
        found = model.search(word, 3)
        peak = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
        assert peak < 40e6
        assert len({ids for _, ids in found}) == 3 and all(model.decode(list(ids)) == word for _, ids in found)
        assert [s for s, _ in found] == sorted((s for s, _ in found), reverse=True)


def test_long_words_are_forgotten_by_their_characters(model, monkeypatch):
    monkeypatch.setattr(sp, "REMEMBERED_CHARS", 100)
    model.forget()
    for k in range(5):
        model.split(["x" * 60 + str(k)])
    assert len(model.ids) <= 2
    model.forget()


def test_words_together_equal_words_alone(model):
    rng = random.Random(4)
    words = ["".join(rng.choices("abcdehinorst éü.,😀", k=5)) for _ in range(300)]
    for word, got in zip(words, model.together(words, 5), strict=True):
        paths = model.search(word, 2)
        if got is None:
            assert "😀" in word
        else:
            assert got[1] == pytest.approx(paths[0][0]) and got[2] == pytest.approx(paths[0][0] - paths[1][0] if len(paths) > 1 else np.inf)
            assert sum(s for i in np.frombuffer(got[0], "<u4") for k, s in model.piece_of.values() if k == i) == pytest.approx(got[1])


def test_paths_of_a_text_equal_a_search_over_its_whole_lattice(model):
    rng = random.Random(5)
    for _ in range(40):
        text = " ".join("".join(rng.choices("aeinrst\néx", k=rng.randint(1, 4))) for _ in range(rng.randint(1, 5)))
        whole = model.search(" " + text, 5)
        found = model.paths(*model.split([text])[0], 5)
        assert [s for s, _ in found] == pytest.approx([s for s, _ in whole])
        assert len({ids for _, ids in found}) == len(found)


def test_every_path_decodes_to_the_text(spark):
    other = SentencePieceProcessor(model_file=PATH)
    texts = ["Hello world", "  two  spaces ", "a ▁literal▁ one", "tab\tnew\nline\r\n", "日本語 😀 naïve", "", None, "x" * 3000, " ", "\u0000 ", "word " * 20_000]
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)] + [(None, "no id", "x")], "doc_id long, text string, ids string")
    rows = sp.encode(docs, PATH, 4).collect()
    assert len(rows) == len(texts) + 1
    for r in rows:
        text = ("no id" if r["doc_id"] is None else texts[r["doc_id"]]) or ""
        assert r["scores"] == sorted(r["scores"], reverse=True) and len(r["ids"]) == len(r["scores"])
        assert len({tuple(i) for i in r["ids"]}) == len(r["ids"])
        for ids in r["ids"]:
            assert "▁" in text or other.decode(ids) == text
    flat = spark.createDataFrame([(r["doc_id"], r["ids"][-1]) for r in rows] + [(99, None)], "doc_id long, ids array<int>")
    back = {r["doc_id"]: r["text"] for r in sp.decode(flat, PATH).collect()}
    assert all(back[i] == (t or "") for i, t in enumerate(texts)) and back[99] == ""
    digests = {r["doc_id"]: r for r in sp.digests(docs, PATH, 4).collect()}
    assert all(d["round_trip"] for d in digests.values())
    for r in rows:
        assert digests[r["doc_id"]]["ids_crc32"] == zlib.crc32(np.array(r["ids"][0], "<u4").tobytes())


def test_empty_table_and_forgetting(spark, model, monkeypatch):
    assert sp.digests(spark.createDataFrame([], "doc_id long, text string"), PATH).collect() == []
    monkeypatch.setattr(sp, "REMEMBERED_WORDS", 3)
    texts = ["one two three four five", "six seven eight nine ten", "one six"]
    assert [model.decode(np.frombuffer(model.paths(*model.split([t])[0], 1)[0][1], "<u4").tolist()) for t in texts] == texts
