import random
import zlib

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from tests.llm.test_language_id import WORDS
from tests.llm.test_near_dedup import brute as near_classes
from tracelake.llm import language_id
from tracelake.llm.queries import vocabulary


def corpus():
    rng = random.Random(12)
    rows = []
    for lang, words in WORDS.items():
        for i in range(40):
            rows.append((" ".join(f"{w}{rng.choice('abcdefgh')}" for w in rng.choices(words, k=60)), lang, f"s{i % 3}"))
    base = rows[0][0].split()
    for i in range(6):  # near copies
        words = list(base)
        words[5 + 8 * i] = "changed"
        rows.append((" ".join(words), "en", "s"))
    rows += [(rows[3][0].upper(), "en", "s"), (rows[3][0], "en", "s")]  # copies
    rows += [("", "en", "s"), (None, "de", None), ("1234 5678", None, "s")]  # no letters
    fresh = " ".join(f"{w}{rng.choice('abcdefgh')}" for w in rng.choices(WORDS["en"], k=60))
    rows.append((f"{fresh} mail me at jane0@mail.example.com or +1 (555) 010-9999", "en", "s"))
    return [(i, t, la, s, None if t is None else len(t)) for i, (t, la, s) in enumerate(rows)]


def test_stages_against_brute_force(spark, tmp_path):
    rows = corpus()
    schema = "doc_id long, text string, lang string, source string, n_chars long"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    state = {r["doc_id"]: r for r in docs.collect()}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        after = {r["doc_id"]: r for r in out.collect()}
        texts = {i: r["text"] for i, r in state.items()}
        if name == "language_id":
            rejected = {r["doc_id"] for r in language_id.identify(docs).collect() if r["rejected"]}
            assert {i for i, t in texts.items() if not t or t == "1234 5678"} <= rejected and len(rejected) <= 5
            want = {i: t for i, t in texts.items() if i not in rejected}
        elif name == "exact_dedup":
            last = {t.lower(): i for i, t in sorted(texts.items())}
            want = {i: texts[i] for i in last.values()}
            assert len(want) == len(texts) - 2
        elif name == "minhash_near_dedup":
            want = {i: texts[i] for i, (_, c) in near_classes(sorted(texts.items())).items() if i == c}
            assert len(want) <= len(texts) - 6
        else:
            want = {i: t.replace("+1 (555) 010-9999", "[PHONE]").replace("jane0@mail.example.com", "[EMAIL]") for i, t in texts.items()}
            assert sum("[EMAIL]" in t for t in want.values()) == 1
            assert all(r["n_chars"] == len(r["text"]) for r in after.values())
        assert {i: r["text"] for i, r in after.items()} == want
        state, docs = after, spark.createDataFrame([tuple(r) for r in after.values()], schema)
    tokenizer = Tokenizer.from_file(vocabulary())
    sums = {i: zlib.crc32(np.array([*tokenizer.encode(r["text"], add_special_tokens=False).ids, 2], "<u4").tobytes()) for i, r in state.items()}
    packed = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"]: r["ids_crc32"] for r in packed} == sums
    assert len({r["sequence_id"] for r in packed}) <= -(-sum(r["length"] for r in packed) // 1024) + 1


def test_empty_documents(spark, tmp_path):
    spark.createDataFrame([], "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_odd_rows_and_clashing_columns(spark, tmp_path):
    """Extra columns named like inner ones pass every stage; very long, null and repeated rows have their results."""
    extra = "label int, band string, key string, digest string, n long, sequence_id string, piece string, kept boolean, rejected string, spans string"
    own = (7, "b", "k", "d", 1, "s", "p", False, "r", "x")
    rows = [(*r, *own) for r in corpus()]
    rng = random.Random(4)
    long = " ".join(f"{w}{rng.randrange(10**6)}" for w in rng.choices(WORDS["en"], k=60_000))
    rows += [(900, long, "en", "s", None, *own), (None, rows[5][1] + " more", "en", "s", 3, *own), (901, " " * 50_000, None, None, None, *own), (rows[7][0], *rows[7][1:])]
    schema = f"doc_id long, text string, lang string, source string, n_chars long, {extra}"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "documents.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES[:-1]):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns
        path = str(tmp_path / f"stage{i}")
        out.write.parquet(path)
        docs = spark.read.parquet(path)
    kept = docs.collect()
    assert {tuple(r)[5:] for r in kept} == {own}
    ids = [r["doc_id"] for r in kept]
    assert 900 in ids and 901 not in ids and ids.count(rows[7][0]) == 1
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, str(tmp_path)).collect()
    assert {r["doc_id"] for r in packed} == set(ids)
    by_place = {}
    for r in packed:
        by_place.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for places in by_place.values():
        at = 0
        for offset, length in sorted(places):
            assert offset == at
            at += length
        assert at <= 1024
