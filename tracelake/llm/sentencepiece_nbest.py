"""SentencePiece encoding and decoding with n-best segmentations.

The pieces of a model and their scores span a lattice over a text; a
segmentation is a path and scores the sum of its pieces.  A forward Viterbi pass
gives the best score of every prefix.  These are exact heuristics for the search
backward from the end: a suffix's score plus the forward score of the prefix
before it is that of the best path that ends so.  A-star takes the best such
suffix and makes it longer by each piece that ends where it starts; the suffixes that reach
the text's start are the n best paths, in order.  Suffixes in the queue stand for
different paths, so the best n of them are enough, and time and memory are in
proportion to n and to the length, however many paths have equal scores.

No piece reaches from a word into the space before the next one, so a text's
lattice is a chain of words' lattices.  Best paths of words are remembered, and
those of new words are found many at a time, arrays of words of one length
advancing together; that pass also keeps each word's second-best score.  The n
best paths of a text differ from its best one only in the n - 1 words whose
second-best path loses least, so the search runs on those words and a best-first
merge combines them.  The result is that of a search over the whole
lattice.

A character that no piece has becomes the byte pieces of its UTF-8 form and
scores ``UNKNOWN_PENALTY`` less than the lowest score.  A space stands before
the text, as the model asks; decoding takes it off and gives the text back
exactly.

Defined cases: a null or empty text has no pieces and score 0; fewer than n
paths are given where a text has fewer; of paths with equal scores any is
best, always the same one; repeated rows and other columns are left alone; an
empty table gives an empty result.
"""

from __future__ import annotations

import heapq
import re
import zlib
from array import array
from bisect import insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import held, mapped

#: How the model file writes the space that begins a word; within this module it is a plain one.
WRITTEN_SPACE, SPACE = "▁", " "
UNKNOWN_PENALTY = 10.0
#: Words that are segmented together have this many characters at most; longer ones go one by one.
TOGETHER = 32
#: Words a task remembers at once; it starts afresh beyond.
REMEMBERED_WORDS = 400_000
#: Characters of words over TOGETHER that a task remembers at once; likewise.
REMEMBERED_CHARS = 4_000_000
NONE = -1e300
U64 = np.uint64
TOP = U64(44)  # leaves the upper 20 bits of a hash
BASE = U64(0x9E3779B97F4A7C15)

ENCODED = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("ids", T.ArrayType(T.ArrayType(T.IntegerType()))),
     T.StructField("scores", T.ArrayType(T.DoubleType()))]
)
DIGEST = T.StructType(
    [T.StructField("doc_id", T.LongType()), T.StructField("n_pieces", T.LongType()), T.StructField("ids_crc32", T.LongType()),
     T.StructField("n_paths", T.LongType()), T.StructField("scores", T.StringType()), T.StructField("paths_crc32", T.StringType()),
     T.StructField("round_trip", T.BooleanType())]
)


class Known(dict):
    """Numbers of words; a new word gets the next number and is noted."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self.new.append(word)
        self[word] = number = len(self)
        return number


class Lattice:
    """Segmentations of texts with the pieces of one model file."""

    def __init__(self, model_file: str) -> None:
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=model_file)
        self.piece_of: dict[str, tuple[int, float]] = {}
        self.byte_ids = [0] * 256
        self.text_of: list[bytes] = [b""] * model.get_piece_size()
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                value = int(piece[1:-1], 16)
                self.byte_ids[value], self.text_of[i] = i, bytes([value])
            elif not (model.is_control(i) or model.is_unknown(i) or model.is_unused(i)):
                piece = piece.replace(WRITTEN_SPACE, SPACE)
                self.piece_of[piece] = (i, model.get_score(i))
                self.text_of[i] = piece.encode()
        self.longest = max(map(len, self.piece_of))
        self.unknown = min(s for _, s in self.piece_of.values() if s > -1e8) - UNKNOWN_PENALTY
        if any(SPACE in p.lstrip(SPACE) for p in self.piece_of):
            raise ValueError("a piece of this model reaches over a space inside it")
        alone = "" if any("\n" in p for p in self.piece_of) else "\n"
        self.parts = re.compile(f"{alone or '(?!)'}|{SPACE}*[^{SPACE}{alone}]+|{SPACE}+")
        hashes = [self.hash(p) for p in self.piece_of]
        order = np.argsort(np.array(hashes, U64))
        self.hashes = np.array(hashes, U64)[order]
        self.seen = np.zeros(1 << 20, bool)
        self.seen[self.hashes >> TOP] = True
        values = list(self.piece_of.values())
        self.hash_ids = np.array([values[k][0] for k in order], np.int32)
        self.hash_scores = np.array([values[k][1] for k in order])
        self.forget()

    def forget(self) -> None:
        self.known, self.others = Known(), {}
        self.ids: list[bytes] = []
        self.long_chars = 0
        self.best, self.loss = np.zeros(1024), np.zeros(1024)

    @staticmethod
    def hash(piece: str) -> int:
        h = 0
        for c in piece:
            h = (h * int(BASE) + ord(c) + 1) & 0xFFFFFFFFFFFFFFFF
        return h

    def edges(self, word: str, end: int) -> Iterator[tuple[int, tuple[int, ...], float]]:
        """(start, ids, score) of the lattice's edges that end at ``end``."""
        for start in range(max(0, end - self.longest), end):
            if piece := self.piece_of.get(word[start:end]):
                yield start, (piece[0],), piece[1]
            elif start == end - 1:
                yield start, self.ids_between(word, start, end), self.unknown

    def ids_between(self, word: str, start: int, end: int) -> tuple[int, ...]:
        """The ids of one edge."""
        if piece := self.piece_of.get(word[start:end]):
            return (piece[0],)
        return tuple(self.byte_ids[b] for b in word[start:end].encode("utf-8", "surrogatepass"))

    def forward(self, word: str) -> array:
        """The best score of every prefix."""
        best = array("d", [0.0])
        for end in range(1, len(word) + 1):
            best.append(max(best[start] + score for start, _, score in self.edges(word, end)))
        return best

    def search(self, word: str, n: int) -> list[tuple[float, tuple[int, ...]]]:
        """The ``n`` best paths of a word, best first; of equal ones the path that ``together`` takes.

        A-star from the end: an entry of the queue is a suffix with its score, and
        the forward score of where it starts is what its best completion adds, exactly.  Entries
        stand for different paths, so with r paths to go the best r of them hold
        these, and the queue keeps no more; no position is expanded more than n times.
        """
        ahead = self.forward(word)
        at, came = array("q", [len(word)]), array("q", [-1])  # of each suffix: where it starts, and the one it was made longer from
        queue = [(-ahead[-1], 0, 0, 0, 0.0)]  # cost, latest first, start, number, score of the suffix
        found: list[tuple[float, tuple[int, ...]]] = []
        turn = 0
        while queue:
            _, _, _, number, behind = queue.pop(0)
            end = at[number]
            if not end:
                found.append((behind, self.ids_along(word, number, at, came)))
                continue
            turn += 1
            left = n - len(found)
            for start, _, score in self.edges(word, end):
                entry = (-(ahead[start] + score + behind), -turn, start)
                if len(queue) < left or entry < queue[-1][:3]:
                    at.append(start)
                    came.append(number)
                    insort(queue, (*entry, len(at) - 1, score + behind))
                    del queue[left:]
            del queue[left:]
        return found

    def ids_along(self, word: str, number: int, at: array, came: array) -> tuple[int, ...]:
        """The ids of a whole path, from its start."""
        ids: list[int] = []
        while came[number] >= 0:
            ids += self.ids_between(word, at[number], at[came[number]])
            number = came[number]
        return tuple(ids)

    def learn(self) -> None:
        """Best paths, scores and second-best losses of the new words."""
        first, words = len(self.ids), self.known.new
        self.ids += [b""] * len(words)
        while len(self.best) < len(self.ids):
            self.best, self.loss = np.concatenate([self.best, self.best]), np.concatenate([self.loss, self.loss])
        groups: dict[int, list[int]] = {}
        for k, w in enumerate(words):
            groups.setdefault(len(w) if len(w) <= TOGETHER else 0, []).append(k)
        self.long_chars += sum(len(words[k]) for k in groups.get(0, ()))
        for length, group in groups.items():
            for at in range(0, len(group), 4096):
                block = group[at : at + 4096]
                several = self.together([words[k] for k in block], length) if length else [None] * len(block)
                for k, path in zip(block, several, strict=True):
                    if path is None:
                        paths = self.search(words[k], 2)
                        ids = np.array(paths[0][1], "<u4").tobytes()
                        path = (ids, paths[0][0], paths[0][0] - paths[1][0] if len(paths) > 1 else np.inf)
                    self.ids[first + k], self.best[first + k], self.loss[first + k] = path
        self.known.new = []

    def together(self, words: list[str], n: int) -> list[tuple[bytes, float, float] | None]:
        """(ids, score, loss of the second-best path) of words of ``n`` characters; None with an unknown character."""
        count = len(words)
        codes = np.frombuffer("".join(words).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(count, n).T.astype(U64) + U64(1)
        first, second = np.full((n + 1, count), NONE), np.full((n + 1, count), NONE)
        first[0] = 0.0
        came, used = np.zeros((n + 1, count), np.int64), np.zeros((n + 1, count), np.int32)
        known = np.ones(count, bool)
        for start in range(n):
            h = np.zeros(count, U64)
            for end in range(start + 1, min(n, start + self.longest) + 1):
                h = h * BASE + codes[end - 1]
                column = np.flatnonzero(self.seen[h >> TOP])  # few strings get past this filter
                k = np.minimum(np.searchsorted(self.hashes, h[column]), len(self.hashes) - 1)
                hit = self.hashes[k] == h[column]
                column, k = column[hit], k[hit]
                if end == start + 1:
                    found = np.zeros(count, bool)
                    found[column] = True
                    known &= found
                score = self.hash_scores[k]
                a, b, best = first[start, column] + score, second[start, column] + score, first[end, column]
                better = a > best
                second[end, column] = np.maximum(np.where(better, np.maximum(best, b), a), second[end, column])
                first[end, column] = np.where(better, a, best)
                came[end, column[better]], used[end, column[better]] = start, self.hash_ids[k[better]]
        steps, at, column = [], np.full(count, n), np.arange(count)
        while at.any():
            steps.append(np.where(at > 0, used[at, column], -1))
            at = came[at, column]
        ids = np.array(steps[::-1], np.int64).T
        taken = ids >= 0
        data, ends = ids[taken].astype("<u4").tobytes(), (4 * taken.sum(axis=1).cumsum()).tolist()
        best = first[n].tolist()
        loss = np.where(second[n] > NONE / 2, first[n] - second[n], np.inf).tolist()
        starts = [0, *ends[:-1]]
        return [(data[s:e], x, y) if ok else None for s, e, x, y, ok in zip(starts, ends, best, loss, known.tolist(), strict=True)]

    def split(self, texts: list[str]) -> list[tuple[list[str], np.ndarray]]:
        """The words of texts and their numbers; all of them are known afterwards."""
        if len(self.ids) > REMEMBERED_WORDS or self.long_chars > REMEMBERED_CHARS:
            self.forget()
        parts = [self.parts.findall(SPACE + t) if t else [] for t in texts]
        numbers = [np.fromiter(map(self.known.__getitem__, ps), np.int64, len(ps)) for ps in parts]
        self.learn()
        return list(zip(parts, numbers, strict=True))

    def alternatives(self, word: str, n: int) -> list[tuple[float, bytes]]:
        """(loss, ids) of the ``n`` best paths of a word."""
        found = self.others.get((word, n))
        if found is None:
            paths = self.search(word, n)
            found = self.others[word, n] = [(paths[0][0] - s, np.array(ids, "<u4").tobytes()) for s, ids in paths]
        return found

    def paths(self, parts: list[str], at: np.ndarray, n: int) -> list[tuple[float, bytes]]:
        """(score, ids) of the ``n`` best paths of a text that ``split`` has cut."""
        if not parts:
            return [(0.0, b"")]
        ids = list(map(self.ids.__getitem__, at.tolist()))
        score = float(self.best[at].sum())
        found = [(score, b"".join(ids))]
        loss = self.loss[at]
        most = min(n - 1, len(parts))
        if not most:
            return found
        places = np.sort(np.argpartition(loss, most - 1)[:most])
        places = [int(p) for p in places if np.isfinite(loss[p])]
        options = [self.alternatives(parts[p], n) for p in places]
        # Best first over the choices of these words; a choice is reached from the one with its last raised word lowered.
        queue = [(options[k][1][0], (0,) * k + (1,) + (0,) * (len(places) - k - 1)) for k in range(len(places)) if len(options[k]) > 1]
        heapq.heapify(queue)
        while queue and len(found) < n:
            lost, choice = heapq.heappop(queue)
            for p, k, several in zip(places, choice, options, strict=True):
                ids[p] = several[k][1]
            found.append((score - lost, b"".join(ids)))
            last = max(k for k, c in enumerate(choice) if c)
            if choice[last] + 1 < len(options[last]):
                more = options[last][choice[last] + 1][0] - options[last][choice[last]][0]
                heapq.heappush(queue, (lost + more, choice[:last] + (choice[last] + 1,) + choice[last + 1 :]))
            for k in range(last + 1, len(places)):
                if len(options[k]) > 1:
                    heapq.heappush(queue, (lost + options[k][1][0], choice[:k] + (1,) + choice[k + 1 :]))
        return found

    def decode(self, ids: list[int]) -> str:
        """The text of ids, without the space before it."""
        text = b"".join(map(self.text_of.__getitem__, ids)).decode("utf-8", "replace")
        return text[1:] if text.startswith(" ") else text


def lattice(model_file: str) -> Lattice:
    """One for each worker process, which runs many tasks."""
    return held(f"pieces of {model_file}", lambda: Lattice(model_file))


def blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        for at in range(0, whole.num_rows, 800):
            yield whole.slice(at, 800)


def encode(docs: DataFrame, model_file: str, n: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, ids, scores): the ids of the ``n`` best segmentations of each text, best first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = lattice(model_file)
        for batch in blocks(batches):
            found = [model.paths(parts, at, n) for parts, at in model.split([t or "" for t in batch.column(1).to_pylist()])]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([[np.frombuffer(ids, "<u4").tolist() for _, ids in f] for f in found], pa.list_(pa.list_(pa.int32()))),
                 pa.array([[s for s, _ in f] for f in found], pa.list_(pa.float64()))],
                names=ENCODED.names,
            )

    return mapped(docs.select(F.col(id_col).cast("long"), F.col(text_col)), run, ENCODED)


def decode(encoded: DataFrame, model_file: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """(doc_id, text) of rows with an array of ids; null ids give an empty text."""
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = lattice(model_file)
        for batch in batches:
            texts = [model.decode(ids or []) for ids in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=schema.names)

    return mapped(encoded.select(F.col(id_col).cast("long"), F.col(ids_col)), run, schema)


def digests(docs: DataFrame, model_file: str, n: int = 3) -> DataFrame:
    """Digests of ``encode``: piece count and CRC of the best path, scores and CRCs of all, and whether decoding gives the text back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = lattice(model_file)
        for batch in blocks(batches):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            rows = []
            for text, (parts, at) in zip(texts, model.split(texts), strict=True):
                found = model.paths(parts, at, n)
                best = found[0][1]
                sums = [zlib.crc32(ids) for _, ids in found]
                back = model.decode(np.frombuffer(best, "<u4").tolist()) == text
                rows.append((len(best) // 4, sums[0], len(found), ",".join(f"{s:.1f}" for s, _ in found), ",".join(map(str, sums)), back))
            columns = zip(zip(*rows, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_()), strict=True)
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in columns)], names=DIGEST.names)

    return mapped(docs.select(F.col("doc_id").cast("long"), F.col("text")), run, DIGEST)
