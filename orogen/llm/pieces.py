"""Pieces of a SentencePiece vocabulary: unigram token counts and merge-dropout encoding.

The space mark is written as a plain space throughout, so a text's own mark
characters are unknown characters, go to bytes, and come back as they were. No piece
of such a vocabulary holds a space after another character, so a text is cut before every run of
spaces and each word is handled alone and remembered.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from orogen.llm.common import give_back, table

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = "▁"
RUN = re.compile(" *[^ ]+| +")
LONG = 48  # symbols of a word beyond which the batch form leaves it to the agenda
NONE = np.iinfo(np.int32).max
TURNS = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)


def words(text: str) -> list[str]:
    """The runs of a text after the leading dummy space, each without its first space."""
    if "  " in text or text.startswith(" "):
        return [w[1:] for w in RUN.findall(" " + text)]
    return text.split(" ")


class Vocabulary:
    def __init__(self, path: str):
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.vocab_size()
        self.byte_id = [0] * 256
        self.raw = [b""] * n  # what each id stands for
        self.ids: dict[str, int] = {}
        self.score = np.array([sp.get_score(i) for i in range(n)])
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                value = int(piece[3:5], 16)
                self.byte_id[value], self.raw[i] = i, bytes([value])
            elif not (sp.is_control(i) or sp.is_unknown(i)):
                piece = piece.replace(MARK, " ")
                if re.search("[^ ] ", piece):
                    raise ValueError(f"a piece holds a space inside: {piece!r}")
                self.ids[piece], self.raw[i] = i, piece.encode()
        self.unknown = float(self.score.min()) - 10.0

    def decode(self, ids: list[int]) -> str:
        return b"".join(map(self.raw.__getitem__, ids)).decode()[1:]

    def char_bytes(self, c: str) -> list[int]:
        return [self.byte_id[b] for b in c.encode()]


class Counter:
    """Count-only Viterbi over a unigram vocabulary.

    An Aho-Corasick automaton lists all pieces that end at each character, longest
    first; the best score and its piece count are carried along, and only a strictly better score
    replaces one, so the earliest start wins a tie. A character that is no
    piece costs ten below the worst score and counts as its bytes."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.automaton = ahocorasick.Automaton()
        for piece, i in vocabulary.ids.items():
            self.automaton.add_word(piece, (len(piece), float(vocabulary.score[i])))
        self.automaton.make_automaton()
        self.known: dict[str, int] = {}

    def word(self, w: str) -> int:
        """Tokens of a space and then ``w``."""
        s = " " + w
        best, count = [0.0], [0]
        ends: list[list[tuple[int, float]]] = [[] for _ in s]
        for end, m in self.automaton.iter(s):
            ends[end].append(m)
        for e, found in enumerate(ends):
            top, n = None, 0
            single = False
            for length, score in found:
                at = e + 1 - length
                single |= length == 1
                x = best[at] + score
                if top is None or x > top:
                    top, n = x, count[at] + 1
            if not single:
                x = best[e] + self.v.unknown
                if top is None or x > top:
                    top, n = x, count[e] + len(s[e].encode())
            best.append(top)
            count.append(n)
        return count[-1]

    def count(self, text: str | None, most: int = 300_000) -> int:
        if not text:
            return 0
        ws, known = words(text), self.known
        new = set(ws).difference(known)
        if new:
            if len(known) > most:
                known.clear()
                new = set(ws)
            for w in new:
                known[w] = self.word(w)
        return sum(map(known.__getitem__, ws))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def keys_of(turns: np.ndarray, places: np.ndarray) -> np.ndarray:
    """The key of each occurrence of a word, from its text's key and its place there."""
    return mix(mix(turns ^ np.uint64(0xD6E8FEB86659FD93)) + places.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class Pairs:
    """Which piece two pieces make, by two hash tables: a pair is at its place in one of them, or in none."""

    def __init__(self, pairs: dict[tuple[int, int], int], size: int):
        self.bits, room = size.bit_length() + 1, max(4, (2 * len(pairs)).bit_length())
        self.shift = 64 - room
        held: list[dict[int, int]] = [{}, {}]
        for (a, b), made in pairs.items():
            now, t = (a << self.bits | b) << self.bits | made, 0
            for _ in range(1000):
                at = ((now >> self.bits) * TURNS[t] & 0xFFFFFFFFFFFFFFFF) >> self.shift
                out = held[t].get(at)
                held[t][at] = now
                if out is None:
                    break
                now, t = out, 1 - t
            else:
                raise ValueError("no place for a pair")
        self.tables = [np.full(1 << room, np.iinfo(np.int64).min) for _ in held]
        for t, h in zip(self.tables, held, strict=True):
            t[list(h)] = list(h.values())

    def of(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The piece of each pair, -1 where there is none; numbers below zero are no pieces."""
        key = (a.astype(np.int64) << self.bits) | b
        found = []
        for t, turn in zip(self.tables, TURNS, strict=True):
            got = t[((key.view(np.uint64) * np.uint64(turn)) >> np.uint64(self.shift)).view(np.int64)]
            found.append(np.where((got >> self.bits) == key, got & ((1 << self.bits) - 1), -1))
        return np.maximum(*found).astype(np.int32)


class MergeDropout:
    """Merges by priority, each candidate skipped at ``rate`` by a hash of seed, text, place of the word and turn of the candidate.

    Candidates come up in one order, best first, so the skips of an occurrence are the numbers of
    the candidates that it passes over, and each gap between two of them is drawn from a keyed hash.
    A word with given skips has one outcome, which is remembered; which skips an occurrence
    has never depends on what is remembered. ``most`` bounds the memory only."""

    def __init__(self, vocabulary: Vocabulary, seed: int, rate: float, most: int = 400_000):
        self.v, self.seed, self.rate, self.most = vocabulary, seed, rate, most
        v = vocabulary
        order = np.argsort(-v.score, kind="stable")
        self.rank = np.empty(len(order), np.int32)  # equal scores share a rank, so the leftmost goes first
        ranked = v.score[order]
        self.rank[order] = np.concatenate([[0], np.cumsum(ranked[1:] != ranked[:-1])])
        pairs = {(v.ids[p[:i]], v.ids[p[i:]]): j for p, j in v.ids.items() for i in range(1, len(p)) if p[:i] in v.ids and p[i:] in v.ids}
        self.pairs = Pairs(pairs, len(order))
        self.char_id = np.full(0x110000, -2, np.int32)
        for p, i in v.ids.items():
            if len(p) == 1:
                self.char_id[ord(p)] = i
        self.clear()

    def clear(self) -> None:
        """Forgets all outcomes. Outcome ``i`` is of word ``word[i]`` with the skips of outcome ``source[i]`` and then ``last[i]``, after ``used[i]`` candidates."""
        self.root: dict[str, int] = {}  # the outcome of each word without skips
        self.child: dict[int, int] = {}  # from outcome << 32 | next skip
        self.word: list[str] = []
        self.out: list[bytes] = []
        self.source, self.last, self.used = (np.empty(0, np.int64) for _ in range(3))

    def gaps(self, keys: np.ndarray, k: int) -> np.ndarray:
        """How many candidates each key lets pass after its skip ``k - 1``: ``g`` or more with probability (1 - rate) ** g."""
        if self.rate <= 0:
            return np.full(len(keys), NONE, np.int64)
        if self.rate >= 1:
            return np.zeros(len(keys), np.int64)
        h = mix(keys + np.uint64((k + 1) * 0xA0761D6478BD642F & 0xFFFFFFFFFFFFFFFF))
        u = ((h >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53
        return np.minimum(np.log(u) / np.log1p(-self.rate), NONE).astype(np.int64)

    def _key(self, variant: int) -> np.ndarray:
        return keys_of(np.array([variant & 0xFFFFFFFFFFFFFFFF], np.uint64), np.zeros(1))

    def agenda(self, word: str, variant: int) -> list[int]:
        """Ids of a space and then ``word`` at the first place of a text of key ``variant``."""
        return self._agenda(word, self._key(variant))

    def _agenda(self, word: str, key: np.ndarray) -> list[int]:
        """One merge after another from a heap."""
        s, ids, rank = " " + word, self.v.ids, self.rank
        n = len(s)
        end, before, alive = [i + 1 for i in range(n)], [i - 1 for i in range(n)], [True] * n
        heap: list[tuple[int, int, int, int]] = []

        def add(left: int, mid: int) -> None:
            if left < 0 or mid >= n:
                return
            got = ids.get(s[left : end[mid]])
            if got is not None and s[left:mid] in ids and s[mid : end[mid]] in ids:
                heapq.heappush(heap, (int(rank[got]), left, mid, end[mid]))

        for i in range(n - 1):
            add(i, i + 1)
        turn, k, skip = 0, 0, int(self.gaps(key, 0)[0])
        while heap:
            _, left, mid, stop = heapq.heappop(heap)
            if not (alive[left] and alive[mid]) or end[left] != mid or end[mid] != stop:
                continue
            turn += 1
            if turn > skip:
                k += 1
                skip += 1 + int(self.gaps(key, k)[0])
                continue
            end[left], alive[mid] = stop, False
            if stop < n:
                before[stop] = left
            add(before[left], left)
            add(left, stop)
        out: list[int] = []
        for i in range(n):
            if alive[i]:
                got = ids.get(s[i : end[i]])
                out += [got] if got is not None else self.v.char_bytes(s[i])
        return out

    def _candidates(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        got = self.pairs.of(a, b)
        return np.where(got >= 0, self.rank[got], NONE)

    def batch(self, some: list[str], variant: int) -> list[bytes]:
        """What :meth:`agenda` gives for each word, as raw 32-bit ids."""
        return self._outcomes(some, np.repeat(self._key(variant), len(some)))

    def _grow(self, some: list[str], source: np.ndarray, last: np.ndarray, k: int) -> range:
        """New outcomes, of words with ``k`` skips each; all words of a width at once."""
        out, used = [b""] * len(some), np.zeros(len(some), np.int64)
        plan = np.empty((len(some), k), np.int64)
        at, skip = source, last
        for i in range(k - 1, -1, -1):
            plan[:, i], at, skip = skip, self.source[at], self.last[at]
        by_len: dict[int, list[int]] = {}
        for i, w in enumerate(some):
            by_len.setdefault((len(w) + 4) // 4 * 4, []).append(i)
        for width, rows in by_len.items():
            for at in range(0, len(rows), 8192):
                self._wide(some, plan, rows[at : at + 8192], width, out, used)
        first = len(self.out)
        self.word += some
        self.out += out
        self.source, self.last, self.used = (np.concatenate(p) for p in ((self.source, source), (self.last, last), (self.used, used)))
        return range(first, len(self.out))

    def _wide(self, some: list[str], plan: np.ndarray, rows: list[int], width: int, out: list, used: np.ndarray) -> None:
        texts = [(" " + some[i]).ljust(width, "\0") for i in rows]
        n = np.array([len(some[i]) + 1 for i in rows])
        side = width + 1  # the last column stands for what is beside a word
        done_ids = np.full((len(rows), side), -3, np.int32)
        done_ids[:, :width] = self.char_id[np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)].reshape(-1, width)
        done_ids[:, :width][np.arange(width) >= n[:, None]] = -3
        plan = plan[rows]
        cand = np.full(done_ids.shape, NONE, np.int32)
        cand[:, : width - 1] = self._candidates(done_ids[:, : width - 1], done_ids[:, 1:width])
        after = np.tile(np.append(np.arange(1, side), width).astype(np.int32), (len(rows), 1))
        before = np.tile(np.append(width, np.arange(width)).astype(np.int32), (len(rows), 1))
        ids, live, turns, turn = done_ids, np.arange(len(rows)), np.zeros(len(rows), np.int64), 0
        while True:
            j = cand.argmin(axis=1)
            line = np.arange(len(live)) * side
            go = np.flatnonzero(cand.ravel()[line + j] < NONE)
            if 4 * len(go) < 3 * len(live):
                done_ids[live] = ids
                if not len(go):
                    break
                ids, plan, cand, after, before, live, j = ids[go], plan[go], cand[go], after[go], before[go], live[go], j[go]
                line, go = line[: len(go)], np.arange(len(go))
            turns[live[go]] += 1
            c, i, fore, back = cand.ravel(), ids.ravel(), after.ravel(), before.ravel()
            if plan.shape[1]:
                passed = (plan[go] == turn).any(axis=1)
                c[line[go[passed]] + j[go[passed]]] = NONE
                go = go[~passed]
            turn += 1
            first, j = line[go], j[go]
            left = first + j
            mid = first + fore[left]
            beyond = fore[mid]
            i[left] = whole = self.pairs.of(i[left], i[mid])
            i[mid], c[mid] = -3, NONE
            fore[left], back[first + beyond] = beyond, j
            ahead = first + back[left]
            c[left], c[ahead] = self._candidates(whole, i[first + beyond]), self._candidates(i[ahead], whole)
        used[rows] = turns
        has = done_ids != -3
        ends = (4 * np.cumsum(has.sum(axis=1))).tolist()
        flat = done_ids[has].astype("<i4").tobytes()
        start = 0
        for i, end in zip(rows, ends, strict=True):
            out[i] = flat[start:end]
            start = end
        for x in np.nonzero((done_ids == -2).any(axis=1))[0].tolist():
            s = " " + some[rows[x]]
            unknown = iter([c for c in s if self.char_id[ord(c)] == -2])  # never merged, so they stay in order
            ids = np.frombuffer(out[rows[x]], "<i4").tolist()
            out[rows[x]] = np.array([y for t in ids for y in ([t] if t >= 0 else self.v.char_bytes(next(unknown)))], "<i4").tobytes()

    def _outcomes(self, some: list[str], keys: np.ndarray) -> list[bytes]:
        """Raw 32-bit ids of each word with its key's own skips."""
        if len(self.out) > self.most:
            self.clear()
        new = set(some).difference(self.root)
        long = [w for w in new if len(w) >= LONG]
        short = [w for w in new if len(w) < LONG]
        self.root.update(zip(short, self._grow(short, none := np.full(len(short), -1), none, 0), strict=True))
        self.root.update(dict.fromkeys(long, -1))
        node = np.array(list(map(self.root.__getitem__, some)), np.int64)
        for w in long:
            del self.root[w]
        at, k = np.nonzero(node >= 0)[0], 0
        skip = np.full(len(at), -1, np.int64)
        while len(at):
            skip = skip + 1 + self.gaps(keys[at], k)
            more = skip < self.used[node[at]]
            at, skip, k = at[more], skip[more], k + 1
            to, back = np.unique(node[at] << 32 | skip, return_inverse=True)
            next_ = np.array([self.child.get(x, -1) for x in to.tolist()], np.int64)
            new = np.flatnonzero(next_ < 0)
            source, last = to[new] >> 32, to[new] & 0xFFFFFFFF
            grown = self._grow(list(map(self.word.__getitem__, source.tolist())), source, last, k)
            self.child.update(zip(to[new].tolist(), grown, strict=True))
            next_[new] = grown
            node[at] = next_[back]
        got = list(map(self.out.__getitem__, node.tolist())) if self.out else [b""] * len(some)
        for i in np.nonzero(node < 0)[0].tolist():
            got[i] = np.array(self._agenda(some[i], keys[i : i + 1]), "<i4").tobytes()
        return got

    def learn(self, texts: list[list[str]], turns: list[int]) -> list[np.ndarray]:
        """Ids of each text of words, by its key. Outcomes stay known for the texts to come."""
        sizes = [len(ws) for ws in texts]
        ends = np.cumsum(sizes)
        places = np.arange(sum(sizes)) - np.repeat(ends - sizes, sizes)
        keys = keys_of(np.repeat(np.array(turns, np.uint64), sizes), places)
        got = self._outcomes([w for ws in texts for w in ws], keys)
        return [np.frombuffer(b"".join(got[end - n : end]), "<i4") for n, end in zip(sizes, ends.tolist(), strict=True)]

    def encode(self, ws: list[str], turn: int) -> np.ndarray:
        return self.learn([ws], [turn])[0]


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    return Vocabulary(path)


@lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(vocabulary(path))


@lru_cache(maxsize=2)
def encoder(path: str, seed: int, rate: float) -> MergeDropout:
    return MergeDropout(vocabulary(path), seed, rate)


def turn_of(doc_id: int | None, seed: int) -> int:
    return xxhash.xxh64_intdigest(str(doc_id).encode(), seed)


def _counted(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    c = counter(path)
    try:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([c.count(t.as_py()) for t in b.column(1)], pa.int64())], names=["doc_id", "n_tokens"])
    finally:  # the worker lives on, and may run other operators next
        c.known.clear()
        give_back()


def token_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = MODEL) -> DataFrame:
    """(doc_id, n_tokens) for every row: the pieces of the best unigram segmentation of the whole text.

    Pieces and scores are those of the vocabulary file at ``path``; the scores are integers,
    so sums are exact. 0 for a null or empty text. Repeated rows come back as
    often, other columns are left out, an empty table gives an empty one."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(lambda it: _counted(it, path), f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens long")


def _encoded(batches: Iterator[pa.RecordBatch], path: str, seed: int, rate: float, chunk: int = 1 << 21) -> Iterator[pa.RecordBatch]:
    e = encoder(path, seed, rate)
    try:
        for b in batches:
            at = 0
            texts, keys = b.column(1), b.column(0).to_pylist()
            while at < b.num_rows:
                some: list[str] = []
                size = 0
                while at + len(some) < b.num_rows and size < chunk:
                    some.append(texts[at + len(some)].as_py() or "")
                    size += len(some[-1])
                split = [words(t) if t else [] for t in some]
                turns = [turn_of(k, seed) for k in keys[at : at + len(some)]]
                ids = e.learn(split, turns)
                back = [e.v.decode(x.tolist()) == t for x, t in zip(ids, some, strict=True)]
                ends = np.concatenate([[0], np.cumsum([len(x) for x in ids])]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(ids) if ids else np.empty(0, np.int32)))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, len(some)), lists, pa.array(back)], names=["doc_id", "ids", "lossless"])
                at += len(some)
    finally:  # the worker lives on, and may run other operators next
        some = split = ids = back = ends = lists = texts = keys = b = None
        e.clear()
        give_back()


def encode(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = MODEL, seed: int = 17, rate: float = 0.1) -> DataFrame:
    """(doc_id, ids, lossless) for every row: the pieces of the whole text, and whether decoding them gives the text back.

    Merges are skipped at ``rate`` by a keyed hash of the id and the word's place in the text, so every
    occurrence of a word is drawn on its own, from all segmentations that skips can give. An empty text or a null one has no pieces.
    Repeated rows are encoded alike, a null id counts as a key of its own, other columns are left
    out, an empty table gives an empty one."""
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lambda it: _encoded(it, path, seed, rate), f"doc_id {kind}, ids array<int>, lossless boolean")


def _decoded(batches: Iterator[pa.RecordBatch], path: str) -> Iterator[pa.RecordBatch]:
    v = vocabulary(path)
    for b in batches:
        yield pa.RecordBatch.from_arrays([b.column(0), pa.array([None if x is None else v.decode(x) for x in b.column(1).to_pylist()], pa.string())], names=["doc_id", "text"])


def decode(encoded: DataFrame, path: str = MODEL) -> DataFrame:
    """(doc_id, text) from (doc_id, ids); null for null ids."""
    kind = encoded.schema["doc_id"].dataType.simpleString()
    return encoded.select("doc_id", "ids").mapInArrow(lambda it: _decoded(it, path), f"doc_id {kind}, text string")


def op1_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))


def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents")).select("doc_id", F.size("ids").cast("long").alias("n_pieces"), "ids", "lossless")
