"""Operator 10: SentencePiece BPE encoding and decoding by a prefix table.

For every prefix of a text the table keeps the one token that ends the prefix's encoding. A candidate is a piece that an
automaton over reversed pieces matches backwards from the prefix's end; it is the right one if the pair of it and the last
token of the prefix before it is compatible, that is, if BPE never merges across their border. The ids are then read off
backwards from the last prefix. Time is linear in the text, whatever its length.

Merges are typed by the merged piece only: any two neighbours whose concatenation is a piece can merge, the highest score
first, then the leftmost.

Encoding splits before each run of spaces, since no piece holds a space after another character (a model in which one does
is rejected), so distinct words are encoded once for a batch, all at once in numpy.

Null texts count as empty. An empty text has no ids besides begin and end. Text of any length is encoded whole. Equal texts get
equal ids, repeated rows each give a row, an empty table gives none. Columns named ids or decoded give way, others are carried along.
"""

from __future__ import annotations

import hashlib
import re

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from emberframe.llm.common import adding, runs

SPACE = "▁"
#: Words in a worker's cache, and the length up to which a word is encoded together with others.
CACHE_WORDS, BATCH_LEN = 200_000, 40
#: Characters whose ids a worker holds at once.
PART_CHARS = 1 << 22
NORMAL, UNKNOWN, CONTROL, USER_DEFINED, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
PAIR_SLOTS_LOG2 = 21


def _fields(data: bytes):
    """(number, value) of a protocol buffer message."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = data[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(data):
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            size = varint()
            yield key >> 3, data[at : at + size]
            at += size
        else:
            size = 4 if kind == 5 else 8
            yield key >> 3, data[at : at + size]
            at += size


class _Lookup:
    """An open-addressing table from 64-bit keys to non-negative ints; -1 for other keys."""

    def __init__(self, table: dict[int, int]):
        self.shift = np.uint64(64 - max(4, int(np.ceil(np.log2(max(len(table), 1) * 6)))))
        size = 1 << (64 - int(self.shift))
        self.keys, self.values = np.full(size, 2**64 - 1, dtype=np.uint64), np.full(size, -1, dtype=np.int32)
        for k, v in table.items():
            i = ((k * 0x9E3779B97F4A7C15) & (2**64 - 1)) >> int(self.shift)
            while self.values[i] >= 0:
                i = (i + 1) % size
            self.keys[i], self.values[i] = k, v

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        at = ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)
        out = self.values[at]
        wrong = np.flatnonzero((self.keys[at] != keys) & (out >= 0))
        while len(wrong):
            out[wrong] = -1
            at[wrong] = (at[wrong] + 1) % len(self.keys)
            found = self.values[at[wrong]]
            same = self.keys[at[wrong]] == keys[wrong]
            out[wrong[same]] = found[same]
            wrong = wrong[~same & (found >= 0)]
        return out


class PieceModel:
    """The tables of a BPE model file: pieces, merge order, last merges, and the automaton over reversed pieces."""

    def __init__(self, path: str):
        pieces, trainer, normalizer = [], {}, {}
        for number, value in _fields(open(path, "rb").read()):
            if number == 1:
                f = dict(_fields(value))
                pieces.append((f[1].decode(), float(np.frombuffer(f.get(2, b"\0" * 4), "<f4")[0]), f.get(3, NORMAL)))
            elif number == 2:
                trainer = dict(_fields(value))
            elif number == 3:
                normalizer = dict(_fields(value))
        if trainer.get(3) != 2:
            raise ValueError("not a BPE model")
        if normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(5, 1) or trainer.get(24, 0):
            raise ValueError("only models without character maps, that keep and escape spaces, are supported")
        kinds = [k for _, _, k in pieces]
        if USER_DEFINED in kinds or BYTE not in kinds:
            raise ValueError("only models with byte pieces and without user-defined symbols are supported")
        self.dummy_prefix = bool(normalizer.get(3, 1))
        self.pieces, self.n = [p for p, _, _ in pieces], len(pieces)
        self.bos, self.eos = self.pieces.index("<s>"), self.pieces.index("</s>")
        self.byte_id = {int(p[3:5], 16): i for i, (p, _, k) in enumerate(pieces) if k == BYTE}
        self.byte_ids = np.array([self.byte_id[b] for b in range(256)], dtype=np.uint32)
        self.kinds = np.array(kinds)
        self.id_of = {p: i for i, (p, _, k) in enumerate(pieces) if k == NORMAL}
        if any(SPACE in p.lstrip(SPACE) for p in self.id_of):
            raise ValueError("a piece holds a space after another character")
        #: Runs of spaces tie in score: they follow a rule of their own and come after all other merges.
        self.space_runs = {len(p): i for p, i in self.id_of.items() if not p.strip(SPACE)}
        own = [(s, p, i) for (p, s, k), i in zip(pieces, range(self.n)) if k == NORMAL and (len(p) == 1 or p.strip(SPACE))]
        long = sorted((-s, i) for s, p, i in own if len(p) > 1)
        if len({s for s, _ in long}) < len(long):
            raise ValueError("two pieces have one score")
        if long and any(pieces[i][1] >= -long[-1][0] for k, i in self.space_runs.items() if k > 1):
            raise ValueError("runs of spaces must have the lowest score")
        self.rank = [-1] * self.n
        for r, (_, i) in enumerate(long):
            self.rank[i] = r
        self.left, self.right = [-1] * self.n, [-1] * self.n
        ends: dict[str, int] = {p: i for _, p, i in own if len(p) == 1}
        for _, i in long:
            if self._split(i):
                ends[self.pieces[i]] = i
        self._automaton(ends)

    def _split(self, i: int) -> bool:
        """Finds the last merge of piece i; False if BPE never makes the piece from its own characters."""
        parts = [self.id_of.get(c, -1) for c in self.pieces[i]]
        while len(parts) > 1:
            best = None
            for k in range(len(parts) - 1):
                if parts[k] >= 0 and parts[k + 1] >= 0:
                    m = self.id_of.get(self.pieces[parts[k]] + self.pieces[parts[k + 1]], -1)
                    if m >= 0 and self.rank[m] >= 0 and (best is None or self.rank[m] < self.rank[best[1]]):
                        best = (k, m)
            if best is None:
                return False
            k, m = best
            if len(parts) == 2:
                self.left[m], self.right[m] = parts
            parts[k : k + 2] = [m]
        return parts[0] == i

    def _automaton(self, ends: dict[str, int]) -> None:
        """States of the trie over reversed pieces; the piece that each state ends."""
        step: dict[int, int] = {}
        piece = [-1]
        for p, i in ends.items():
            state = 0
            for c in reversed(p):
                key = (state << 21) | ord(c)
                if key not in step:
                    step[key] = len(piece)
                    piece.append(-1)
                state = step[key]
            piece[state] = i
        self.longest = max(map(len, ends), default=1)
        self.step, self.step_of, self.piece_at = step, _Lookup(step), np.array(piece, dtype=np.int32)
        self.piece_list = piece

    def compatible(self, a: int, b: int) -> bool:
        """Whether BPE leaves the border between tokens a and b alone: their merges are undone from the last backwards, and at no moment may the two symbols at the border merge before either takes part in its own next merge."""
        never = self.n + 1
        ends_a = ends_b = never
        while True:
            m = self.id_of.get(self.pieces[a] + self.pieces[b], -1)
            if m >= 0 and (r := self.rank[m]) >= 0 and r < ends_a and r <= ends_b:
                return False
            ra, rb = self.rank[a], self.rank[b]
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                ends_a, a = ra, self.right[a]
            else:
                ends_b, b = rb, self.left[b]


class Encoder:
    """Encodes and decodes with a PieceModel; keeps the words that it has met, up to CACHE_WORDS."""

    def __init__(self, model: PieceModel):
        self.model = model
        self.words: dict[str, bytes] = {}
        self.pair_keys = np.full(1 << PAIR_SLOTS_LOG2, 2**64 - 1, dtype=np.uint64)
        self.pair_valid = np.zeros(1 << PAIR_SLOTS_LOG2, dtype=bool)
        self.pairs: dict[tuple[int, int], bool] = {}
        m = model
        text = [p.replace(SPACE, " ").encode() if k == NORMAL else bytes([int(p[3:5], 16)]) if k == BYTE else b" \xe2\x81\x87 " if k == UNKNOWN else b"" for p, k in zip(m.pieces, m.kinds)]
        self.out_len = np.array([len(t) for t in text], dtype=np.int64)
        self.out_at = np.cumsum(self.out_len) - self.out_len
        self.out = np.frombuffer(b"".join(text), dtype=np.uint8)

    # -- one long word at a time

    def _pair(self, a: int, b: int) -> bool:
        if (v := self.pairs.get((a, b))) is None:
            if len(self.pairs) > 1_000_000:
                self.pairs.clear()
            v = self.pairs[a, b] = self.model.compatible(a, b)
        return v

    def _one(self, word: str) -> bytes:
        m, last, size = self.model, [], []
        step, piece = m.step, m.piece_list
        points = [ord(c) for c in word]
        for i in range(len(points)):
            state, found = 0, False
            for n in range(1, min(i + 1, m.longest) + 1):
                state = step.get((state << 21) | points[i - n + 1], -1)
                if state < 0:
                    break
                t = piece[state]
                if t >= 0 and (n == i + 1 or last[i - n] < 0 or self._pair(last[i - n], t)):
                    last.append(t)
                    size.append(n)
                    found = True
                    break
            if not found:
                last.append(-1)
                size.append(1)
        ids: list[int] = []
        i = len(points) - 1
        while i >= 0:
            if last[i] < 0:
                ids.extend(m.byte_id[b] for b in reversed(word[i].encode("utf-8", "surrogatepass")))
            else:
                ids.append(last[i])
            i -= size[i]
        return np.array(ids[::-1], dtype="<u2" if m.n <= 65536 else "<u4").tobytes()

    # -- many short words at once

    def _pairs(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = (a.astype(np.uint64) << np.uint64(32)) | b.astype(np.uint64)
        slot = ((key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - PAIR_SLOTS_LOG2)).astype(np.int64)
        out = self.pair_valid[slot]
        new = np.flatnonzero(self.pair_keys[slot] != key)
        if len(new):
            some, back = np.unique(key[new], return_inverse=True)
            valid = np.fromiter((self.model.compatible(k >> 32, k & 0xFFFFFFFF) for k in some.tolist()), dtype=bool, count=len(some))
            out[new] = valid[back]
            self.pair_keys[slot[new]] = key[new]
            self.pair_valid[slot[new]] = out[new]
        return out

    def _many(self, words: list[str]) -> list[tuple[str, bytes]]:
        """The ids of each word with one space before it."""
        m = self.model
        words = sorted(words, key=len, reverse=True)
        lens = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1
        starts = np.cumsum(lens) - lens
        points = np.frombuffer((SPACE + SPACE.join(words)).encode("utf-32-le", "surrogatepass"), dtype="<u4").astype(np.uint64)
        last, size = np.full(len(points), -1, dtype=np.int32), np.ones(len(points), dtype=np.int64)
        for i in range(int(lens[0])):
            pos = starts[: int(np.searchsorted(-lens, -i, side="left"))] + i  # words longer than i
            state = np.zeros(len(pos), dtype=np.uint64)
            for n in range(1, min(i + 1, m.longest) + 1):
                nxt = m.step_of((state << np.uint64(21)) | points[pos - (n - 1)])
                go = nxt >= 0
                pos, nxt = pos[go], nxt[go]
                if not len(pos):
                    break
                t = m.piece_at[nxt]
                if n == i + 1:
                    hit = t >= 0
                else:
                    hit = np.zeros(len(pos), dtype=bool)
                    cand = np.flatnonzero(t >= 0)
                    before = last[pos[cand] - n]
                    ok = before < 0
                    rest = np.flatnonzero(~ok)
                    ok[rest] = self._pairs(before[rest], t[cand[rest]])
                    hit[cand[ok]] = True
                last[pos[hit]], size[pos[hit]] = t[hit], n
                pos, state = pos[~hit], nxt[~hit].astype(np.uint64)
        ends = np.zeros(len(points), dtype=bool)
        at, begin = starts + lens - 1, starts
        while len(at):
            ends[at] = True
            at = at - size[at]
            more = at >= begin
            at, begin = at[more], begin[more]
        at = np.flatnonzero(ends)
        ids, point = last[at].astype(np.int64), points[at]
        count = np.ones(len(at), dtype=np.int64)
        unknown = np.flatnonzero(ids < 0)
        if len(unknown):
            c = point[unknown]
            count[unknown] = 1 + (c >= 0x80) + (c >= 0x800) + (c >= 0x10000)
        to = np.cumsum(count)
        out = np.repeat(ids, count)
        for k in range(4):
            has = unknown[count[unknown] > k]
            n, c = count[has], point[has]
            tail = (c >> (6 * (n - 1 - k)).astype(np.uint64)) & np.uint64(0x3F) | np.uint64(0x80)
            if k == 0:
                mark = np.array([0, 0, 0xC0, 0xE0, 0xF0], dtype=np.uint64)[n]
                tail = np.where(n == 1, c, mark | (c >> (6 * (n - 1)).astype(np.uint64)))
            out[to[has] - n + k] = m.byte_ids[tail.astype(np.int64)]
        per = np.concatenate([[0], to])[np.searchsorted(at, np.concatenate([starts, [len(points)]]))]
        flat, width = out.astype("<u2" if m.n <= 65536 else "<u4").tobytes(), 2 if m.n <= 65536 else 4
        cut = (per * width).tolist()
        return [(w, flat[cut[k] : cut[k + 1]]) for k, w in enumerate(words)]

    # -- texts

    def _learn(self, new: set[str]) -> None:
        if len(self.words) + len(new) > CACHE_WORDS:
            self.words.clear()
        for w in [w for w in new if len(w) > BATCH_LEN]:
            self.words[w] = self._one(SPACE + w)
        short = [w for w in new if len(w) <= BATCH_LEN]
        for k in range(0, len(short), 50_000):
            self.words.update(self._many(short[k : k + 50_000]))

    def _spaces(self, n: int) -> list[int]:
        """The pieces of n spaces: the leftmost two that can merge do so first."""
        runs, ids = self.model.space_runs, []
        while n:
            size = 1
            ahead = 1
            while size + ahead <= n:  # grow by one space, or by a pair or more that meanwhile grew at its right
                if size + ahead in runs:
                    size, ahead = size + ahead, 1
                elif ahead + 1 in runs:
                    ahead += 1
                else:
                    break
            ids.append(runs[size])
            n -= size
        return ids

    def _parts(self, text: str) -> list[str]:
        """The words with one leading space each, and runs of spaces."""
        if self.model.dummy_prefix:
            text = SPACE + text
        return re.findall(f"{SPACE}*[^{SPACE}]+|{SPACE}+", text)

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """The ids of each text, without begin and end."""
        dtype = "<u2" if self.model.n <= 65536 else "<u4"
        split: list[list[str] | None] = []
        new: set[str] = set()
        for t in texts:
            if not t:
                split.append(None)
                continue
            t = t.replace(" ", SPACE)
            if self.model.dummy_prefix and SPACE * 2 not in t and t[0] != SPACE and t[-1] != SPACE:
                parts = t.split(SPACE)  # words between single spaces; each stands for itself after one space
                split.append(parts)
                new.update(parts)
            else:
                parts = self._parts(t)
                split.append(["", *parts])
                new.update(p.lstrip(SPACE) for p in parts)
        new.discard("")
        keep = new - self.words.keys()
        if keep:
            if len(self.words) + len(keep) > CACHE_WORDS:
                keep = new
            self._learn(keep)
        words, out = self.words, []
        for parts in split:
            if not parts:
                out.append(np.zeros(0, dtype=dtype))
            elif parts[0] != "" or len(parts) == 1:
                out.append(np.frombuffer(b"".join([words[w] for w in parts]), dtype=dtype))
            else:
                out.append(np.frombuffer(b"".join(map(self._run, parts[1:])), dtype=dtype))
        return out

    def _run(self, part: str) -> bytes:
        """A run of spaces, then a word or none. The word's own merges, one space included, come before any of spaces."""
        word, dtype = part.lstrip(SPACE), "<u2" if self.model.n <= 65536 else "<u4"
        n = len(part) - len(word)
        if not word:
            return np.array(self._spaces(n), dtype=dtype).tobytes()
        if not n:
            return self._one(word)
        ids = self.words[word]
        if n == 1:
            return ids
        lone = np.array([self.model.space_runs[1]], dtype=dtype).tobytes()
        if ids.startswith(lone):
            return np.array(self._spaces(n), dtype=dtype).tobytes() + ids[len(lone) :]
        return np.array(self._spaces(n - 1), dtype=dtype).tobytes() + ids

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: control pieces vanish, byte pieces join to characters, the first space goes."""
        if not len(ids):
            return ""
        ids = ids.astype(np.int64)
        n = self.out_len[ids]
        to = np.cumsum(n)
        at = np.arange(int(to[-1])) + np.repeat(self.out_at[ids] - (to - n), n)
        text = self.out[at].tobytes().decode("utf-8", "replace")
        return text[1:] if self.model.dummy_prefix and text.startswith(" ") else text


def encode(docs: DataFrame, model_path: str, text: str = "text", *, add_begin: bool = True, add_end: bool = True, decoded: bool = True) -> DataFrame:
    """docs with ids (array of int) and, if wanted, decoded (string); any columns of those names give way."""
    fields = [T.StructField("ids", T.ArrayType(T.IntegerType())), *[T.StructField("decoded", T.StringType())] * decoded]

    def give(ids, texts):
        return [[i.astype(np.int32) for i in ids], *[texts] * decoded]

    return _added(docs, model_path, text, add_begin, add_end, give, fields, decoded)


def digests(docs: DataFrame, model_path: str, text: str = "text", *, id_column: str = "doc_id", add_begin: bool = True, add_end: bool = True) -> DataFrame:
    """For each row of docs: its id, n_tokens, ids_sha256 (of the ids as little-endian 32-bit integers) and decoded_sha256."""
    fields = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]

    def give(ids, texts):
        return [[len(i) for i in ids], [hashlib.sha256(i.astype("<u4").tobytes()).hexdigest() for i in ids], [hashlib.sha256(t.encode("utf-8", "surrogatepass")).hexdigest() for t in texts]]

    found = _added(docs.select(id_column, text), model_path, text, add_begin, add_end, give, fields)
    return found.select(id_column, *[f.name for f in fields])


def _added(docs: DataFrame, model_path: str, text: str, add_begin: bool, add_end: bool, give, fields: list, decoded: bool = True) -> DataFrame:
    # The tables' size is that of the vocabulary, a few MB.
    model = docs.sparkSession.sparkContext.broadcast(PieceModel(model_path))

    def make():
        encoder = Encoder(model.value)
        first, last = [model.value.bos] * add_begin, [model.value.eos] * add_end
        begin, end = np.array(first, dtype=np.uint32), np.array(last, dtype=np.uint32)

        def values(texts):
            made, texts = [[] for _ in fields], [t or "" for t in texts]
            # a few million characters at a time, whatever the batch holds
            for a, b in runs(texts, PART_CHARS):
                ids = [np.concatenate([begin, i, end]) for i in encoder.encode(texts[a:b])]
                for column, part in zip(made, give(ids, [encoder.decode(i) for i in ids] if decoded else None)):
                    column += part
            return made

        return values

    return adding(docs.withColumn(text, F.col(text).cast("string")), text, make, fields)
