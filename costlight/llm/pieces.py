"""SentencePiece encoding and decoding by a batched numpy Viterbi.

A text is its code points with spaces as U+2581 and one more in front (as the model's settings say).
No piece crosses from a word into the next mark, so words are segmented one by one: each word that the
process doesn't remember once, words of equal length together. For each length of piece, the hashes of
all substrings of that length probe the sorted hashes of the pieces in one search; words then advance
together from one end of a piece to the next, and the best piece at each end is stored as backpointer.

What is best depends on how the pieces were learnt, for the ids are to be those of the library. Of a unigram
model it is the greatest sum of scores. In a model learnt by merging (BPE) sums of scores mean nothing: there a
step from one piece to the next is allowed where merging leaves these two pieces apart, and just one piece
at each end is reached by allowed steps (a vectorised maximum over nought and minus infinity). Merging leaves
two pieces apart if, going back through their merges from the last to the first, no pair across the border would have
been merged before the merge that took its left or right part away; ties go to the left.

A character without a piece becomes byte pieces. decode() gives back the exact text; a text's own U+2581 is
encoded as bytes so as not to turn into a space (the library cannot tell it from a space).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import vectext as V

U64 = np.uint64
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
MARK = 0x2581
#: Stands for a mark of the text itself; no piece holds it.
OWN_MARK = 0x110000
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6
CHUNK = 2 << 20
CELLS = 1_000_000
UNIGRAM = 1
#: Words of more characters are advanced one at a time, in time and memory that grow with their length only.
LONG_WORD = 2000
#: Words and code points that a process remembers at most; beyond that it starts anew.
MEMORY = 300_000
NEVER = 1 << 30
#: Size of the tables that tell which hashes are no piece's, and of the table of answers about pairs.
BITS = 17
ASKED_BITS = 19


def _fields(raw: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Fields of a protocol buffer message: number and integer or bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            shift += 7
            if b < 128:
                return value

    while at < len(raw):
        tag = varint()
        kind = tag & 7
        if kind == 0:
            yield tag >> 3, varint()
        else:
            size = varint() if kind == 2 else 8 if kind == 1 else 4
            yield tag >> 3, raw[at : at + size]
            at += size


def _token(cps: np.ndarray) -> np.ndarray:
    return V.mix(cps.astype(U64) + U64(1))



def _word_keys(cps: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64-bit hash of the code points of each word."""
    return V.word_hashes(np.ascontiguousarray(cps).view(np.uint8), 4 * start, 4 * end)


def _equal(a: np.ndarray, a0: np.ndarray, a1: np.ndarray, b: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> np.ndarray:
    """Whether words of a and b have the same code points, pair by pair; words are not empty."""
    same = (a1 - a0) == (b1 - b0)
    at = np.flatnonzero(same)
    if len(at):
        size = (a1 - a0)[at]
        edge = np.cumsum(size) - size
        place = np.arange(int(size.sum())) - np.repeat(edge, size)
        same[at] = np.logical_and.reduceat(a[place + np.repeat(a0[at], size)] == b[place + np.repeat(b0[at], size)], edge)
    return same


def _alike(cps: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """One word of each kind, and the kind of each word. Words that share a hash are compared."""
    _, first, same = np.unique(_word_keys(cps, start, end), return_index=True, return_inverse=True)
    lead = first[same]
    odd = np.flatnonzero(~_equal(cps, start, end, cps, start[lead], end[lead]))
    if len(odd):
        kinds: dict[bytes, int] = {}
        for k in odd.tolist():
            word = cps[start[k] : end[k]].tobytes()
            if word not in kinds:
                kinds[word] = len(first)
                first = np.append(first, k)
            same[k] = kinds[word]
    return first, same


class Memory:
    """Words that were segmented before, with their ids. A cache only: what it forgets is done again."""

    def __init__(self, most: int = MEMORY):
        self.most = most
        self.clear()

    def clear(self) -> None:
        self.keys, self.number = np.zeros(0, U64), np.zeros(0, np.int64)
        self.cps, self.word = np.zeros(0, np.int32), np.zeros(1, np.int64)
        self.ids, self.at = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def look(self, cps: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Number of each word, or -1."""
        out = np.full(len(start), -1)
        if len(self.keys):
            h = _word_keys(cps, start, end)
            k = np.minimum(np.searchsorted(self.keys, h), len(self.keys) - 1)
            at = np.flatnonzero(self.keys[k] == h)
            number = self.number[k[at]]
            good = _equal(cps, start[at], end[at], self.cps, self.word[number], self.word[number + 1])
            out[at[good]] = number[good]
        return out

    def keep(self, cps: np.ndarray, start: np.ndarray, end: np.ndarray, ids: np.ndarray, off: np.ndarray) -> np.ndarray:
        """Adds words and gives their numbers."""
        base = len(self.word) - 1
        own, edge = gather(cps, start, end - start)
        self.cps, self.word = np.concatenate([self.cps, own]), np.concatenate([self.word, self.word[-1] + edge[1:]])
        self.ids, self.at = np.concatenate([self.ids, ids]), np.concatenate([self.at, self.at[-1] + off[1:]])
        number = base + np.arange(len(start))
        keys = np.concatenate([self.keys, _word_keys(cps, start, end)])
        order = np.argsort(keys, kind="stable")
        self.keys, self.number = keys[order], np.concatenate([self.number, number])[order]
        return number

    def shrink(self) -> None:
        if len(self.keys) > self.most or len(self.cps) > 16 * self.most:
            self.clear()


def _ordinals(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)


def _merged(parts: list[str], rank: dict[str, int]) -> list[list[str]]:
    """All stages of merging the neighbours of least rank, the left ones first."""
    stages = [parts]
    while len(parts) > 1:
        best, at = min((rank.get(parts[k] + parts[k + 1], NEVER), k) for k in range(len(parts) - 1))
        if best == NEVER:
            break
        parts = [*parts[:at], parts[at] + parts[at + 1], *parts[at + 2 :]]
        stages.append(parts)
    return stages


@dataclass
class Pieces:
    """The pieces of a model as arrays. keys: sorted hashes of pieces of each length, with ids and scores.

    For models learnt by merging: ranks (0: not merged), the two parts of each piece's last merge, and the sorted
    pairs of pieces (left * size + right) that make a piece, with its rank. The unknown character has the id size.
    """

    longest: int
    keys: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]]
    unknown: float
    byte_ids: np.ndarray
    raw: np.ndarray
    raw_off: np.ndarray
    prefix: bool
    size: int
    rank: np.ndarray | None = None
    left: np.ndarray | None = None
    right: np.ndarray | None = None
    pairs: np.ndarray | None = None
    pair_rank: np.ndarray | None = None
    asked: np.ndarray | None = None
    answer: np.ndarray | None = None

    def __post_init__(self):
        self.bits = {}
        for size, (h, _, _) in self.keys.items():
            self.bits[size] = np.zeros(1 << BITS, bool)
            self.bits[size][h >> U64(64 - BITS)] = True

    def __getstate__(self):
        return {**self.__dict__, "bits": None, "asked": None, "answer": None}

    def __setstate__(self, state):
        self.__dict__.update(state)
        self.__post_init__()

    @classmethod
    def parse(cls, model: bytes) -> Pieces:
        """From the bytes of a model file."""
        texts, scores, kinds, prefix, learnt = [], [], [], True, UNIGRAM
        for number, value in _fields(model):
            if number == 1:
                text, score, kind = "", 0.0, NORMAL
                for k, v in _fields(value):
                    if k == 1:
                        text = v.decode()
                    elif k == 2:
                        score = float(np.frombuffer(v, "<f4")[0])
                    elif k == 3:
                        kind = v
                texts.append(text)
                scores.append(score)
                kinds.append(kind)
            elif number == 2:
                learnt = next((v for k, v in _fields(value) if k == 3), UNIGRAM)
            elif number == 3:
                prefix = next((bool(v) for k, v in _fields(value) if k == 3), True)
        least = min(s for s, k in zip(scores, kinds, strict=True) if k == NORMAL)
        own = {t: i for i, (t, k) in enumerate(zip(texts, kinds, strict=True)) if k in (NORMAL, USER) and t}
        if bad := next((t for t in own if chr(MARK) in t.lstrip(chr(MARK))), None):
            raise ValueError(f"piece {own[bad]} crosses words")
        extra = {}
        if learnt != UNIGRAM:
            order = {x: n for n, x in enumerate(sorted({-scores[i] for t, i in own.items() if len(t) > 1}), 1)}
            rank = {t: order[-scores[i]] for t, i in own.items() if len(t) > 1}
            parts = {}
            for t in rank:
                stages = _merged(list(t), rank)
                if len(stages[-1]) == 1 and all(x in own for x in stages[-2]):
                    parts[t] = stages[-2]
            own = {t: i for t, i in own.items() if len(t) == 1 or t in parts}  # no merging ends in the others
            n = len(texts)
            ranks, left, right = (np.zeros(n + 1, np.int64) for _ in range(3))
            pairs = {}
            for t, (x, y) in parts.items():
                i = own[t]
                ranks[i], left[i], right[i] = rank[t], own[x], own[y]
                for k in range(1, len(t)):
                    if t[:k] in own and t[k:] in own:
                        pairs[own[t[:k]] * (n + 1) + own[t[k:]]] = rank[t]
            at = np.array(sorted(pairs), np.int64)
            extra = {"rank": ranks, "left": left, "right": right, "pairs": at, "pair_rank": np.array([pairs[k] for k in at.tolist()], np.int64)}
        by: dict[int, list[tuple[int, int, float]]] = {}
        for size in {len(t) for t in own}:
            same = [(t, i) for t, i in own.items() if len(t) == size]
            hashes = V.Rolling(_token(_ordinals("".join(t for t, _ in same)))).grams(size)[::size]
            by[size] = [(h, i, scores[i]) for h, (_, i) in zip(hashes.tolist(), same, strict=True)]
        byte_ids = np.full(256, next(i for i, k in enumerate(kinds) if k == UNKNOWN), np.int32)
        raw: list[bytes] = []
        for i, (text, kind) in enumerate(zip(texts, kinds, strict=True)):
            if kind == BYTE:
                byte_ids[int(text[3:5], 16)] = i
                raw.append(bytes([int(text[3:5], 16)]))
            else:
                raw.append(text.replace(chr(MARK), " ").encode() if kind in (NORMAL, USER) else b"")
        keys = {}
        for size, rows in by.items():
            rows.sort()
            h, ids, s = zip(*rows, strict=True)
            keys[size] = (np.array(h, U64), np.array(ids, np.int32), np.array(s, np.float64))
        off = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
        return cls(max(by), keys, least - 10.0, byte_ids, np.frombuffer(b"".join(raw), np.uint8), off, prefix, len(texts), **extra)

    # -- encoding

    def _probe(self, cps: np.ndarray) -> tuple[np.ndarray, np.ndarray | None]:
        """Pieces that end at each place of the words, by length (longest first; -1: none), and in a unigram model their scores.

        Where no piece of one character is, the unknown stands.
        """
        u, n = cps.shape
        width = min(self.longest, n)
        rolling = V.Rolling(_token(cps.ravel()))
        score = np.full((u, n, width), -np.inf) if self.rank is None else None
        ident = np.full((u, n, width), -1, np.int32)
        flat = ident.reshape(u * n, width)
        for size in range(1, width + 1):
            if size not in self.keys:
                continue
            keys, ids, scores = self.keys[size]
            h = rolling.grams(size)
            at = np.flatnonzero(self.bits[size][h >> U64(64 - BITS)])
            at = at[at % n <= n - size]  # inside a word
            h = h[at]
            k = np.minimum(np.searchsorted(keys, h), len(keys) - 1)
            hit = keys[k] == h
            at, k = at[hit] + size - 1, k[hit]
            flat[at, width - size] = ids[k]
            if score is not None:
                score.reshape(u * n, width)[at, width - size] = scores[k]
        alone = ident[:, :, width - 1] < 0
        ident[:, :, width - 1][alone] = self.size
        if score is not None:
            score[:, :, width - 1][alone] = self.unknown
        return ident, score

    def _apart(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether merging leaves the pieces a and b apart, pair by pair; answers stand in a table by hash of the pair."""
        key = a.astype(np.int64) * (self.size + 1) + b
        slot = ((key.view(U64) * U64(V.BASE)) >> U64(64 - ASKED_BITS)).astype(np.int64)
        if self.asked is None:
            self.asked, self.answer = np.full(1 << ASKED_BITS, -1), np.zeros(1 << ASKED_BITS, bool)
        new = np.flatnonzero(self.asked[slot] != key)
        out = self.answer[slot]
        if len(new):
            ask, same = np.unique(key[new], return_inverse=True)
            answer = self._retrace(ask // (self.size + 1), ask % (self.size + 1))
            out[new] = answer[same]
            self.asked[slot[new]], self.answer[slot[new]] = key[new], out[new]
            wrong = slot[new][self.asked[slot[new]] != key[new]]  # of pairs that share a slot the last one stays
            if len(wrong):
                self.asked[wrong] = -1
        return out

    def _retrace(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """The same, by going back through the merges of both pieces."""
        out = np.ones(len(x), bool)
        live, limit = np.arange(len(x)), np.full(len(x), NEVER)
        while len(live):
            key = x * (self.size + 1) + y
            k = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
            joined = (self.pairs[k] == key) & (self.pair_rank[k] < limit)
            out[live[joined]] = False
            rx, ry = self.rank[x], self.rank[y]
            go = ~joined & (rx + ry > 0)
            undo = rx > ry  # of equal ones the left was merged first
            limit, x, y = np.where(undo, rx, ry + 1)[go], np.where(undo, self.right[x], x)[go], np.where(undo, y, self.left[y])[go]
            live = live[go]
        return out

    def _segment(self, cps: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Words of equal length, one a row: piece ids in order, flat (-1-c: character c without a piece), and pieces by word."""
        u, n = cps.shape
        width = min(self.longest, n)
        ident, score = self._probe(cps)
        back = np.zeros((u, n), np.int32)  # column of ident
        every = np.arange(u)
        if self.rank is None:
            best = np.full((u, n + width), -np.inf)  # best[:, width-1+j]: of the first j characters
            best[:, width - 1] = 0.0
            for j in range(n):
                total = best[:, j : j + width] + score[:, j, :]
                back[:, j] = total.argmax(1)
                best[:, width + j] = total[every, back[:, j]]
        else:
            chosen = np.empty((u, n), np.int64)
            for j in range(n):
                r, c = np.nonzero(ident[:, j, max(0, width - j - 1) :] >= 0)
                c += max(0, width - j - 1)
                inside = np.flatnonzero(width - c <= j)
                allowed = np.ones(len(r), bool)
                allowed[inside] = self._apart(chosen[r[inside], j - (width - c[inside])], ident[r[inside], j, c[inside]])
                r, c = r[allowed][::-1], c[allowed][::-1]
                back[r, j] = c  # the longest allowed one is written last
                chosen[:, j] = ident[every, j, back[:, j]]
        ends = np.zeros((u, n), bool)
        at = np.full(u, n)
        live = every
        while len(live):
            ends[live, at[live] - 1] = True
            at[live] -= width - back[live, at[live] - 1]
            live = live[at[live] > 0]
        r, c = np.nonzero(ends)
        ids = ident[r, c, back[r, c]]
        return np.where(ids == self.size, -1 - cps[r, c], ids).astype(np.int32), ends.sum(1)

    def _retrace_one(self, x: int, y: int, rank: list[int], left: list[int], right: list[int], pairs: dict[int, int]) -> bool:
        limit = NEVER
        while pairs.get(x * (self.size + 1) + y, NEVER) >= limit if limit < NEVER else (x * (self.size + 1) + y) not in pairs:
            rx, ry = rank[x], rank[y]
            if not rx and not ry:
                return True
            if rx > ry:
                limit, x = rx, right[x]
            else:
                limit, y = ry + 1, left[y]
        return False

    def _segment_long(self, cps: np.ndarray) -> np.ndarray:
        """One long word, slice by slice: five bytes a character are kept, and the scores or pieces of the last ends."""
        n, width, step = len(cps), self.longest, 1 << 14
        ident, length = np.empty(n, np.int32), np.empty(n, np.int8)
        best, seen = {0: 0.0}, {}
        lists = () if self.rank is None else (self.rank.tolist(), self.left.tolist(), self.right.tolist(), dict(zip(self.pairs.tolist(), self.pair_rank.tolist(), strict=True)))
        for s in range(0, n, step):
            lead = min(s, width - 1)
            pieces, scores = self._probe(cps[None, s - lead : s + step])
            pieces = pieces[0, lead:]
            scores = None if scores is None else scores[0, lead:]
            w = pieces.shape[1]
            if self.rank is not None:
                r, c = np.nonzero(pieces >= 0)
                edge = np.searchsorted(r, np.arange(len(pieces) + 1)).tolist()
                c = c.tolist()
            for j in range(len(pieces)):
                at = s + j
                if self.rank is None:
                    k = max((k for k in range(w) if w - k <= at + 1), key=lambda k: best[at + 1 - (w - k)] + scores[j, k])
                    best[at + 1] = best[at + 1 - (w - k)] + scores[j, k]
                    best.pop(at + 1 - width, None)
                else:
                    for k in c[edge[j] : edge[j + 1]]:
                        size, piece = w - k, int(pieces[j, k])
                        if size > at + 1:
                            continue
                        if size == at + 1:
                            break
                        pair = int(ident[at - size]), piece
                        if (ok := seen.get(pair)) is None:
                            ok = seen[pair] = self._retrace_one(*pair, *lists)
                            if len(seen) > MEMORY:
                                seen.clear()
                        if ok:
                            break
                ident[at], length[at] = pieces[j, k], w - k
        ends, at = [], n
        while at:
            ends.append(at - 1)
            at -= int(length[at - 1])
        ends = np.array(ends[::-1])
        return np.where(ident[ends] == self.size, -1 - cps[ends], ident[ends]).astype(np.int32)

    def _words(self, cps: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the words' pieces, flat in order of words, and their offsets; bytes stand for unknown characters."""
        size = end - start
        order = np.argsort(size, kind="stable")
        parts, counts, rows = [], [], []
        edge = np.concatenate([[0], np.flatnonzero(np.diff(size[order])) + 1, [len(order)]])
        for a, b in zip(edge[:-1].tolist(), edge[1:].tolist(), strict=True):
            n = int(size[order[a]])
            if n > LONG_WORD:
                for k in order[a:b].tolist():
                    parts.append(self._segment_long(cps[start[k] : end[k]]))
                    counts.append(np.array([len(parts[-1])]))
                rows.append(order[a:b])
                continue
            step = max(1, CELLS // (n * self.longest))
            for s in range(a, b, step):
                own = order[s : min(b, s + step)]
                ids, count = self._segment(cps[start[own][:, None] + np.arange(n)[None, :]])
                parts.append(ids)
                counts.append(count)
                rows.append(own)
        ids, count, row = np.concatenate(parts), np.concatenate(counts), np.concatenate(rows)
        odd = np.flatnonzero(ids < 0)
        if len(odd):
            points = -1 - ids[odd].astype(np.int64)
            points = np.where(points == OWN_MARK, MARK, points)
            spelt = [chr(p).encode() for p in points.tolist()]
            times = np.ones(len(ids), np.int64)
            times[odd] = [len(x) for x in spelt]
            owner = np.repeat(np.repeat(np.arange(len(count)), count), times)
            wide = np.repeat(ids, times)
            wide[wide < 0] = self.byte_ids[np.frombuffer(b"".join(spelt), np.uint8)]
            ids, count = wide, np.bincount(owner, minlength=len(count))
        begin = np.concatenate([[0], np.cumsum(count)])[:-1]
        at = np.empty(len(size), np.int64)
        many = np.empty(len(size), np.int64)
        at[row], many[row] = begin, count
        return gather(ids, at, many)

    def encode(self, data: np.ndarray, off: np.ndarray, memory: Memory | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Flat UTF-8 texts: ids and offsets by text. An empty text has no ids."""
        n = len(off) - 1
        cps = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), "<u4")
        lead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
        coff = lead[off]
        cps = np.where(cps == MARK, np.int32(OWN_MARK), np.where(cps == 0x20, np.int32(MARK), cps.view(np.int32)))
        full = np.flatnonzero(np.diff(coff)) if self.prefix else np.zeros(0, np.int64)
        cps = np.insert(cps, coff[full], MARK)
        grow = np.zeros(n + 1, np.int64)
        grow[full + 1] = 1
        coff = coff + np.cumsum(grow)
        if not len(cps):
            return np.zeros(0, np.int32), np.zeros(n + 1, np.int64)
        mark = cps == MARK
        begins = mark.copy()
        begins[1:] &= ~mark[:-1]
        begins[coff[:-1][np.diff(coff) > 0]] = True
        start = np.flatnonzero(begins)
        end = np.append(start[1:], len(cps))
        first, same = _alike(cps, start, end)
        found = Memory() if memory is None else memory
        which = found.look(cps, start[first], end[first])
        new = np.flatnonzero(which < 0)
        if len(new):
            own = first[new]
            ids, woff = self._words(cps, start[own], end[own])
            which[new] = found.keep(cps, start[own], end[own], ids, woff)
        at = which[same]
        ids, toff = gather(found.ids, found.at[at], found.at[at + 1] - found.at[at])
        found.shrink()
        return ids, toff[np.searchsorted(start, coff)]

    # -- decoding

    def decode(self, ids: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes and offsets of texts from their ids: the inverse of encode."""
        size = np.diff(self.raw_off)
        data, at = gather(self.raw, self.raw_off[ids], size[ids])
        boff = at[off]
        if self.prefix:
            full = boff[:-1][np.diff(boff) > 0]
            keep = np.ones(len(data), bool)
            keep[full[data[full] == 0x20]] = False
            data, boff = data[keep], np.concatenate([[0], np.cumsum(keep)])[boff]
        return data, boff


def gather(values: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Runs of values one after the other, and their offsets."""
    off = np.concatenate([[0], np.cumsum(size)])
    return values[np.arange(off[-1]) - np.repeat(off[:-1] - start, size)], off


def load(path: str = MODEL) -> Pieces:
    with open(path, "rb") as f:
        return Pieces.parse(f.read())


def encode_texts(df: DataFrame, pieces: Pieces, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id_column, ids, n_tokens, decoded_sha256 (of the text read back from the ids), exact.

    exact says that the text read back is the given one, byte by byte. Null texts: null ids, 0 tokens, the hash of
    nothing. Empty texts: no ids. Repeated rows each get their own.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = Memory()
        for batch in batches:
            column = batch.column(1)
            data, off = V.flat(column)
            for i, j in V.chunks(off, CHUNK):
                d, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
                ids, toff = pieces.encode(d, o, memory)
                back, boff = pieces.decode(ids, toff)
                raw, old = back.tobytes(), d.tobytes()
                texts = [raw[a:b] for a, b in zip(boff[:-1].tolist(), boff[1:].tolist(), strict=True)]
                exact = [t == old[a:b] for t, a, b in zip(texts, o[:-1].tolist(), o[1:].tolist(), strict=True)]
                lists = pa.ListArray.from_arrays(pa.array(toff.astype(np.int32)), pa.array(ids), mask=column.slice(i, j - i).is_null())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), lists, pa.array(np.diff(toff)), pa.array([hashlib.sha256(t).hexdigest() for t in texts], pa.string()), pa.array(exact, pa.bool_())], names=["id", "ids", "n_tokens", "decoded_sha256", "exact"])
            V.release()

    kind = df.schema[id_column].dataType.simpleString()
    return df.select(F.col(id_column), F.col(text_column).cast("string")).mapInArrow(run, f"id {kind}, ids array<int>, n_tokens long, decoded_sha256 string, exact boolean").withColumnRenamed("id", id_column)


def decode_ids(df: DataFrame, pieces: Pieces, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """Per row: id_column and text; null ids give null. Ids that don't spell UTF-8 have U+FFFD in place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = []
            for ids in batch.column(1).to_pylist():
                if ids is None:
                    texts.append(None)
                else:
                    data, _ = pieces.decode(np.array(ids, np.int64), np.array([0, len(ids)]))
                    texts.append(data.tobytes().decode("utf-8", "replace"))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["id", "text"])

    kind = df.schema[id_column].dataType.simpleString()
    return df.select(id_column, ids_column).mapInArrow(run, f"id {kind}, text string").withColumnRenamed("id", id_column)
