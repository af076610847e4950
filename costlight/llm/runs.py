"""A log-structured family of sorted runs that finds repeated windows of tokens.

A window is W tokens (bytes or words) in a row.  An entry for each of them would take many times the
corpus, so runs are sparse: they hold the suffixes at *anchors*, the leftmost smallest k-gram (by
hash) of a window.  Equal windows have the same anchor at the same offset, so a repeated window always
meets its partner at an anchor.  The consecutive windows that share an anchor form a *block*.  A run
entry is (k0, k1: what the suffix at the anchor begins with; d0, d1: a keyed 128-bit BLAKE2b digest of the
block's tokens and the anchor's offset; document; first window; number of windows), in the order of
k0, k1.  For bytes, k0 and k1 are the first 16 bytes of the suffix, so a run is a sparse suffix array
and neighbours with equal keys have a common prefix of 16 or more; for words they are a hash of k words.

A new batch is sorted into a run together with the levels that it merges with (those of equal size,
so there are never more than log2(batches) + 1). Other levels aren't rewritten or shuffled: they are
bucketed by key, and only their entries whose key the batch holds too are fetched by a bucketed semi-join.

* A block whose key and digest came earlier repeats wholly: all its windows are marked.
* First blocks whose key is shared with a different block are *refined*: their tokens are fetched from the
  texts, and windows of equal hash are compared token by token with the first of their hash.
* Other blocks are new.

Skew: a block that comes several times in one Arrow batch goes to the scan once, the others are
dealt out by document. The scan streams through a key's entries; a key with more than HOT_BLOCKS different
blocks is refined by a shuffle of 128-bit window hashes (combined before it) instead of in one task.
"""

from __future__ import annotations

import hashlib
import json
import os
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store
from . import vectext as V

U64 = np.uint64
PIECE = 1 << 20
ENTRY, REFINE, MARK, HOT = 1, 2, 4, 8
LEVEL, MERGING, NEW, LOCAL = -2, -1, 0, 1
#: More different blocks of one key are refined by a shuffle, not in one task (about 150 bytes each).
HOT_BLOCKS = 50_000
KEY = ["k0", "k1"]
ROWS = "k0 long, k1 long, d0 long, d1 long, doc long, pos int, n int, src byte"
NAMES = ["k0", "k1", "d0", "d1", "doc", "pos", "n", "src"]
SCANNED = ROWS + ", flags byte"


class ByteTokens:
    """Tokens are the bytes of the text."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.data, self.off = data, off

    def values(self) -> np.ndarray:
        return V.BYTE_VALUE[self.data]

    def prefixes(self, start: int, end: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """A hash of each gram in tokens [start, end), and its first 16 bytes (a shorter gram: zeros after it) as two numbers in the order of texts."""
        raw = np.concatenate([self.data[start:end], np.zeros(15, np.uint8)])
        eight = np.ndarray(end - start + 8, ">u8", raw, strides=(1,)).astype(U64)
        n = max(0, end - start - gram + 1)
        k0, k1 = eight[:n], eight[8 : 8 + n]
        if gram < 16:
            k0, k1 = (k & U64((1 << 64) - (1 << 8 * (8 - min(8, max(0, g))))) for k, g in ((k0, gram), (k1, gram - 8)))
        order = V.mix(V.stir(k0, k1)) if gram == 16 else V.Rolling(V.BYTE_VALUE[self.data[start:end]]).grams(gram)
        sign = U64(1 << 63)
        return order, (k0 ^ sign).view(np.int64), (k1 ^ sign).view(np.int64)

    def body(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Bytes that spell the tokens, one way only, and where each token begins and ends in them."""
        at = np.arange(len(self.data) + 1)
        return self.data, at[:-1], at[1:]

    def byte_range(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return lo, hi

    def kept(self, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bytes of the kept tokens and offsets by document."""
        total = np.concatenate([[0], np.cumsum(keep)])
        return self.data[keep], total[self.off]


class WordTokens:
    """Tokens are words between white space (09-0D and 20), unchanged."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        self.data = data
        self.start, self.end, self.off = V.words(data, off, V.NOT_SPACE)

    def values(self) -> np.ndarray:
        return V.word_hashes(self.data, self.start, self.end)

    def prefixes(self, start: int, end: int, gram: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        order = V.Rolling(V.word_hashes(self.data, self.start[start:end], self.end[start:end])).grams(gram)
        return order, order.view(np.int64), np.zeros(len(order), np.int64)

    def body(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The words, each with one space after it (which the end of a token leaves out)."""
        size = self.end - self.start + 1
        at = np.concatenate([[0], np.cumsum(size)])
        place = np.arange(at[-1])
        out = self.data[np.minimum(place - np.repeat(at[:-1] - self.start, size), max(0, len(self.data) - 1))] if len(size) else self.data[:0]
        out[at[1:] - 1] = 0x20
        return out, at[:-1], at[1:] - 1

    def byte_range(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return self.start[lo], self.end[hi - 1]

    def kept(self, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Kept words joined by one space, and offsets by document."""
        start, end = self.start[keep], self.end[keep]
        count = np.concatenate([[0], np.cumsum(keep)])[self.off]
        size = end - start + 1
        at = np.concatenate([[0], np.cumsum(size)])
        out = self.data[np.arange(at[-1]) - np.repeat(at[:-1] - start, size) - (np.arange(at[-1]) == np.repeat(at[1:] - 1, size))]
        out[at[1:] - 1] = 0x20
        first = at[count[:-1]]
        last = at[count[1:]] - (count[1:] > count[:-1])
        drop = at[count[1:]][count[1:] > count[:-1]] - 1
        mask = np.ones(len(out), bool)
        mask[drop] = False
        sizes = last - first
        return out[mask], np.concatenate([[0], np.cumsum(sizes)])


@dataclass(frozen=True)
class Windows:
    """What counts as a repeat.

    width: tokens in a window. gram: tokens hashed for anchors, under width. tokens: ByteTokens or
    WordTokens. within: whether an earlier start in the same document counts too.
    """

    width: int
    gram: int
    tokens: Callable
    within: bool


def _blocks(t, spec: Windows, seed: bytes) -> tuple[np.ndarray, ...]:
    """k0, k1, d0, d1, document number, first window (in the flat sequence) and windows of each block."""
    out = []
    n = int(t.off[-1])
    body, begin, end = t.body()
    body = memoryview(np.ascontiguousarray(body))
    step = PIECE if n > PIECE else max(1, n)
    for s in range(0, max(0, n - spec.width + 1), step):
        grams, k0, k1 = t.prefixes(s, min(n, s + step + spec.width - 1), spec.gram)
        order = (grams >> U64(22) << U64(22)) | np.arange(len(grams), dtype=U64)
        anchor = (V.window_min(order, spec.width - spec.gram + 1) & U64((1 << 22) - 1)).astype(np.int64)
        p = np.arange(len(anchor))
        doc = np.searchsorted(t.off, p + s, "right") - 1
        fits = p + s + spec.width <= t.off[doc + 1]
        p, doc = p[fits], doc[fits]
        if not len(p):
            continue
        a = anchor[p]
        first = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (doc[1:] != doc[:-1])]))
        lo, hi = p[first], np.append(p[first[1:] - 1], p[-1])
        a = a[first]
        x, y = begin[lo + s].tolist(), end[hi + s + spec.width - 1].tolist()
        raw = b"".join([hashlib.blake2b(body[i:j], digest_size=16, key=seed).digest() for i, j in zip(x, y, strict=True)])
        dig = np.frombuffer(raw, np.int64).reshape(-1, 2)
        out.append((k0[a], k1[a], dig[:, 0], dig[:, 1] ^ (a - lo), doc[first], lo + s, hi - lo + 1))
    if not out:
        return tuple(np.zeros(0, np.int64) for _ in range(7))
    return tuple(np.concatenate(x) for x in zip(*out, strict=True))


def _first_of(*keys: np.ndarray) -> np.ndarray:
    """Whether each row of ordered keys differs from the row before."""
    new = np.zeros(len(keys[0]), bool)
    new[:1] = True
    for k in keys:
        new[1:] |= k[1:] != k[:-1]
    return new


def _emit(columns: tuple[np.ndarray, ...], names: list[str], rows: int = 100_000) -> Iterator[pa.RecordBatch]:
    for s in range(0, len(columns[0]), rows):
        yield pa.RecordBatch.from_arrays([pa.array(x[s : s + rows]) for x in columns], names=names)


def _anchors(spec: Windows, seed: bytes):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            data, off = V.flat(batch.column(1))
            parts = []
            for i, j in V.chunks(off):
                t = spec.tokens(data[off[i] : off[j]], off[i : j + 1] - off[i])
                k0, k1, d0, d1, doc, at, n = _blocks(t, spec, seed)
                parts.append((k0, k1, d0, d1, ids[i + doc], (at - t.off[doc]).astype(np.int32), n.astype(np.int32)))
            if not parts:
                continue
            k0, k1, d0, d1, doc, pos, n = (np.concatenate(x) for x in zip(*parts, strict=True))
            order = np.lexsort((pos, doc, d1, d0))
            k0, k1, d0, d1, doc, pos, n = (x[order] for x in (k0, k1, d0, d1, doc, pos, n))
            first = _first_of(d0, d1, k0, k1)
            again = ~first
            if not spec.within and len(doc):
                again &= doc != doc[np.flatnonzero(first)][np.cumsum(first) - 1]
            # Blocks that repeat in their own batch need no partner: they are dealt out by document.
            k0, k1 = np.where(again, V.mix(doc.view(U64)).view(np.int64), k0), np.where(again, -1, k1)
            yield from _emit((k0, k1, d0, d1, doc, pos, n, np.where(again, LOCAL, NEW).astype(np.int8)), NAMES)

    return run


def _whole_groups(batches: Iterator[pa.RecordBatch], most: int, squeeze: Callable | None = None) -> Iterator[tuple[pa.Table, bool, bool]]:
    """Joins ordered batches so that a group of (k0, k1) is cut only after so many rows.

    Gives each table and whether its first group went on from the table before, its last group goes on in the next.
    squeeze takes what it can out of a long group (and deals with it), so that only the rest counts.
    """
    held: list[pa.RecordBatch] = []
    rows, last, begun = 0, None, False
    for batch in batches:
        if not batch.num_rows:
            continue
        k0, k1 = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        edge = np.flatnonzero((k0[1:] != k0[:-1]) | (k1[1:] != k1[:-1])) + 1
        new = last is not None and last != (k0[0], k1[0])
        cut = int(edge[-1]) if len(edge) else 0  # the last group may go on
        if held and (new or cut):
            yield pa.Table.from_batches([*held, batch.slice(0, cut)] if cut else held), begun, False
            held, rows, begun = [], 0, False
        elif cut:
            yield pa.Table.from_batches([batch.slice(0, cut)]), begun and not new, False
            begun = False
        elif new:
            begun = False
        held.append(batch.slice(cut))
        rows += batch.num_rows - cut
        last = (k0[-1], k1[-1])
        if rows > most and squeeze is not None:
            held = squeeze(pa.Table.from_batches(held), begun).to_batches()
            rows = sum(x.num_rows for x in held)
        if rows > most:
            yield pa.Table.from_batches(held), begun, True
            held, rows, begun = [], 0, True
    if held:
        yield pa.Table.from_batches(held), begun, False


def _scan(spec: Windows, hot_blocks: int):
    """Rows of levels that are being merged go on into the new run, those of other levels are only compared."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        carried, head_doc = None, -1  # the last block of the table before, and the document in which it came first
        copies: list[pa.RecordBatch] = []

        def squeeze(table: pa.Table, begun: bool) -> pa.Table:
            """Marks copies of a block that the table holds too, and leaves the different blocks."""
            if begun:
                return table
            columns = [table.column(c).to_numpy() for c in NAMES]
            k0, k1, d0, d1, doc, _, _, src = columns
            first = _first_of(k0, k1, d0, d1)
            again = (~first if spec.within else ~first & (doc != doc[first][np.cumsum(first) - 1])) & (src == NEW)
            copies.extend(_emit((*(x[again] for x in columns), np.full(int(again.sum()), MARK, np.int8)), [*NAMES, "flags"]))
            return table.filter(pa.array(~again)).combine_chunks()

        for table, begun, open_ in _whole_groups(batches, hot_blocks, squeeze):
            yield from copies
            copies.clear()
            k0, k1, d0, d1, doc, pos, n, src = (table.column(c).to_numpy() for c in NAMES)
            first = _first_of(k0, k1, d0, d1)
            if begun and carried == (k0[0], k1[0], d0[0], d1[0]):
                first[0] = False
            heads = np.append(head_doc, doc[first])[np.cumsum(first)]
            again = (~first if spec.within else ~first & (doc != heads)) & (src != LOCAL)
            carried, head_doc = (k0[-1], k1[-1], d0[-1], d1[-1]), heads[-1]
            flags = np.where((src == LOCAL) | (again & (src == NEW)), MARK, 0).astype(np.int8)
            flags[first & ((src == NEW) | (src == MERGING))] |= ENTRY
            head = np.flatnonzero(_first_of(k0, k1))
            size = np.diff(np.append(head, len(k0)))
            kinds = np.add.reduceat(first.astype(np.int64), head)
            fresh = np.add.reduceat((src == NEW).astype(np.int64), head) > 0
            hot = np.add.reduceat((~again).astype(np.int64), head) > hot_blocks
            hot[0] |= begun
            hot[-1] |= open_
            flags[np.repeat(((kinds > 1) & fresh) | hot, size) & ~again & (src != LOCAL)] |= REFINE
            flags[np.repeat(hot, size) & (flags & REFINE != 0)] |= HOT
            out = np.flatnonzero(flags)
            yield from _emit(tuple(x[out] for x in (k0, k1, d0, d1, doc, pos, n, src, flags)), [*NAMES, "flags"])
        yield from copies

    return run


def _asked(spec: Windows, batch: pa.RecordBatch) -> Iterator[tuple]:
    """For each chunk of (rid, text, asked blocks): document ids, keys, first windows, and bytes and offsets of the blocks."""
    rid = batch.column(0).to_numpy(zero_copy_only=False)
    data, off = V.flat(batch.column(1))
    asked = batch.column(2)
    count = np.diff(asked.offsets.to_numpy())
    at = np.concatenate([[0], np.cumsum(count)])
    fields = asked.flatten()
    pos, n, k0, k1 = (fields.field(c).to_numpy(zero_copy_only=False) for c in ("pos", "n", "k0", "k1"))
    for i, j in V.chunks(off):
        if at[i] == at[j]:
            continue
        t = spec.tokens(data[off[i] : off[j]], off[i : j + 1] - off[i])
        own = np.repeat(np.arange(j - i), count[i:j])
        for s in range(at[i], at[j], 20_000):
            e = slice(s, min(s + 20_000, at[j]))
            row = own[e.start - at[i] : e.stop - at[i]]
            lo = t.off[row] + pos[e]
            b0, b1 = t.byte_range(lo, lo + n[e] - 1 + spec.width)
            out = np.concatenate([[0], np.cumsum(b1 - b0)])
            yield rid[i + row], k0[e], k1[e], pos[e], t.data[np.arange(out[-1]) - np.repeat(out[:-1] - b0, b1 - b0)], out


def _cut(spec: Windows):
    """Fetches the tokens of the blocks asked for as bytes of their text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, k0, k1, pos, block, out in _asked(spec, batch):
                payload = pa.Array.from_buffers(pa.binary(), len(doc), [None, pa.py_buffer(out.astype(np.int32)), pa.py_buffer(block)])
                yield pa.RecordBatch.from_arrays([pa.array(k0), pa.array(k1), pa.array(doc), pa.array(pos), payload], names=["k0", "k1", "doc", "pos", "payload"])

    return run


def _windows_of(spec: Windows, data: np.ndarray, off: np.ndarray):
    """Tokens of the blocks, and for each of their windows: block, place in the flat sequence, hash."""
    t = spec.tokens(data, off)
    values = t.values()
    h = V.Rolling(values).grams(spec.width)
    p = np.arange(len(h))
    row = np.searchsorted(t.off, p, "right") - 1
    fits = p + spec.width <= t.off[row + 1]
    return t, values, row[fits], p[fits], h[fits]


def _window_rows(spec: Windows):
    """The 128-bit hashes of all windows of the blocks asked for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, _, _, pos, block, out in _asked(spec, batch):
                t, values, row, p, h = _windows_of(spec, block, out)
                second = V.Rolling(V.mix(values ^ U64(0x5851F42D4C957F2D))).grams(spec.width)[p]
                at = pos[row] + p - t.off[row]
                # A place in a document lies in one block only, so no row comes twice.
                yield from _emit((h.view(np.int64), second.view(np.int64), doc[row], at.astype(np.int32)), ["w0", "w1", "doc", "pos"])

    return run


def _same_bytes(data: np.ndarray, a0: np.ndarray, a1: np.ndarray, b0: np.ndarray, b1: np.ndarray) -> np.ndarray:
    """Whether bytes [a0, a1) equal bytes [b0, b1), pair by pair."""
    same = (a1 - a0) == (b1 - b0)
    at = np.flatnonzero(same & (a1 > a0))
    for s in range(0, len(at), 1 << 14):
        own = at[s : s + (1 << 14)]
        size = a1[own] - a0[own]
        edge = np.cumsum(size) - size
        place = np.arange(int(size.sum())) - np.repeat(edge, size)
        same[own] = np.logical_and.reduceat(data[place + np.repeat(a0[own], size)] == data[place + np.repeat(b0[own], size)], edge)
    return same


def _refine(spec: Windows):
    """Marks the windows whose tokens came before in their key's blocks. Windows of one hash are compared by their bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, _, _ in _whole_groups(batches, 1 << 62):
            k0, k1, doc, pos = (table.column(c).to_numpy() for c in ("k0", "k1", "doc", "pos"))
            group = np.cumsum(_first_of(k0, k1)) - 1
            data, off = V.flat(table.column("payload"))
            t, _, row, p, h = _windows_of(spec, data, off)
            at = pos[row] + p - t.off[row]
            order = np.lexsort((at, doc[row], h, group[row]))
            row, p, h, at = row[order], p[order], h[order], at[order]
            g, d = group[row], doc[row]
            first = _first_of(h, g)
            if not len(h):
                continue
            lead = np.flatnonzero(first)[np.cumsum(first) - 1]
            again = np.flatnonzero(~first)
            body, begin, end = t.body()
            w = spec.width - 1
            same = _same_bytes(body, begin[p[again]], end[p[again] + w], begin[p[lead[again]]], end[p[lead[again]] + w])
            if not same.all():  # different windows of one hash: by their bytes
                for x in np.unique(lead[again[~same]]).tolist():
                    seen: dict[bytes, int] = {}
                    for y in [x, *again[lead[again] == x].tolist()]:
                        lead[y] = seen.setdefault(body[begin[p[y]] : end[p[y] + w]].tobytes(), y)
            repeats = lead != np.arange(len(lead))
            if not spec.within:
                repeats &= d != d[lead]
            d, at = d[repeats], at[repeats].astype(np.int64)
            order = np.lexsort((at, d))
            d, at = d[order], at[order]
            if not len(d):
                continue
            begin = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (at[1:] > at[:-1] + 1)]))
            end = np.append(at[begin[1:] - 1], at[-1])
            yield pa.RecordBatch.from_arrays([pa.array(d[begin]), pa.array(at[begin].astype(np.int32)), pa.array((end - at[begin] + 1).astype(np.int32))], names=["doc", "pos", "n"])

    return run


@dataclass
class Level:
    """A run: its size in batches, and its table, bucketed by key."""

    size: int
    table: store.Bucketed


class RunIndex:
    """Levels of sorted runs in a shared folder, with a manifest there that a later session opens.

    Every row of a batch (rid long, text) comes after all rows of the batches before; inside a batch rows are
    ordered by rid.  scan() adds a batch; repeats() gives what it found since it was last called.
    """

    def __init__(self, spark: SparkSession, spec: Windows, path: str | None = None, hot_blocks: int = HOT_BLOCKS):
        self.spark, self.spec, self.hot_blocks = spark, spec, hot_blocks
        self.path = path or store.new_path(spark, "runs")
        self.seed = os.urandom(16)
        self.levels: list[Level] = []
        self.found: list[DataFrame] = []
        self.old: list[store.Bucketed] = []
        self.saved = 0

    @classmethod
    def open(cls, spark: SparkSession, spec: Windows, path: str) -> RunIndex:
        """The index as save() left it."""
        index = cls(spark, spec, path)
        names = [x for x in store.names_in(spark, path) if x.startswith("manifest-")]
        index.saved = max(int(x.partition("-")[2]) for x in names)
        state = json.loads(spark.read.text(f"{path}/manifest-{index.saved}").first().value)
        if [state["width"], state["gram"], state["tokens"]] != [spec.width, spec.gram, spec.tokens.__name__]:
            raise ValueError("the index holds other windows")
        index.seed = bytes.fromhex(state["seed"])
        index.levels = [Level(x["size"], store.Bucketed.open(spark, SCANNED, KEY, f"{path}/{x['name']}", x["buckets"])) for x in state["levels"]]
        return index

    def save(self) -> None:
        """Writes the next manifest; a session that fails before leaves the last one as it was."""
        levels = [{"size": x.size, "name": x.table.path.rpartition("/")[2], "buckets": x.table.buckets} for x in self.levels]
        state = {"width": self.spec.width, "gram": self.spec.gram, "tokens": self.spec.tokens.__name__, "seed": self.seed.hex(), "levels": levels}
        self.spark.createDataFrame([(json.dumps(state),)], "value string").coalesce(1).write.text(f"{self.path}/manifest-{self.saved + 1}")
        self.saved += 1

    def scan(self, texts: DataFrame) -> None:
        spec = self.spec
        rows = texts.select("rid", "text").mapInArrow(_anchors(spec, self.seed), ROWS)
        merged: list[Level] = []
        size = 1
        while self.levels and self.levels[-1].size == size:
            merged.append(self.levels.pop())
            size *= 2
        entries = lambda x, src: x.table.read().where(F.col("flags").bitwiseAND(ENTRY) != 0).select(*NAMES[:-1], F.lit(src).cast("byte").alias("src"))
        fresh = None
        if self.levels:
            rows, fresh = store.write(rows, "fresh")
        for x in merged:
            rows = rows.union(entries(x, MERGING))
        if fresh:
            keys = self.spark.read.schema(ROWS).parquet(fresh).where(F.col("src") == NEW).select(*KEY)
            for x in self.levels:
                rows = rows.union(entries(x, LEVEL).join(keys, KEY, "left_semi").select(*NAMES))
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        ordered = rows.repartition(buckets, *KEY).sortWithinPartitions(*KEY, "d0", "d1", "src", "doc", "pos")
        table = store.Bucketed.write(ordered.mapInArrow(_scan(spec, self.hot_blocks), SCANNED), KEY, store.new_path(self.spark, "run", self.path), buckets)
        self.levels.append(Level(size, table))
        self.found.append(table.read())
        self.old += [x.table for x in merged]
        if fresh:
            store.drop(self.spark, fresh)

    def repeats(self, texts: DataFrame) -> DataFrame:
        """doc, pos (first window) and n (windows in a row) of what came earlier; texts has every document of the index (rid, text)."""
        found = self.found[0]
        for x in self.found[1:]:
            found = found.union(x)
        flagged = lambda flag: F.col("flags").bitwiseAND(flag) != 0
        out = found.where(flagged(MARK)).select("doc", "pos", "n")

        def fetch(blocks: DataFrame) -> DataFrame:
            asked = blocks.groupBy("doc").agg(F.collect_set(F.struct("pos", "n", *KEY)).alias("asked"))
            return texts.select("rid", "text").join(asked, F.col("rid") == F.col("doc")).select("rid", "text", "asked")

        hot_keys = found.where(flagged(HOT)).select(*KEY).distinct()
        refine = found.where(flagged(REFINE))
        if found.where(flagged(HOT)).limit(1).count():
            windows, path = store.write(fetch(refine.join(hot_keys, KEY, "left_semi")).mapInArrow(_window_rows(self.spec), "w0 long, w1 long, doc long, pos int"), "windows")
            low = windows.groupBy("w0", "w1").agg(F.min(F.struct("doc", "pos")).alias("low"), F.count("*").alias("many")).where("many > 1")
            later = windows.join(low, ["w0", "w1"]).where("doc > low.doc" + (" OR doc = low.doc AND pos > low.pos" if self.spec.within else ""))
            out = out.union(later.select("doc", "pos", F.lit(1).alias("n")))
            refine = refine.join(hot_keys, KEY, "left_anti")
        else:
            path = None
        cut = fetch(refine).mapInArrow(_cut(self.spec), "k0 long, k1 long, doc long, pos int, payload binary")
        fine = cut.repartition(*KEY).sortWithinPartitions(*KEY).mapInArrow(_refine(self.spec), "doc long, pos int, n int")
        marks, _ = store.write(out.union(fine), "marks")
        if path:
            store.drop(self.spark, path)
        for x in self.old:
            x.drop()
        self.found, self.old = [], []
        return marks

    def drop(self) -> None:
        for x in self.levels:
            x.table.drop()
        store.drop(self.spark, self.path)
        self.levels = []


def _finish(spec: Windows, with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = V.flat(batch.column(1))
            marks = batch.column(2)
            count = np.diff(marks.offsets.to_numpy())
            if marks.null_count:
                count = np.where(marks.is_valid().to_numpy(zero_copy_only=False), count, 0)
            at = np.concatenate([[0], np.cumsum(count)])
            fields = marks.flatten()
            pos, n = (fields.field(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("pos", "n"))
            total, removed, spans, digest, kept_text = [], [], [], [], []
            for i, j in V.chunks(off):
                t = spec.tokens(data[off[i] : off[j]], off[i : j + 1] - off[i])
                e = slice(at[i], at[j])
                lo = t.off[np.repeat(np.arange(j - i), count[i:j])] + pos[e]
                size = int(t.off[-1])
                edge = np.bincount(lo, minlength=size + 1) - np.bincount(lo + n[e] - 1 + spec.width, minlength=size + 1)
                gone = np.cumsum(edge[:size]) > 0
                before = np.concatenate([[0], np.cumsum(gone)])
                begins = gone.copy()
                begins[1:] &= ~gone[:-1]
                head = t.off[:-1][t.off[:-1] < t.off[1:]]
                begins[head] = gone[head]
                runs = np.concatenate([[0], np.cumsum(begins)])
                kept, bounds = t.kept(~gone)
                raw = kept.tobytes()
                texts = [raw[a:b] for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
                total.append(np.diff(t.off))
                removed.append(np.diff(before[t.off]))
                spans.append(np.diff(runs[t.off]))
                digest += [hashlib.sha256(x).hexdigest() for x in texts]
                kept_text += texts if with_text else []
            cat = lambda x: np.concatenate(x) if x else np.zeros(0, np.int64)
            columns = [batch.column(0), pa.array(cat(total)), pa.array(cat(removed)), pa.array(cat(spans)), pa.array(digest, pa.string())]
            names = ["id", "n_tokens", "n_removed", "n_spans", "kept_sha256"]
            if with_text:
                columns.append(pa.array(kept_text, pa.binary()))
                names.append("kept")
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return run


def remove_repeats(df: DataFrame, spec: Windows, batches: int, id_column: str = "doc_id", text_column: str = "text", with_text: bool = False, hot_blocks: int = HOT_BLOCKS) -> DataFrame:
    """Runs the documents, in order of their ids, through a RunIndex in so many batches and removes what repeats.

    Returns id, n_tokens, n_removed, n_spans, kept_sha256 and, if asked for, kept (binary: what is
    left). Null text: empty. Repeated or null ids: see store.numbered. Empty table: empty result.
    """
    spark = df.sparkSession
    texts = store.numbered(df, id_column, text_column)
    kind = texts.schema["id"].dataType.simpleString()
    low, high = texts.agg(F.min("rid"), F.max("rid")).first()
    cuts: list[int] = []
    if low is not None and batches > 1 and low < high:
        found = texts.agg(F.percentile_approx("rid", [i / batches for i in range(1, batches)], 10_000).alias("q")).first().q
        cuts = sorted({int(x) for x in found if low <= x < high})
    bounds = [None, *cuts, None]
    index = RunIndex(spark, spec, hot_blocks=hot_blocks)
    for a, b in zip(bounds[:-1], bounds[1:], strict=True):
        part = texts
        if a is not None:
            part = part.where(F.col("rid") > a)
        if b is not None:
            part = part.where(F.col("rid") <= b)
        index.scan(part)
    marks = index.repeats(texts)
    index.drop()
    by_doc = marks.groupBy("doc").agg(F.collect_list(F.struct("pos", "n")).alias("marks"))
    joined = texts.join(by_doc, F.col("rid") == F.col("doc"), "left").select("id", "text", "marks")
    return joined.mapInArrow(_finish(spec, with_text), f"id {kind}, n_tokens long, n_removed long, n_spans long, kept_sha256 string" + ", kept binary" * with_text)
