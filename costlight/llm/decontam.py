"""Benchmark decontamination with a broadcast hash set of normalised test n-grams.

Words are letters, digits and non-ASCII characters after lower-casing A-Z. The windows of the
benchmark (10 words; a shorter item is one window) go to every task as sorted hashes. Documents
are scanned window by window: a bit table drops most, a binary search finds the rest, and each
hit is verified word by word. The benchmark is read and broadcast in slices of a checked size, one at a time; each slice
is one pass, so a benchmark of any size works. Contaminated documents, or just the spans that are hit, can be removed.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import store
from . import vectext as V

U64 = np.uint64
BITS = 20
#: Most bytes of benchmark text in one broadcast slice; the set of its windows takes some twenty times as much.
SLICE_BYTES = 4 << 20


def _item_words(text: str | None) -> list[bytes]:
    data, off = V.flat(pa.array([text], pa.string()))
    data = V.LOWER[data]
    start, end, _ = V.words(data, off, V.ALNUM)
    raw = data.tobytes()
    return [raw[a:b] for a, b in zip(start.tolist(), end.tolist(), strict=True)]


def _hashes(seqs: list[tuple[bytes, ...]], size: int) -> np.ndarray:
    flat = [w for s in seqs for w in s]
    data, off = V.flat(pa.array(flat, pa.binary()))
    tokens = V.word_hashes(data, off[:-1], off[1:])
    return V.Rolling(tokens).grams(size)[::size]


class NgramSet:
    """Windows of the items by length: sorted hashes, their words and items."""

    def __init__(self, items: list[tuple[str, str | None]], window: int):
        by: dict[int, dict[tuple[bytes, ...], set[str]]] = {}
        for item, text in items:
            w = _item_words(text)
            if not w:
                continue
            size = min(window, len(w))
            for i in range(len(w) - size + 1):
                by.setdefault(size, {}).setdefault(tuple(w[i : i + size]), set()).add(item)
        self.sizes = {}
        for size, seqs in by.items():
            keys = list(seqs)
            h = _hashes(keys, size)
            order = np.argsort(h, kind="stable")
            bits = np.zeros(1 << BITS, bool)
            bits[h >> U64(64 - BITS)] = True
            words = {}
            for k, x in zip(keys, h.tolist(), strict=True):
                words.setdefault(x, []).append((k, sorted(seqs[k])))
            self.sizes[size] = (h[order], bits, words)

    def scan(self, data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, list[tuple[int, int, int]], dict[int, set[str]]]:
        """Words by document; verified hits (document, first word, words) and items by document."""
        data = V.LOWER[data]
        start, end, woff = V.words(data, off, V.ALNUM)
        tokens = V.Rolling(V.word_hashes(data, start, end)) if len(start) else None
        hits, items = [], {}
        for size, (sorted_h, bits, words) in self.sizes.items():
            if tokens is None:
                break
            g = tokens.grams(size)
            at = np.flatnonzero(bits[g >> U64(64 - BITS)])
            g = g[at]
            k = np.minimum(np.searchsorted(sorted_h, g), len(sorted_h) - 1)
            same = sorted_h[k] == g
            at, g = at[same], g[same]
            doc = np.searchsorted(woff, at, "right") - 1
            inside = at + size <= woff[doc + 1]
            for p, d, h in zip(at[inside].tolist(), doc[inside].tolist(), g[inside].tolist(), strict=True):
                own = tuple(data[a:b].tobytes() for a, b in zip(start[p : p + size].tolist(), end[p : p + size].tolist(), strict=True))
                for seq, names in words[h]:
                    if seq == own:
                        hits.append((d, p - int(woff[d]), size))
                        items.setdefault(d, set()).update(names)
        return np.diff(woff), hits, items


def _scan(grams: NgramSet):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = V.flat(batch.column(1))
            n = batch.num_rows
            words = np.zeros(n, np.int64)
            pos, size, items = [[] for _ in range(n)], [[] for _ in range(n)], [[] for _ in range(n)]
            for i, j in V.chunks(off):
                words[i:j], hits, found = grams.scan(data[off[i] : off[j]], off[i : j + 1] - off[i])
                for d, p, s in hits:
                    pos[i + d].append(p)
                    size[i + d].append(s)
                for d, names in found.items():
                    items[i + d] = sorted(names)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words), pa.array(pos, pa.list_(pa.int32())), pa.array(size, pa.list_(pa.int32())), pa.array(items, pa.list_(pa.string()))], names=["rid", "n_words", "pos", "size", "items"])

    return run


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        hit, count, sha = [], [], []
        for pos, size, items in zip(*(batch.column(c).to_pylist() for c in (2, 3, 4)), strict=True):
            total, reach = 0, 0
            for p, s in sorted(zip(pos, size, strict=True)):
                total += max(0, p + s - max(p, reach))
                reach = max(reach, p + s)
            names = sorted(set(items))
            hit.append(total)
            count.append(len(names))
            sha.append(hashlib.sha256(",".join(names).encode()).hexdigest())
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(hit, pa.int64()), pa.array(count, pa.int64()), pa.array(sha, pa.string()), pa.array([h > 0 for h in hit], pa.bool_())], names=["id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"])


def _slices(benchmark: DataFrame, item_column: str, text_column: str, most: int) -> Iterator[list[tuple[str, str]]]:
    """The benchmark's items, in slices of at most about so many bytes."""
    have, size = [], 0
    rows = benchmark.select(F.col(item_column).cast("string").alias("item"), F.col(text_column).cast("string").alias("text")).where("text is not null")
    for r in rows.toLocalIterator():
        have.append((str(r.item), r.text))
        size += len(r.text) * 4
        if size >= most:
            yield have
            have, size = [], 0
    if have:
        yield have


def decontaminate(df: DataFrame, benchmark: DataFrame, window: int = 10, id_column: str = "doc_id", text_column: str = "text", item_column: str = "item_id", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """Per row: id_column, n_words, n_hit, n_items, items_sha256, contaminated.

    Null texts have no words. Items without words have no windows. Repeated rows each get their own
    result; an empty benchmark hits nothing.
    """
    kind = df.schema[id_column].dataType.simpleString()
    schema = f"id {kind}, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    slices = _slices(benchmark, item_column, text_column, slice_bytes)
    first, second = next(slices, []), next(slices, None)
    found_schema = "n_words long, pos array<int>, size array<int>, items array<string>"
    if second is None:
        base = df.select(F.col(id_column).alias("rid"), F.col(text_column).cast("string"))
        found = base.mapInArrow(_scan(NgramSet(first, window)), f"rid {kind}, {found_schema}")
        return found.mapInArrow(_digest, schema).withColumnRenamed("id", id_column)
    texts = store.numbered(df, id_column, text_column)
    parts = None
    for part in [first, second]:
        one = texts.select("rid", "text").mapInArrow(_scan(NgramSet(part, window)), f"rid long, {found_schema}")
        parts = one if parts is None else parts.union(one)
    for part in slices:
        parts = parts.union(texts.select("rid", "text").mapInArrow(_scan(NgramSet(part, window)), f"rid long, {found_schema}"))
    whole = parts.groupBy("rid").agg(F.max("n_words").alias("n_words"), F.flatten(F.collect_list("pos")).alias("pos"), F.flatten(F.collect_list("size")).alias("size"), F.flatten(F.collect_list("items")).alias("items"))
    return texts.select("rid", "id").join(whole, "rid").select("id", "n_words", "pos", "size", "items").mapInArrow(_digest, schema).withColumnRenamed("id", id_column)


def _one_by_one(df: DataFrame, slices: Iterator[list], step) -> DataFrame:
    """step(df, slice) for each slice; from the second on, what the last one left is written first, so one slice is held at a time."""
    for k, part in enumerate(slices):
        df = step(df if not k else store.write(df, "clean")[0], part)
    return df


def remove_contaminated(df: DataFrame, benchmark: DataFrame, window: int = 10, text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """The rows in which no window occurs, all columns as they were; one pass a slice, no shuffle.

    Null and empty texts stay; repeated rows are treated alike; an empty benchmark removes nothing.
    """
    at, schema = df.columns.index(text_column), df.schema
    return _one_by_one(df, _slices(benchmark, item_column, item_text_column, slice_bytes), lambda x, part: x.mapInArrow(_drop_rows(NgramSet(part, window), at), schema))


def remove_spans(df: DataFrame, benchmark: DataFrame, window: int = 10, text_column: str = "text", item_column: str = "item_id", item_text_column: str = "text", slice_bytes: int = SLICE_BYTES) -> DataFrame:
    """All rows and columns; of each text, what lies from the first to the last word of each run of hit words is gone.

    Spans are judged on the given texts, also where the benchmark takes several slices. Null texts stay null, other columns
    as they were; repeated rows are treated alike.
    """
    own = "_spans"
    while own in df.columns:
        own += "_"
    columns = [F.col(f"`{c}`") for c in df.columns]
    marked = df.select(*columns, F.array().cast("array<struct<start:int,end:int>>").alias(own))
    at, schema = df.columns.index(text_column), marked.schema
    marked = _one_by_one(marked, _slices(benchmark, item_column, item_text_column, slice_bytes), lambda x, part: x.mapInArrow(_mark_spans(NgramSet(part, window), at), schema))
    kind = df.schema[text_column].dataType.simpleString()
    return marked.mapInArrow(_cut_spans(at), df.schema) if kind == "string" else marked.drop(own)


_SPAN = pa.struct([("start", pa.int32()), ("end", pa.int32())])


def _mark_spans(grams: NgramSet, at: int):
    """Adds the byte ranges of the hits to the last column."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = V.flat(batch.column(at))
            spans = batch.column(batch.num_columns - 1).to_pylist()
            for i, j in V.chunks(off):
                part, o = data[off[i] : off[j]], off[i : j + 1] - off[i]
                _, hits, _ = grams.scan(part, o)
                if hits:
                    start, end, woff = V.words(V.LOWER[part], o, V.ALNUM)
                    for d, p, size in hits:
                        first = int(woff[d]) + p
                        spans[i + d].append({"start": int(start[first] - o[d]), "end": int(end[first + size - 1] - o[d])})
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(spans, pa.list_(_SPAN))], names=batch.schema.names)

    return run


def _cut_spans(at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at).to_pylist()
            for k, spans in enumerate(batch.column(batch.num_columns - 1).to_pylist()):
                if spans:
                    raw, out, reach = texts[k].encode(), [], 0
                    for s in sorted(spans, key=lambda x: x["start"]):
                        if s["start"] > reach:
                            between = raw[reach : s["start"]]
                            # Runs of hit words that touch are one: what lies between them goes too.
                            out.append(between if not out or V.ALNUM[V.LOWER[np.frombuffer(between, np.uint8)]].any() else b"")
                        reach = max(reach, s["end"])
                    texts[k] = b"".join([*out, raw[reach:]]).decode()
            columns = list(batch.columns[:-1])
            columns[at] = pa.array(texts, batch.schema.field(at).type)
            yield pa.RecordBatch.from_arrays(columns, names=batch.schema.names[:-1])

    return run


def _drop_rows(grams: NgramSet, at: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = V.flat(batch.column(at))
            keep = np.ones(batch.num_rows, bool)
            for i, j in V.chunks(off):
                _, hits, _ = grams.scan(data[off[i] : off[j]], off[i : j + 1] - off[i])
                keep[[i + d for d, _, _ in hits]] = False
            yield batch.filter(pa.array(keep))

    return run
