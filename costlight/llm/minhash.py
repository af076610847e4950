"""Near-dedup by SetSketch registers.

A document's set holds the hashes of its distinct word shingles. Its sketch has M registers: the
smallest hash under each of M functions, read as an exponential variable x and kept as the truncated
register floor(1 - log_b(x)), limited to 0..Q+1. Registers of a union are the maxima of registers
(sketches merge), and equal registers are about as likely as the Jaccard similarity (b is close to 1).

1. Documents with equal sets are one class; only its first document goes on.
2. The registers are cut into bands; classes that agree in a band link to the band's first class
   (a star, so links grow with the rows). Connected classes are candidate groups; every pair over
   the threshold lies within one, but for a chance of about (1 - s**ROWS)**BANDS.
3. In a group, a pivot is compared with the members that share one of its rarest shingles (an exact
   prefix filter, so a passage common to unlike texts makes no pairs). The joint likelihood of the registers (how many are larger, smaller and equal) estimates the similarity and drops pairs far
   below the threshold; the rest is verified on the full sets. Members of the largest component need
   not be pivots: every pair outside it is tested, so no link between components is lost.
4. Groups over GROUP_BYTES are split by the same prefix filter, as a join: only members that share one of their
   rarest shingles stay together. What is still too large is dealt out in blocks; each block holds the group's first
   members too and finds its own links; then the members left outside the main component are dealt out in
   chunks, and each chunk is compared with each block. So a task holds at most about twice GROUP_BYTES.

Shingles are told apart by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import store
from . import vectext as V

U64 = np.uint64
M = 128
ROWS = 4
BANDS = M // ROWS
B, A, Q = 1.001, 20.0, (1 << 16) - 2
#: Estimates this far under the threshold are dropped unverified: over six standard deviations.
MARGIN = 0.25
#: A group of more bytes of sets is dealt out in blocks.
GROUP_BYTES = 64 << 20
SHARED_PIVOTS = 8
#: Shingles that are handled at a time.
CHUNK = 1 << 20

_rng = np.random.default_rng(20)
_MUL = _rng.integers(0, 1 << 32, M, dtype=np.uint64).astype(np.uint32) | np.uint32(1)
_ADD = _rng.integers(0, 1 << 32, M, dtype=np.uint64).astype(np.uint32)


def shingle_sets(data: np.ndarray, off: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each document, flat, and their offsets.

    Words are split at white space after lower-casing A-Z. A document of fewer words, but not none,
    has its whole word sequence as its one shingle.
    """
    data = V.LOWER[data]
    start, end, woff = V.words(data, off, V.NOT_SPACE)
    n = len(off) - 1
    if not len(start):
        return np.zeros(0, U64), np.zeros(n + 1, np.int64)
    rolling = V.Rolling(V.word_hashes(data, start, end))
    count = np.diff(woff)
    g = rolling.grams(size)
    p = np.arange(len(g))
    doc = np.searchsorted(woff, p, "right") - 1
    fits = p + size <= woff[doc + 1]
    short = np.flatnonzero((count > 0) & (count < size))
    h = np.concatenate([g[fits], rolling.spans(woff[short], woff[short + 1])])
    d = np.concatenate([doc[fits], short])
    order = np.lexsort((h, d))
    h, d = h[order], d[order]
    first = np.ones(len(h), bool)
    first[1:] = (h[1:] != h[:-1]) | (d[1:] != d[:-1])
    h, d = h[first], d[first]
    return h, np.searchsorted(d, np.arange(n + 1))


def registers(h: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Registers (uint16) of each set; sets are not empty."""
    x = (h >> U64(32)).astype(np.uint32) ^ h.astype(np.uint32)
    low = np.empty((len(off) - 1, M), np.uint32)
    for i in range(M):
        low[:, i] = np.minimum.reduceat(x * _MUL[i] + _ADD[i], off[:-1])
    v = -np.log1p(-(low.astype(np.float64) + 0.5) / 2.0**32) / A
    return np.clip(np.floor(1 - np.log(v) / np.log(B)), 0, Q + 1).astype(np.uint16)


def merge(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Registers of the union of two sets."""
    return np.maximum(a, b)


_GRID = np.linspace(0, 1, 101)


def estimate(a: np.ndarray, b: np.ndarray, size_a: float, size_b: np.ndarray) -> np.ndarray:
    """Most likely Jaccard similarity of set a with each set of b, from registers and set sizes.

    Under similarity j, a register of a is larger with probability p(u - v*j), smaller with
    p(v - u*j), where u and v are the shares of the sizes and p(x) = -log_b(1 - x*(b-1)/b).
    """
    more, less = (a > b).sum(1), (a < b).sum(1)
    u = size_a / (size_a + size_b)
    v = 1 - u
    top = np.minimum(u / v, v / u)
    j = _GRID[None, :] * top[:, None]
    p = lambda x: -np.log1p(-np.clip(x, 0, 1) * (B - 1) / B) / np.log(B)
    up, down = p(u[:, None] - v[:, None] * j), p(v[:, None] - u[:, None] * j)
    tiny = 1e-12
    like = more[:, None] * np.log(up + tiny) + less[:, None] * np.log(down + tiny) + (M - more - less)[:, None] * np.log(np.maximum(1 - up - down, tiny))
    return np.take_along_axis(j, like.argmax(1)[:, None], 1)[:, 0]


def _sketch(size: int):
    """rid, sets' size, digest and registers of each document; for empty sets digest is null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = V.flat(batch.column(1))
            for i, j in V.chunks(off):
                h, o = shingle_sets(data[off[i] : off[j]], off[i : j + 1] - off[i], size)
                n = np.diff(o)
                full = np.flatnonzero(n)
                with np.errstate(over="ignore"):
                    one, two = np.zeros(j - i, U64), np.zeros(j - i, U64)
                    if len(full):
                        one[full] = np.add.reduceat(V.mix(h), o[full])
                        two[full] = np.add.reduceat(V.mix(h ^ U64(0x5851F42D4C957F2D)), o[full])
                regs = np.zeros((j - i, M), np.uint16)
                if len(full):
                    regs[full] = registers(h, np.append(o[full], len(h)))
                raw = regs.tobytes()
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(n), pa.array(V.mix(one).view(np.int64), mask=n == 0), pa.array(V.mix(two).view(np.int64), mask=n == 0), pa.array([raw[k * 2 * M : (k + 1) * 2 * M] if n[k] else None for k in range(j - i)], pa.binary())],
                    names=["rid", "n", "d1", "d2", "regs"],
                )

    return run


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        regs = np.frombuffer(b"".join(batch.column(1).to_pylist()), np.uint16).reshape(-1, M)
        rid = batch.column(0).to_numpy(zero_copy_only=False)
        for i in range(0, len(regs), 2000):
            r = regs[i : i + 2000].astype(U64).reshape(-1, BANDS, ROWS)
            with np.errstate(over="ignore"):
                key = np.arange(1, BANDS + 1, dtype=U64)[None, :].repeat(len(r), 0)
                for k in range(ROWS):
                    key = V.mix(key * U64(V.BASE) + r[:, :, k])
            yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(np.repeat(rid[i : i + 2000], BANDS))], names=["key", "rid"])


def components(edges: DataFrame, scratch: store.Scratch | None = None) -> DataFrame:
    """node, label (smallest node reachable) of all nodes of edges (a, b), a and b long.

    Large-star and small-star steps by turns until nothing changes, however long that takes; each step's edges are
    written to the shared folder.
    """
    spark = edges.sparkSession
    state = lambda x: x.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("a", "b")).alias("x")).first()
    now, path = store.write(edges.where("a != b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    before = state(now)
    while True:
        both = now.union(now.select(F.col("b"), F.col("a")))
        low = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("low"))
        large = both.where("b > a").join(low, "a").select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = large.where("a != b").distinct()
        down = large.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))
        least = down.groupBy("a").agg(F.min("b").alias("low"))
        small = down.join(least, "a").select(F.when(F.col("b") == F.col("low"), F.col("a")).otherwise(F.col("b")).alias("a"), F.col("low").alias("b"))
        after, new = store.write(small.where("a != b").distinct(), "edges")
        store.drop(spark, path)
        now, path = after, new
        if (found := state(now)) == before:
            break
        before = found
    if scratch is not None:
        scratch.paths.append(path)
    labels = now.select(F.col("a").alias("node"), F.col("b").alias("label"))
    return labels.union(labels.select(F.col("label"), F.col("label")).distinct())


class _Union:
    """root: a label of each member's component, always the final one; the smaller of two components is relabelled."""

    def __init__(self, n: int):
        self.root = np.arange(n)
        self.size = np.ones(n, np.int64)
        self.members: dict[int, list[np.ndarray]] = {}

    def join(self, i: int, others: np.ndarray) -> None:
        roots = np.unique(self.root[np.append(others, i)])
        if len(roots) < 2:
            return
        big = int(roots[self.size[roots].argmax()])
        own = self.members.setdefault(big, [np.array([big])])
        for r in roots[roots != big].tolist():
            moved = np.concatenate(self.members.pop(r, [np.array([r])]))
            self.root[moved] = big
            self.size[big] += len(moved)
            own.append(moved)

    def firsts(self) -> np.ndarray:
        """The first member of each member's component."""
        low = np.full(len(self.root), len(self.root))
        np.minimum.at(low, self.root, np.arange(len(self.root)))
        return low[self.root]


class _Shared:
    """Which members share a shingle of their prefixes: all pairs over the threshold do.

    A member's prefix holds its rarest shingles in the group (ties by hash), so many that a pair without
    a common one cannot reach the threshold. What many unlike members have in common stays outside.
    """

    def __init__(self, h: np.ndarray, off: np.ndarray, percent: int):
        ordered = np.sort(h)
        rare, owners = [], []
        for i, j in V.chunks(off, CHUNK):
            part = h[off[i] : off[j]]
            size = np.diff(off[i : j + 1])
            owner = np.repeat(np.arange(i, j), size)
            seen = np.searchsorted(ordered, part, "right") - np.searchsorted(ordered, part, "left")
            order = np.lexsort((part, seen, owner))
            rank = np.arange(len(part)) - np.repeat(off[i:j] - off[i], size)
            keep = (rank < np.repeat(size + -percent * size // 100 + 1, size)) & (seen[order] > 1)
            rare.append(part[order[keep]])
            owners.append(owner[keep])
        rare, owners = np.concatenate(rare), np.concatenate(owners)
        order = np.argsort(rare, kind="stable")
        self.members = owners[order]
        self.low = np.searchsorted(rare, rare, "left", sorter=order)
        self.many = np.searchsorted(rare, rare, "right", sorter=order) - self.low
        self.begin = np.searchsorted(owners, np.arange(len(off)))

    def of(self, i: int) -> np.ndarray:
        """Members that share one with member i, itself too, some more than once."""
        own = slice(self.begin[i], self.begin[i + 1])
        return self.members[_runs(self.low[own], self.many[own])]


def _runs(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Positions of runs one after the other."""
    off = np.cumsum(size)
    return np.arange(off[-1] if len(off) else 0) - np.repeat(off - size - start, size)


def _common(own: np.ndarray, h: np.ndarray, off: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many shingles each of the members at has in common with the sorted set own."""
    size = off[at + 1] - off[at]
    edge = np.concatenate([[0], np.cumsum(size)])
    out = np.empty(len(at), np.int64)
    for i, j in V.chunks(edge, CHUNK):
        part = h[_runs(off[at[i:j]], size[i:j])]
        hit = own[np.minimum(np.searchsorted(own, part), len(own) - 1)] == part
        out[i:j] = np.add.reduceat(hit, edge[i:j] - edge[i], dtype=np.int64)
    return out


def link(h: np.ndarray, off: np.ndarray, regs: np.ndarray, percent: int, queries: np.ndarray | None = None) -> tuple[np.ndarray, int]:
    """Component of each member (its first member's number) of a group, and how many pivots were tested.

    Sets are not empty. Exact on the pairs that the estimate doesn't drop. With queries, just these members are pivots.
    """
    n = len(off) - 1
    size = np.diff(off)
    union = _Union(n)
    shared = _Shared(h, off, percent)
    done = np.zeros(n, bool)
    tested = main = 0  # main: a member of the largest component
    left = queries if queries is not None else np.arange(n)
    while len(left):
        for i in left.tolist():
            if queries is None and tested and union.root[i] == union.root[main]:
                continue
            done[i] = True
            tested += 1
            at = shared.of(i)
            at = np.unique(at[union.root[at] != union.root[i]])
            a, b = size[i], size[at]
            at = at[100 * np.minimum(a, b) >= percent * np.maximum(a, b)]
            if len(at):
                at = at[estimate(regs[i], regs[at], float(a), size[at].astype(float)) >= percent / 100 - MARGIN]
            if len(at):
                inter = _common(h[off[i] : off[i + 1]], h, off, at)
                union.join(i, at[100 * inter >= percent * (a + size[at] - inter)])
                if union.size[union.root[i]] > union.size[union.root[main]]:
                    main = i
        # The largest component may have become another one since its members were passed over.
        left = np.flatnonzero(~done & (union.root != union.root[main])) if queries is None else left[:0]
    return union.firsts(), tested


def _sets(size: int):
    """Adds each class's full set to its row (rid, grp, text, regs)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, off = V.flat(batch.column(2))
            for i, j in V.chunks(off):
                h, o = shingle_sets(data[off[i] : off[j]], off[i : j + 1] - off[i], size)
                sets = pa.Array.from_buffers(pa.binary(), j - i, [None, pa.py_buffer((o * 8).astype(np.int32)), pa.py_buffer(h)])
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), batch.column(1).slice(i, j - i), pa.array(np.diff(o)), batch.column(3).slice(i, j - i), sets], names=["rid", "grp", "n", "regs", "h"])

    return run


def _shingles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row for each shingle of (rid, grp, h): grp, s, rid, n (the set's size)."""
    for batch in batches:
        data, off = V.flat(batch.column(2))
        h, off = data.view(np.int64) if len(data) else np.zeros(0, np.int64), off // 8
        rid, grp = (batch.column(k).to_numpy(zero_copy_only=False) for k in (0, 1))
        for i, j in V.chunks(off, 200_000):
            size = np.diff(off[i : j + 1])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(grp[i:j], size)), pa.array(h[off[i] : off[j]]), pa.array(np.repeat(rid[i:j], size)), pa.array(np.repeat(size, size))], names=["grp", "s", "rid", "n"])


def _regroup(rows: DataFrame, percent: int, scratch: store.Scratch) -> DataFrame:
    """rid, label: the members of large groups (rid, grp, h) that share one of their rarest shingles, directly or through others.

    All pairs over the threshold do: each set's rarest size - ceil(percent * size / 100) + 1 shingles (those of one member only count
    among them) hold one that both have. Members that share none are in no link.
    """
    each = scratch.write(rows.select("rid", "grp", "h").mapInArrow(_shingles, "grp long, s long, rid long, n long"), "shingles")
    often = each.groupBy("grp", "s").agg(F.count("*").alias("often"), F.min("rid").alias("low"))
    rank = F.row_number().over(Window.partitionBy("grp", "rid").orderBy("often", "s"))
    rare = each.join(often, ["grp", "s"]).withColumn("rank", rank).where(F.expr(f"rank <= n - (({percent} * n + 99) div 100) + 1 AND often > 1"))
    shared = rare.select("grp", "s", "rid")
    low = shared.groupBy("grp", "s").agg(F.min("rid").alias("low"))
    edges = shared.join(low, ["grp", "s"]).select(F.col("rid").alias("a"), F.col("low").alias("b"))
    return components(edges, scratch).withColumnsRenamed({"node": "rid"})


def _link_groups(percent: int):
    """Rows in order of (grp, part, role, rid): emits links (a, b); role 1: the row is a query against role 0."""

    def emit(rows: list[pa.RecordBatch]) -> pa.RecordBatch | None:
        t = pa.Table.from_batches(rows)
        if t.num_rows < 2:
            return None
        rid, role = t["rid"].to_numpy(), t["role"].to_numpy()
        data, off = V.flat(t["h"])
        h, off = data.view(U64), off // 8
        regs = np.frombuffer(b"".join(t["regs"].to_pylist()), np.uint16).reshape(-1, M)
        queries = np.flatnonzero(role == 1) if (role == 1).any() else None
        root, _ = link(h, off, regs, percent, queries)
        linked = root != np.arange(len(root))
        return pa.RecordBatch.from_arrays([pa.array(rid[linked]), pa.array(rid[root[linked]])], names=["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            g, p = batch.column(0).to_numpy(zero_copy_only=False), batch.column(1).to_numpy(zero_copy_only=False)
            cuts = np.concatenate([[0], np.flatnonzero((g[1:] != g[:-1]) | (p[1:] != p[:-1])) + 1, [len(g)]])
            for s, e in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True):
                if now != (g[s], p[s]) and held:
                    if (out := emit(held)) is not None:
                        yield out
                    held = []
                now = (g[s], p[s])
                held.append(batch.slice(s, e - s))
        if held and (out := emit(held)) is not None:
            yield out

    return run


def near_duplicates(df: DataFrame, shingle: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text", group_bytes: int = GROUP_BYTES, texts: DataFrame | None = None) -> DataFrame:
    """Per row: id_column, n_shingles, component_id, kept.

    Rows are linked when 100 * |intersection| >= percent * |union| of their shingle sets; component_id
    is the smallest id reachable, itself included; kept where it is the row's own. Rows without words
    (null or blank texts) have an empty set and are linked with nothing. Repeated ids: rows are told
    apart by store.numbered, and component_id is then the id of the smallest row.
    """
    spark = df.sparkSession
    texts = store.numbered(df, id_column, text_column) if texts is None else texts
    scratch = store.Scratch(spark)
    sketched, _ = store.write(texts.select("rid", "text").mapInArrow(_sketch(shingle), "rid long, n long, d1 long, d2 long, regs binary"), "sketches")
    classes, _ = store.write(sketched.where("n > 0").groupBy("d1", "d2").agg(F.min("rid").alias("first")), "classes")
    firsts = sketched.where("n > 0").join(classes, F.col("rid") == F.col("first"), "left_semi").select("rid", "n", "regs")
    keys = firsts.select("rid", "regs").mapInArrow(_bands, "key long, rid long")
    low = keys.groupBy("key").agg(F.min("rid").alias("low"), F.max("rid").alias("high")).where("low < high").select("key", "low")
    banded = scratch.write(keys.join(low, "key").select(F.col("rid").alias("a"), F.col("low").alias("b")).where("a != b").distinct(), "bands")
    groups = scratch.write(components(banded, scratch), "groups")
    member = firsts.join(groups, F.col("rid") == F.col("node")).select("rid", F.col("label").alias("grp"), "n", "regs")
    rows = scratch.write(member.join(texts.select(F.col("rid").alias("r"), "text"), F.col("rid") == F.col("r")).select("rid", "grp", "text", "regs").mapInArrow(_sets(shingle), "rid long, grp long, n long, regs binary, h binary"), "sets")
    count_parts = lambda x: x.groupBy("grp").agg(F.ceil(F.sum(F.col("n") * 8 + 2 * M) / F.lit(group_bytes)).cast("int").alias("parts"))
    parts = scratch.write(count_parts(rows), "parts")
    large = parts.where("parts > 1")
    if large.limit(1).count():
        labels = _regroup(rows.join(large, "grp", "left_semi"), percent, scratch)
        again = rows.drop("grp").join(labels, "rid").select("rid", F.col("label").alias("grp"), "n", "regs", "h")
        rows = scratch.write(rows.join(large, "grp", "left_anti").select("rid", "grp", "n", "regs", "h").union(again), "sets")
        parts = scratch.write(count_parts(rows), "parts")
        large = parts.where("parts > 1")
    rows = rows.join(parts, "grp")
    order = ["grp", "part", "role", "rid", "regs", "h"]
    part = F.pmod(F.xxhash64("rid"), F.col("parts")).cast("long")
    own = rows.where("n > 0").select("grp", part.alias("part"), F.lit(0).cast("byte").alias("role"), "rid", "regs", "h")
    find = _link_groups(percent)
    blocks_needed = large.limit(1).count() > 0
    if blocks_needed:
        # The first members of a group stand in all its blocks.
        lead = rows.where("parts > 1").groupBy("grp").agg(F.array_sort(F.collect_set(F.when(F.pmod(F.xxhash64("rid", F.lit(1)), F.col("parts") * 64) == 0, F.col("rid")))).alias("s"), F.min("rid").alias("m"))
        lead = lead.select("grp", F.explode(F.array_distinct(F.concat(F.array("m"), F.slice("s", 1, SHARED_PIVOTS)))).alias("rid"))
        shared = rows.join(lead, ["grp", "rid"]).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts").cast("long") - 1))).where(F.col("part") != part)
        own = own.union(shared.select("grp", "part", F.lit(0).cast("byte"), "rid", "regs", "h"))
    links = scratch.write(own.repartition("grp", "part").sortWithinPartitions("grp", "part", "role", "rid").select(*order).mapInArrow(find, "a long, b long"), "links")
    if blocks_needed:
        # Members outside their group's main component are compared with every block, a chunk of them at a time.
        found = scratch.write(components(links, scratch), "found")
        state = rows.where("parts > 1").select("grp", "rid", "n").join(found, F.col("rid") == F.col("node"), "left").select("grp", "rid", "n", F.coalesce("label", "rid").alias("label"))
        sizes = state.groupBy("grp", "label").agg(F.count("*").alias("m"))
        main = sizes.groupBy("grp").agg(F.max_by("label", F.struct("m", -F.col("label"))).alias("main"))
        outside = scratch.write(state.join(main, "grp").where("label != main").select("grp", "rid", "n"), "outside")
        chunks = count_parts(outside).withColumnRenamed("parts", "chunks")
        every = lambda name: F.explode(F.sequence(F.lit(0).cast("long"), F.col(name).cast("long") - 1))
        pair = F.col("part") * F.col("chunks") + F.col("chunk")
        asked = rows.join(outside.select("grp", "rid"), ["grp", "rid"]).join(chunks, "grp").withColumn("chunk", F.pmod(F.xxhash64("rid", F.lit(2)), F.col("chunks"))).withColumn("part", every("parts"))
        asked = asked.select("grp", pair.alias("part"), F.lit(1).cast("byte").alias("role"), "rid", "regs", "h")
        blocks = rows.where("parts > 1").join(chunks, "grp").withColumn("chunk", every("chunks")).withColumn("part", part)
        blocks = blocks.select("grp", pair.alias("part"), F.lit(0).cast("byte").alias("role"), "rid", "regs", "h")
        more = scratch.write(blocks.union(asked).repartition("grp", "part").sortWithinPartitions("grp", "part", "role", "rid").mapInArrow(find, "a long, b long"), "more")
        links = links.union(more)
    reach, _ = store.write(components(links, scratch), "reach")
    scratch.drop()
    labels = classes.join(reach, F.col("first") == F.col("node"), "left").select("d1", "d2", F.coalesce("label", "first").alias("label"))
    out = sketched.where("n > 0").select("rid", "n", "d1", "d2").join(labels, ["d1", "d2"]).select("rid", "n", "label")
    out = out.union(sketched.where("n = 0").select("rid", "n", "rid"))
    if store.RID_IS_ID in texts.schema["rid"].metadata:
        kind = df.schema[id_column].dataType
        return out.select(F.col("rid").cast(kind).alias(id_column), F.col("n").alias("n_shingles"), F.col("label").cast(kind).alias("component_id"), (F.col("rid") == F.col("label")).alias("kept"))
    ids = texts.select("rid", "id")
    named = out.join(ids, "rid").join(ids.select(F.col("rid").alias("label"), F.col("id").alias("low")), "label")
    return named.select(F.col("id").alias(id_column), F.col("n").alias("n_shingles"), F.col("low").alias("component_id"), (F.col("rid") == F.col("label")).alias("kept"))


def keep_first_of_groups(df: DataFrame, shingle: int = 5, percent: int = 80, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The first row of each group of near duplicates, all columns as they were."""
    texts = store.numbered(df, id_column, text_column, whole=True)
    if store.RID_IS_ID not in texts.schema["rid"].metadata:
        own = texts.select(F.col("rid").alias("doc_id"), "text")
        gone = near_duplicates(own, shingle, percent).where("not kept").select(F.col("doc_id").alias("rid"))
    else:
        gone = near_duplicates(df, shingle, percent, id_column, text_column, texts=texts.select("rid", "id", "text")).where("not kept").select(F.col(id_column).cast("long").alias("rid"))
    return texts.join(gone, "rid", "left_anti").select("row.*")
