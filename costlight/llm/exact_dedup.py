"""Exact dedup with an extendible-hash index on shared files.

Texts are lower-cased (A-Z) and hashed. A directory of 2**depth slots, addressed by the first bits
of the hash, points to buckets; an overfull bucket splits by one more bit and the directory doubles
when that bucket was as deep as it. A batch that is inserted splits the buckets that it overfills, by a histogram of
hash prefixes a few bits longer than the data need (so it has some counts for each bucket, whatever the
size of the data); the other buckets stay as they are. Each bucket has one owner task, which reads its key range in
order, chains texts whose hashes collide and tells them apart by their bytes. The index files
(bucket, hash, chain, text, kept row, size) lie in the shared folder, a folder for each bucket.

Skew: copies within one Arrow batch reach the owner as one row with a count, so a text that makes up
a third of the corpus arrives as one row per batch; the answer goes back to the rows by a
join that adaptive execution splits.
"""

from __future__ import annotations

import hashlib
import uuid
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import store

#: Most bytes of different texts in a bucket; a single text may have more.
CAPACITY = 4 << 20
#: The histogram has so many bits more than the average bucket needs.
SPARE_BITS = 4
#: A directory of more bits is joined as a table instead of standing in the plan.
INLINE_DEPTH = 10
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
STORED = "h long, chain int, sha string, keep_rid long, size long, norm string"
INDEX = f"bucket int, {STORED}"


class Directory:
    """Slots to buckets: (prefix, local depth) of each bucket, by its number. Numbers of split buckets aren't used again."""

    def __init__(self):
        self.buckets: dict[int, tuple[int, int]] = {0: (0, 0)}
        self.next = 1

    @property
    def depth(self) -> int:
        return max(d for _, d in self.buckets.values())

    def grow(self, weights: dict[int, int], bits: int, capacity: int) -> list[int]:
        """Splits overfull buckets, as far as bits; weights: bytes by hash prefix of so many bits. Gives the numbers of those split."""
        total = [0]
        at = sorted(weights)
        for x in at:
            total.append(total[-1] + weights[x])
        gone = []
        for number, (prefix, local) in list(self.buckets.items()):
            open_, parts = [(prefix, local)], []
            while open_:
                p, d = open_.pop()
                shift = max(0, bits - d)
                low, high = bisect_left(at, p << shift), bisect_left(at, (p + 1) << shift)
                if total[high] - total[low] > capacity and d < bits and high - low > 1:
                    open_ += [(2 * p + 1, d + 1), (2 * p, d + 1)]
                else:
                    parts.append((p, d))
            if len(parts) > 1:
                del self.buckets[number]
                gone.append(number)
                for part in parts:
                    self.buckets[self.next] = part
                    self.next += 1
        return gone

    def slots(self) -> list[int]:
        out, depth = [0] * (1 << self.depth), self.depth
        for number, (prefix, local) in self.buckets.items():
            span = 1 << (depth - local)
            out[prefix * span : (prefix + 1) * span] = [number] * span
        return out

    def place(self, rows: DataFrame) -> DataFrame:
        """Adds the bucket of each row's h."""
        depth = self.depth
        if not depth:
            return rows.withColumn("bucket", F.lit(self.slots()[0]))
        slot = F.shiftrightunsigned(F.col("h"), 64 - depth)
        if depth <= INLINE_DEPTH:
            slots = F.split(F.lit(",".join(map(str, self.slots()))), ",").cast("array<int>")
            return rows.withColumn("bucket", F.element_at(slots, slot.cast("int") + 1))
        # Spark broadcasts the directory as long as its size allows.
        table = rows.sparkSession.createDataFrame(list(enumerate(self.slots())), "slot long, bucket int")
        return rows.withColumn("slot", slot).join(table, "slot").drop("slot")


def _combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per different text of a batch: its last row and how many there are."""
    for batch in batches:
        found: dict[bytes, list] = {}
        bucket, h, rid = (batch.column(k).to_pylist() for k in range(3))
        for k, norm in enumerate(batch.column(3).cast(pa.binary()).to_pylist()):
            one = found.setdefault(norm, [k, rid[k], 0])
            one[1] = max(one[1], rid[k])
            one[2] += 1
        take = pa.array([x[0] for x in found.values()], pa.int64())
        yield pa.RecordBatch.from_arrays([batch.column(0).take(take), batch.column(1).take(take), pa.array([x[1] for x in found.values()], pa.int64()), pa.array([x[2] for x in found.values()], pa.int64()), batch.column(3).take(take)], names=["bucket", "h", "keep_rid", "size", "norm"])


def _own(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows come in order of (bucket, h); rows of one hash are chained by their bytes."""
    names = ["bucket", "h", "chain", "sha", "keep_rid", "size", "norm"]
    types = [pa.int32(), pa.int64(), pa.int32(), pa.string(), pa.int64(), pa.int64(), pa.string()]
    at, chain, out, held = None, [], [], 0

    def flush():
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 7, types, strict=True)], names=names)

    for batch in batches:
        for bucket, h, rid, n, norm in zip(*(batch.column(k).to_pylist() for k in range(5)), strict=True):
            if (bucket, h) != at:
                out += [(*at, k, hashlib.sha256(c[0].encode()).hexdigest(), c[1], c[2], c[0]) for k, c in enumerate(chain)]
                held += sum(len(c[0]) for c in chain)
                at, chain = (bucket, h), []
                if held > 1 << 23:
                    yield flush()
                    out, held = [], 0
            for c in chain:
                if c[0] == norm:
                    c[1], c[2] = max(c[1], rid), c[2] + n
                    break
            else:
                chain.append([norm, rid, n])
    out += [(*at, k, hashlib.sha256(c[0].encode()).hexdigest(), c[1], c[2], c[0]) for k, c in enumerate(chain)]
    if out:
        yield flush()


class ExtendibleIndex:
    """Insert batches of (rid, h, norm); groups holds (h, sha, keep_rid, size) of all that was inserted."""

    def __init__(self, spark: SparkSession, capacity: int = CAPACITY):
        self.spark, self.capacity = spark, capacity
        self.root = store.new_path(spark, "exact-index")
        self.paths: dict[int, str] = {}  # bucket to its folder
        self.directory = Directory()

    def _read(self, buckets: list[int]) -> DataFrame:
        return self.spark.read.schema(STORED).parquet(*(self.paths[k] for k in buckets))

    def insert(self, keyed: DataFrame) -> None:
        """The batch's rows and the index rows of the buckets that they touch are merged; other buckets' files stay."""
        weight = (F.octet_length("norm").cast("long") + 64).alias("w")
        sizes = keyed.groupBy("h").agg(F.max(F.octet_length("norm")).cast("long").alias("w")).select("h", (F.col("w") + 64).alias("w"))
        if self.paths:
            sizes = sizes.union(self._read(list(self.paths)).select("h", weight)).groupBy("h").agg(F.max("w").alias("w"))
        sizes, path = store.write(sizes, "weights")
        total = sizes.agg(F.coalesce(F.sum("w"), F.lit(0)).alias("w")).first().w
        bits = max(self.directory.depth, SPARE_BITS + max(0, (total // self.capacity).bit_length()))
        prefix = F.shiftrightunsigned(F.col("h"), 64 - bits)
        self.directory.grow({r.p: r.w for r in sizes.groupBy(prefix.alias("p")).agg(F.sum("w").alias("w")).collect()}, bits, self.capacity)
        store.drop(self.spark, path)
        rows = self.directory.place(keyed.select("h", "rid", "norm")).select("bucket", "h", "rid", "norm").mapInArrow(_combine, "bucket int, h long, keep_rid long, size long, norm string")
        if self.paths:
            # Buckets that the batch touches or that were split; folders are named by bucket, so this tells which to read.
            touched = {r.bucket for r in self.directory.place(keyed.select("h")).select("bucket").distinct().collect()}
            old = [k for k in self.paths if k in touched or k not in self.directory.buckets]
            if old:
                rows = rows.union(self.directory.place(self._read(old)).select("bucket", "h", "keep_rid", "size", "norm"))
        else:
            old = []
        path = f"{self.root}/{uuid.uuid4().hex}"
        owned = rows.repartition("bucket").sortWithinPartitions("bucket", "h").mapInArrow(_own, INDEX)
        store.write_by(owned, "bucket", path)
        for k in old:
            store.drop(self.spark, self.paths.pop(k))
        self.paths |= {int(x.partition("=")[2]): f"{path}/{x}" for x in store.names_in(self.spark, path) if x.startswith("bucket=")}

    @property
    def groups(self) -> DataFrame:
        if not self.paths:
            return self.spark.createDataFrame([], "h long, sha string, keep_rid long, size long")
        return self._read(list(self.paths)).select("h", "sha", "keep_rid", "size")


def _keyed(texts: DataFrame) -> DataFrame:
    text = F.coalesce(F.col("text"), F.lit(""))
    # lower() has a fast way for ASCII, where it changes A-Z only.
    norm = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return texts.select("*", norm.alias("norm")).withColumn("h", F.xxhash64("norm"))


def _decide(texts: DataFrame, capacity: int) -> DataFrame:
    index = ExtendibleIndex(texts.sparkSession, capacity)
    keyed = _keyed(texts)
    index.insert(keyed.select("rid", "h", "norm"))
    groups = index.groups
    # A text's digest comes from its group; only hashes that several texts share need the row's own.
    shared = groups.groupBy("h").agg(F.count("*").alias("texts")).where("texts > 1").select("h")
    if shared.limit(1).count() == 0:
        return keyed.select("rid", "id", "h").join(groups, "h")
    mark = shared.withColumn("shared", F.lit(True))
    rows = keyed.join(mark, "h", "left").select("rid", "id", "h", F.when(F.col("shared"), F.sha2("norm", 256)).alias("own"))
    sides = groups.join(mark, "h", "left")
    return rows.join(sides.withColumnRenamed("h", "gh"), (F.col("h") == F.col("gh")) & (F.col("shared").isNull() | (F.col("own") == F.col("sha")))).select("rid", "id", "h", "sha", "keep_rid", "size")


def exact_dedup(df: DataFrame, capacity: int = CAPACITY, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id_column, keep_id, group_size, kept, text_sha256 (of the normalised text).

    Of equal texts the row with the largest id stays; null counts as the empty text. Of rows with the
    same id and text the last by store.numbered stays.
    """
    texts = store.numbered(df, id_column, text_column)
    decided = _decide(texts, capacity)
    unique = F.col("keep_rid")
    if texts.schema["rid"].dataType != texts.schema["id"].dataType or not _is_rid(texts):
        last = texts.select(F.col("rid").alias("keep_rid"), F.col("id").alias("keep_id"))
        decided = decided.join(last, "keep_rid")
        unique = F.col("keep_id")
    return decided.select(F.col("id").alias(id_column), unique.alias("keep_id"), F.col("size").alias("group_size"), (F.col("rid") == F.col("keep_rid")).alias("kept"), F.col("sha").alias("text_sha256"))


def _is_rid(texts: DataFrame) -> bool:
    """Whether rows are known by their own ids (they were not numbered)."""
    return store.RID_IS_ID in texts.schema["rid"].metadata


def keep_last_copies(df: DataFrame, capacity: int = CAPACITY, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows that exact_dedup keeps, all columns as they were."""
    texts = store.numbered(df, id_column, text_column, whole=True)
    keep = _decide(texts.select("rid", "id", "text"), capacity).where("rid = keep_rid").select("rid")
    return texts.join(keep, "rid", "left_semi").select("row.*")
