"""Sharding by a k-d tree over document metadata, with DataFrame functions only.

The points are groups of equal texts, weighted by their bytes. The tree splits its nodes at
distributed weighted medians along the node's widest dimension (language, source, length, place in
the table; each scaled to 0..1) until there is one leaf per shard. A median is found by
histograms that narrow down to one point, so no node's rows are ever gathered. Groups that are heavy
for a shard (over HEAVY of its target, so few) are placed first, each whole on the lightest shard,
and the medians then fill what is left of each shard. A group larger than a shard is cut in pieces.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from . import store

HEAVY = 1 / 256
BINS = 1024
ROUNDS = 4
DIMS = ("lang", "source", "n_chars", "id")


def _unit(c: Column) -> Column:
    """0 <= x < 1 from a hash, with 20 bits."""
    return F.pmod(c, 1 << 20).cast("double") / float(1 << 20)


def _points(df: DataFrame, id_column: str, text_column: str) -> DataFrame:
    """rid, id, size, crc, h (of the text) and a number for each dimension; missing columns count as null."""
    kinds = dict(df.dtypes)
    text = F.col(text_column).cast("string")
    code = lambda c: F.pmod(F.crc32(F.coalesce(F.col(c).cast("string"), F.lit(""))), 1000).cast("double") if c in kinds else F.lit(0.0)
    number = F.coalesce(F.col("n_chars").cast("double"), F.lit(0.0)) if kinds.get("n_chars") in ("bigint", "int", "double", "float", "smallint") else F.coalesce(F.length(text).cast("double"), F.lit(0.0))
    raw = F.coalesce(text, F.lit(""))
    order = F.col(id_column).cast("double") if kinds[id_column] in ("bigint", "int", "smallint", "tinyint") else F.pmod(F.xxhash64(F.col(id_column)), 1 << 40).cast("double")
    return df.select(
        F.col(id_column).alias("id"),
        (F.octet_length(raw).cast("long") + 1).alias("size"),
        F.crc32(raw.cast("binary")).alias("crc"),
        F.xxhash64(raw).alias("h"),
        F.xxhash64(F.lit("second"), raw).alias("h2"),
        F.coalesce(order, F.lit(-1.0)).alias("d_id"),
        code("lang").alias("d_lang"),
        code("source").alias("d_source"),
        number.alias("d_n_chars"),
    )


def _each(values: list, kind: str = "double") -> Column:
    """The value of each row's node, from a list in the order of nodes: a constant array, so that plans don't grow with the tree."""
    return F.element_at(F.split(F.lit(",".join(map(str, values))), ",").cast(f"array<{kind}>"), F.col("node") + 1)


def _key(wanted: dict[int, tuple[str, float]], count: int) -> tuple[Column, Column]:
    """Whether a row's node is to be split, and the row's key along its node's dimension."""
    dim = _each([DIMS.index(wanted[n][0]) if n in wanted else -1 for n in range(count)], "int")
    return dim >= 0, F.element_at(F.array(*(F.col(f"k_{d}") for d in DIMS)), F.greatest(dim, F.lit(0)) + 1)


def _cut_points(light: DataFrame, wanted: dict[int, tuple[str, float]], count: int) -> dict[int, float]:
    """For each node the value of its dimension's key at which its weight reaches the wanted share.

    wanted: node to (dimension, weight of the left side); nodes have numbers under count. Key: the scaled dimension with a hash of the
    group as its last digits, so that ties split too.
    """
    open_, key = _key(wanted, count)
    rows = light.where(open_).select("node", "w", key.alias("k"))
    span = {r.node: (r.a, r.b) for r in rows.groupBy("node").agg(F.min("k").alias("a"), F.max("k").alias("b")).collect()}
    low = {n: span[n][0] for n in wanted if n in span}
    wide = {n: max(math.nextafter(span[n][1], math.inf) - span[n][0], 1e-300) for n in low}
    before = dict.fromkeys(low, 0.0)
    for _ in range(ROUNDS):
        if not low:
            break
        first, width = _each([low.get(n, 0.0) for n in range(count)]), _each([wide.get(n, 1.0) for n in range(count)])
        binned = rows.withColumn("bin", F.floor((F.col("k") - first) / width * BINS))
        found: dict[int, dict[int, float]] = {}
        for r in binned.where(f"bin >= 0 and bin < {BINS}").groupBy("node", "bin").agg(F.sum("w").alias("w")).collect():
            found.setdefault(r.node, {})[r.bin] = float(r.w)
        for n in low:
            goal, have, chosen = wanted[n][1], before[n], BINS - 1
            for b in range(BINS):
                w = found.get(n, {}).get(b, 0.0)
                if have + w >= goal:
                    chosen = b
                    break
                have += w
            before[n] = have
            low[n] += wide[n] * chosen / BINS
            wide[n] /= BINS
    # The last bin holds about one point; it goes to the side that it fits better.
    return low


def kd_shards(df: DataFrame, shards: int = 8, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row: id_column, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null).

    Rows with equal texts share a shard (unless they alone exceed one); null texts weigh 1 byte and count
    as empty. Slots number a shard's rows from 0 without gaps; rows with the same id stand in any order.
    An empty table gives an empty result.
    """
    rows, _ = store.write(_points(df, id_column, text_column), "points")
    groups = rows.groupBy("h", "h2").agg(F.sum("size").alias("w"), *(F.min(f"d_{d}").alias(f"d_{d}") for d in DIMS))
    groups, _ = store.write(groups, "groups")
    whole = groups.agg(F.sum("w").alias("w"), *(f(f"d_{d}").alias(f"{n}_{d}") for d in DIMS for n, f in (("a", F.min), ("b", F.max)))).first()
    total = float(whole.w or 0)
    target = total / shards
    load = [0.0] * shards
    pieces: dict[tuple[int, int], list[int]] = {}
    # At most shards / HEAVY groups are heavy.
    for r in groups.where(F.col("w") > target * HEAVY).orderBy(F.desc("w"), "h", "h2").collect() if total else []:
        count = max(1, math.ceil(r.w / max(target, 1.0) - 1e-9))
        own = []
        for _ in range(count):
            s = min(range(shards), key=lambda x: (load[x], x))
            load[s] += r.w / count
            own.append(s)
        pieces[(r.h, r.h2)] = own
    spark = df.sparkSession
    heavy = spark.createDataFrame([(h, h2, s) for (h, h2), s in pieces.items()], "h long, h2 long, own array<int>")
    jitter = _unit(F.col("h"))
    scaled = []
    for d in DIMS:
        a, b = getattr(whole, f"a_{d}") or 0.0, getattr(whole, f"b_{d}") or 0.0
        step = 1.0 if d != "id" else max(1.0, (b - a) / 1e9)
        scaled.append((((F.col(f"d_{d}") - a) + jitter * step) / (b - a + step)).alias(f"k_{d}"))
    light = groups.join(F.broadcast(heavy.select("h", "h2")), ["h", "h2"], "left_anti").select("h", "h2", "w", F.lit(0).alias("node"), *scaled)
    light, path = store.write(light, "light")
    room = [max(target - x, 0.0) for x in load]
    nodes = {0: (0, shards)}
    while any(b - a > 1 for a, b in nodes.values()):
        split = {n: v for n, v in nodes.items() if v[1] - v[0] > 1}
        stats = {r.node: r for r in light.where(_each([int(n in split) for n in range(len(nodes))], "int") == 1).groupBy("node").agg(F.sum("w").alias("w"), *((F.max(f"k_{d}") - F.min(f"k_{d}")).alias(d) for d in DIMS)).collect()}
        wanted = {}
        for n, (a, b) in split.items():
            if n not in stats:
                continue
            mid = (a + b) // 2
            share = sum(room[a:mid]) / (sum(room[a:b]) or 1.0)
            wanted[n] = (max(DIMS, key=lambda d: stats[n][d]), float(stats[n].w) * share)
        cuts = _cut_points(light, wanted, len(nodes)) if wanted else {}
        after = {n: v for n, v in nodes.items() if n not in split}
        right = dict(zip(split, range(len(nodes), len(nodes) + len(split)), strict=True))
        for n, (a, b) in split.items():
            mid = (a + b) // 2
            after[n], after[right[n]] = (a, mid), (mid, b)
        _, key = _key(wanted, len(nodes))
        to = _each([right[n] if n in cuts else -1 for n in range(len(nodes))], "int")
        moved = F.when((to >= 0) & (key >= _each([cuts.get(n, 0.0) for n in range(len(nodes))])), to).otherwise(F.col("node"))
        # Each level is written, so that neither plans nor recomputation grow with the depth.
        last, nodes = path, after
        light, path = store.write(light.withColumn("node", moved), "light")
        store.drop(spark, last)
    shard = _each([nodes[n][0] for n in range(len(nodes))], "int")
    placed = light.select("h", "h2", F.array(shard).alias("own")).union(heavy)
    placed, _ = store.write(placed, "placed")
    store.drop(spark, path)
    chosen = rows.join(placed, ["h", "h2"])
    one = F.element_at("own", (F.pmod(F.xxhash64("id"), F.size("own")) + 1).cast("int"))
    # Slots: rows are numbered in chunks by a hash of the id, after the counts of the chunks before.
    chunks = max(16, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    out, _ = store.write(chosen.select("id", "size", "crc", one.alias("shard"), F.pmod(F.xxhash64("id", "size"), F.lit(chunks)).cast("int").alias("chunk")), "sharded")
    counts = out.groupBy("shard", "chunk").agg(F.count("*").alias("n"))
    starts = counts.withColumn("start", F.sum("n").over(Window.partitionBy("shard").orderBy("chunk")) - F.col("n")).select("shard", "chunk", "start")
    numbered = out.withColumn("k", F.row_number().over(Window.partitionBy("shard", "chunk").orderBy("id", "crc")))
    return numbered.join(F.broadcast(starts), ["shard", "chunk"]).select(
        F.col("id").alias(id_column), "size", F.col("crc").cast("long").alias("text_crc32"), F.lit("bytes").alias("law"), F.col("shard").cast("int").alias("shard"), (F.col("start") + F.col("k") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard")
    )
