"""The k-d tree against a plain one that sorts each node's points."""

import random
import struct
import zlib

import pytest
import xxhash

from costlight.llm import kd_shards

DIMS = ("lang", "source", "n_chars", "id")


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def plain_tree(rows, shards):
    """For each text the shards that may hold its rows: one, or those of its pieces."""
    crc = lambda x: float(zlib.crc32((x or "").encode()) % 1000)
    groups = {}
    for i, text, lang, source in rows:
        raw = text or ""
        point = {"lang": crc(lang), "source": crc(source), "n_chars": float(len(raw)), "id": float(i)}
        w, low = groups.get(raw, (0, point))
        groups[raw] = (w + len(raw.encode()) + 1, {d: min(low[d], point[d]) for d in DIMS})
    digest = {t: xxhash.xxh64_intdigest(t.encode(), seed=42) for t in groups}
    target = float(sum(w for w, _ in groups.values())) / shards
    load, where = [0.0] * shards, {}
    heavy = sorted((t for t in groups if groups[t][0] > target / 256), key=lambda t: (-groups[t][0], signed(digest[t])))
    for t in heavy:
        w = groups[t][0]
        count = max(1, -int(-w // max(target, 1.0)))
        where[t] = []
        for _ in range(count):
            s = min(range(shards), key=lambda x: (load[x], x))
            load[s] += w / count
            where[t].append(s)
    room = [max(target - x, 0.0) for x in load]
    keys = {}
    for d in DIMS:
        values = [p[d] for _, p in groups.values()]
        a, b = min(values), max(values)
        step = 1.0 if d != "id" else max(1.0, (b - a) / 1e9)
        for t in groups:
            jitter = (digest[t] % (1 << 20)) / float(1 << 20)
            keys[t, d] = ((groups[t][1][d] - a) + jitter * step) / (b - a + step)

    def split(points, a, b):
        if b - a == 1 or not points:
            where.update({t: [a] for t in points})
            return
        mid = (a + b) // 2
        widest = max(DIMS, key=lambda d: max(keys[t, d] for t in points) - min(keys[t, d] for t in points))
        goal = sum(groups[t][0] for t in points) * (sum(room[a:mid]) / (sum(room[a:b]) or 1.0))
        left, right, have = [], [], 0
        for t in sorted(points, key=lambda t: keys[t, widest]):
            have += groups[t][0]
            (left if have < goal else right).append(t)
        split(left, a, mid)
        split(right, mid, b)

    split([t for t in groups if t not in where], 0, shards)
    return where, len(heavy)


@pytest.mark.parametrize("shards,many", [(8, 0), (8, 5), (5, 1)])
def test_tree_is_that_of_a_plain_programme(spark, shards, many):
    r = random.Random(shards + many)
    rows = [(i, f"{i} " + "x" * r.randrange(30), r.choice(["en", "de", "fr", None]), r.choice("abc")) for i in range(6000)]
    rows += [(10_000 * (k + 3) + i, f"copy {k} " + "y" * 20, "en", "a") for k in range(many) for i in range(40 if k else 2000)]
    rows += [(20_000, None, None, None), (20_001, "", "en", "a"), (20_002, "é" * 9, "en", "b")]
    r.shuffle(rows)
    want, heavy = plain_tree(rows, shards)
    assert heavy <= many < len(want)
    got = kd_shards.kd_shards(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(5), shards=shards).collect()
    text = {i: t or "" for i, t, _, _ in rows}
    assert sorted(x.doc_id for x in got) == sorted(text)
    # Rows of a group that is cut are dealt out to its pieces by a hash of their ids.
    deal = lambda i, own: own[signed(xxhash.xxh64_intdigest(struct.pack("<q", i), seed=42)) % len(own)]
    assert [x for x in got if deal(x.doc_id, want[text[x.doc_id]]) != x.shard] == []
    assert all(x.size == len(text[x.doc_id].encode()) + 1 and x.text_crc32 == zlib.crc32(text[x.doc_id].encode()) for x in got)
    size = [sum(x.size for x in got if x.shard == s) for s in range(shards)]
    if not many:
        assert max(size) - min(size) < 0.03 * sum(size) / shards
    for s in range(shards):
        assert sorted(x.slot for x in got if x.shard == s) == list(range(sum(x.shard == s for x in got)))
