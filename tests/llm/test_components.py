"""Connected components go on until nothing changes."""

import random

import numpy as np

from costlight.llm import minhash, store


def test_components_have_no_cap_of_rounds(spark, monkeypatch):
    # A cap counted by range() would end after one round here, as a cap of 60 would on a harder graph.
    monkeypatch.setattr(minhash, "range", lambda *a: range(1), raising=False)
    path = [(k, k + 1) for k in range(40)] + [(k + 1, k) for k in range(100, 110)]
    got = {r.node: r.label for r in minhash.components(spark.createDataFrame(path, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(41)} | {k: 100 for k in range(100, 111)}


def shared_passage(n, clusters):
    """Documents that share a long passage (no links by that), in clusters of near copies of their rest."""
    r = random.Random(4)
    passage = " ".join(f"p{i}" for i in range(150))
    rests = [[f"{c}x{i}" for i in range(80)] for c in range(clusters)]
    out = []
    for i in range(n):
        w = list(rests[i % clusters])
        for _ in range(r.randrange(12)):
            w[r.randrange(80)] = f"own{i}"
        out.append((i, passage + " " + " ".join(w)))
    return out


def test_large_groups_without_a_main_component(spark):
    from test_operators import brute_near

    for rows in (shared_passage(120, 120), shared_passage(120, 8)):
        df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
        got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in minhash.near_duplicates(df, 2, group_bytes=30_000).collect()}
        assert got == brute_near(rows, 2, 80)
    # What only shares the passage falls apart before any set is compared.
    rows = shared_passage(40, 40)
    sets = minhash._sets(2)
    df = spark.createDataFrame([(i, 0, t, b"") for i, t in rows], "rid long, grp long, text string, regs binary").mapInArrow(sets, "rid long, grp long, n long, regs binary, h binary")
    assert minhash._regroup(df, 80, store.Scratch(spark)).count() == 0


def test_union_relabels_the_smaller_side():
    r = np.random.default_rng(5)
    union, plain = minhash._Union(200), list(range(200))
    for _ in range(150):
        i, others = int(r.integers(200)), r.integers(0, 200, 3)
        union.join(i, others)
        for x in others.tolist():
            a, b = plain[i], plain[x]
            plain = [min(a, b) if y in (a, b) else y for y in plain]
        assert union.firsts().tolist() == plain
        assert union.size[union.root[i]] == (union.root == union.root[i]).sum()
