"""The pipeline's run() against a plain programme."""

import hashlib
import random
import re

from test_operators import brute_near, slow_merging

import corpus_pipeline
from costlight.llm import pieces

INSULTS = ["idiot", "scum", "moron"]


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def plain(docs, items):
    """Ids that stay: not toxic, the last of equal texts, the first of near copies, without a window of an item."""
    left = {i: t for i, t in docs if not any(w in INSULTS for w in (t or "").split())}
    last = {lower(t): i for i, t in sorted(left.items())}
    left = {i: left[i] for i in last.values()}
    near = brute_near(list(left.items()), 5, 80)
    left = {i: t for i, t in left.items() if near[i][2]}
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    grams = lambda w, n: {tuple(w[k : k + n]) for k in range(len(w) - n + 1)}
    windows = [(min(10, len(words(x))), grams(words(x), min(10, len(words(x))))) for x in items if words(x)]
    return {i: t for i, t in left.items() if not any(grams(words(t), n) & g for n, g in windows)}


def test_pipeline_matches_a_plain_programme(spark, tmp_path):
    r = random.Random(6)
    vocabulary = [f"w{i}" for i in range(300)]
    texts = lambda n: [r.choice(vocabulary) for _ in range(n)]
    items = [" ".join(f"b{i}" for i in range(14)), "Short item here", "", None]
    docs, labels = [], []
    for i in range(500):
        w = texts(60)
        if i % 5 == 0:
            for k in r.sample(range(60), 12):
                w[k] = r.choice(INSULTS)
        docs.append((1000 + i, " ".join(w)))
        labels.append((1000 + i, int(i % 5 == 0)))
    near = lambda text: text.rsplit(" ", 1)[0] + " zz"
    some = [" ".join(texts(60)) for _ in range(5)]
    leak = " ".join(["x", *(f"B{i}," for i in range(11)), *texts(60)])
    docs += [
        (10, some[0]), (50, some[0].upper()), (30, near(some[0])),  # 50 stays of the equal ones, then 30 of the near ones
        (60, some[1]), (61, some[1]), (62, near(some[1])),  # 61, then 61
        (70, leak), (71, near(leak)),  # 70, then none
        (80, "a short ITEM; here " + some[2]), (81, some[3] + " short item"),  # the first goes
        (90, " ".join(INSULTS * 4) + " " + some[4]), (91, near(some[4])),  # the first is toxic, so the second stays
        (95, None), (96, ""), (97, "One"), (98, "one"),
    ]
    r.shuffle(docs)
    sf = str(tmp_path)
    spark.createDataFrame([(i, t, "en", "a") for i, t in docs], "doc_id long, text string, lang string, source string").repartition(3).write.parquet(f"{sf}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{sf}/labels.parquet")
    spark.createDataFrame(list(enumerate(items)), "item_id long, text string").write.parquet(f"{sf}/benchmark.parquet")
    want = plain(docs, items)
    assert {30, 61, 81, 91, 96, 98} <= set(want) and not {10, 50, 60, 62, 70, 71, 80, 90, 95, 97} & set(want)
    rows = corpus_pipeline.run(spark, sf).collect()
    assert sorted(x.doc_id for x in rows) == sorted(want)
    assert all(x.exact and x.decoded_sha256 == hashlib.sha256((want[x.doc_id] or "").encode()).hexdigest() for x in rows)
    p = pieces.load()
    for x in rows:
        if x.doc_id < 100 and want[x.doc_id]:
            assert x.ids == slow_merging(p, want[x.doc_id])
