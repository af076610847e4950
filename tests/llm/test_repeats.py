"""Suffix-array and substring dedup against brute force."""

import hashlib
import random
import re
import time

import pytest

from costlight.llm import store, substring_dedup as substring, suffix_dedup as suffix
from costlight.llm.runs import ByteTokens, RunIndex, Windows, WordTokens, remove_repeats
from costlight.llm.substring_dedup import substring_dedup
from costlight.llm.suffix_dedup import suffix_array_dedup


def brute_bytes(rows, width):
    seen, out = set(), {}
    for i, text in sorted(rows):
        b = (text or "").encode()
        gone = [False] * len(b)
        for p in range(len(b) - width + 1):
            w = b[p : p + width]
            if w in seen:
                gone[p : p + width] = [True] * width
            seen.add(w)
        kept = bytes(x for x, g in zip(b, gone) if not g)
        spans = sum(g and not (k and gone[k - 1]) for k, g in enumerate(gone))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def brute_words(rows, width):
    seen, out = set(), {}
    for i, text in sorted(rows):
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        gone = [False] * len(w)
        new = set()
        for p in range(len(w) - width + 1):
            g = tuple(w[p : p + width])
            if g in seen:
                gone[p : p + width] = [True] * width
            new.add(g)
        seen |= new
        out[i] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest())
    return out


def corpus(seed, n=60):
    r = random.Random(seed)
    words = ["the", "a", "é", "ñandú", "of", "x" * 40, "日本語", "foo,", "bar."] + [f"w{i}" for i in range(200)]
    docs = []
    for i in range(n):
        kind = r.random()
        if kind < 0.1:
            docs.append(None if kind < 0.05 else "")
        elif kind < 0.3 and docs:
            docs.append(r.choice(docs))
        elif kind < 0.6 and docs and (base := r.choice(docs)):
            w = base.split(" ")
            for _ in range(3):
                w[r.randrange(len(w))] = r.choice(words)
            docs.append(" ".join(w))
        elif kind < 0.65:
            docs.append("aaaa " * r.randrange(1, 90))
        else:
            line = " ".join(r.choice(words) for _ in range(30))
            docs.append(r.choice(["\n", " ", "\t"]).join([" ".join(r.choice(words) for _ in range(r.randrange(1, 120))), line * r.randrange(3)]))
    ids = r.sample(range(10 * n), n)
    return list(zip(ids, docs))


@pytest.mark.parametrize("seed,batches", [(1, 1), (2, 2), (3, 4), (4, 7)])
def test_bytes_match_brute_force(spark, seed, batches):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_array_dedup(df, batches=batches).collect()}
    assert got == brute_bytes(rows, 100)


@pytest.mark.parametrize("seed,batches", [(5, 1), (6, 2), (7, 5)])
def test_words_match_brute_force(spark, seed, batches):
    rows = corpus(seed)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup(df, batches=batches).collect()}
    assert got == brute_words(rows, 13)


def test_short_windows(spark):
    rows = corpus(9, 40)
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = {r.id: (r.n_tokens, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(df, Windows(12, 4, ByteTokens, True), 3).collect()}
    assert got == brute_bytes(rows, 12)
    got = {r.id: (r.n_tokens, r.n_removed, r.kept_sha256) for r in remove_repeats(df, Windows(3, 1, WordTokens, False), 3).collect()}
    assert got == brute_words(rows, 3)


def test_empty_table_clashing_columns_and_repeated_ids(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert suffix_array_dedup(empty).collect() == []
    assert substring_dedup(empty).collect() == []
    text = " ".join(f"word{i}" for i in range(40))
    df = spark.createDataFrame([(1, text, 5), (1, text, 6), (None, text, 7)], "doc_id long, text string, rid int")
    got = sorted((r.doc_id is None, r.n_removed == r.n_bytes) for r in suffix_array_dedup(df).collect())
    assert got == [(False, True), (False, True), (True, False)]


def test_kept_text(spark):
    text = " ".join(f"word{i}" for i in range(40))
    df = spark.createDataFrame([(1, text), (2, "new  start " + text)], "doc_id long, text string")
    assert {r.doc_id: bytes(r.kept) for r in substring_dedup(df, with_text=True).collect()} == {1: text.encode(), 2: b"new start"}
    assert {r.doc_id: bytes(r.kept) for r in suffix_array_dedup(df, with_text=True).collect()} == {1: text.encode(), 2: b"new  start "}


def thue_morse(n):
    """Two different words whose polynomial hashes modulo 2**64 are equal for every odd base, from 1024 characters on."""
    word = "".join("ab"[bin(i).count("1") & 1] for i in range(n))
    return word, word.translate(str.maketrans("ab", "ba"))


@pytest.mark.parametrize("n", [1024, 2048])
def test_words_of_equal_polynomial_hash_are_told_apart(spark, n):
    x, y = thue_morse(n)
    rest = " " + " ".join(f"w{i}" for i in range(12))
    rows = [(1, x + rest), (2, y + rest), (3, x + rest)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in substring_dedup(df).collect()} == brute_words(rows, 13)
    assert {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_array_dedup(df).collect()} == brute_bytes(rows, 100)


def test_hot_keys_are_refined_by_a_shuffle(spark):
    r = random.Random(11)
    phrase = "the very same phrase that everyone writes here "
    rows = [(i, " ".join(f"{r.randrange(40)}" for _ in range(20)) + " " + phrase + " ".join(f"{r.randrange(40)}" for _ in range(20))) for i in range(60)]
    rows += [(100 + i, rows[i][1][3:] + " x") for i in range(20)] + [(200, phrase * 9)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(2)
    for most in (2, 7):
        got = {x.id: (x.n_tokens, x.n_removed, x.n_spans, x.kept_sha256) for x in remove_repeats(df, suffix.SPEC, 3, hot_blocks=most).collect()}
        assert got == brute_bytes(rows, 100)
        got = {x.id: (x.n_tokens, x.n_removed, x.kept_sha256) for x in remove_repeats(df, substring.SPEC, 3, hot_blocks=most).collect()}
        assert got == brute_words(rows, 13)


@pytest.mark.parametrize("spec,width,brute", [(suffix.SPEC, 100, brute_bytes), (substring.SPEC, 13, brute_words)])
def test_a_later_session_goes_on_from_the_manifest(spark, spec, width, brute):
    rows = sorted(corpus(12))
    df = store.numbered(spark.createDataFrame(rows, "doc_id long, text string"))
    cuts = [rows[k][0] for k in (15, 30, 45)]
    index = RunIndex(spark, spec)
    for low, high in ((-1, cuts[0]), (cuts[0], cuts[1]), (cuts[1], cuts[2])):
        index.scan(df.where(f"rid > {low} and rid <= {high}"))
    index.save()
    assert [x.size for x in index.levels] == [2, 1]
    again = RunIndex.open(spark, spec, index.path)
    again.scan(df.where(f"rid > {cuts[2]}"))
    assert [x.size for x in again.levels] == [4]
    gone = {}
    for m in again.repeats(df).where(f"doc > {cuts[2]}").collect():
        gone.setdefault(m.doc, set()).update(range(m.pos, m.pos + m.n - 1 + width))
    want = {i: v[1] for i, v in brute(rows, width).items() if i > cuts[2]}
    assert {i: len(gone.get(i, ())) for i in want} == want


def test_texts_longer_than_a_piece(spark):
    r = random.Random(13)
    part = " ".join(f"{r.randrange(10**6)}" for _ in range(60_000))
    long = " ".join([part, *(f"{r.randrange(10**6)}" for _ in range(120_000)), part])
    rows = [(1, part), (2, long), (3, "x" + long)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert len(long) > 1 << 20
    assert {x.doc_id: (x.n_words, x.n_removed, x.kept_sha256) for x in substring_dedup(df).collect()} == brute_words(rows, 13)
    got = {x.doc_id: (x.n_bytes, x.n_removed) for x in suffix_array_dedup(df).collect()}
    assert got == {i: v[:2] for i, v in brute_bytes(rows, 100).items()}


def test_a_written_run_leaves_no_shuffle_files(spark):
    """Else the shuffles of all batches lie on the disk until the driver happens to collect its garbage."""

    def shuffles():
        files = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllFiles().mkString(" ")
        return set(re.findall(r"/shuffle_(\d+)_", files))

    df = store.numbered(spark.createDataFrame(corpus(14), "doc_id long, text string").repartition(3))
    df, _ = store.write(df, "texts")
    index = RunIndex(spark, substring.SPEC)
    before = shuffles()
    index.scan(df)
    for _ in range(20):
        left = shuffles() - before
        if not left:
            break
        time.sleep(0.25)
    index.drop()
    assert not left
