"""Exact and near duplicates against brute force; filters; components."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import exact_dedup, near_dedup
from millrace.llm.common import Scratch, joined, shingle_set, word_hashes
from millrace.llm.components import connected_components

DOCS = "doc_id long, text string, lang string, source string, n_chars long, keep_id string, bands int, cid int"


def docs_of(spark, texts, ids=None):
    ids = ids or range(len(texts))
    return spark.createDataFrame([(i, t, None, None, None, "clash", 1, 2) for i, t in zip(ids, texts, strict=True)], DOCS)


def test_fuse_filter_has_no_false_negatives():
    rng = np.random.default_rng(1)
    for n in (1, 2, 3, 10, 1000, 50_000):
        keys = np.unique(rng.integers(0, 2**63, n, dtype=np.uint64))
        f = exact_dedup.FuseFilter.unpack(exact_dedup.FuseFilter.build(keys).pack())
        assert f.contains(keys).all()
    other = rng.integers(0, 2**63, 100_000, dtype=np.uint64)
    assert f.contains(other).mean() < 0.01


def test_exact_groups(spark):
    texts = ["a b", "a  b", "a\t\nb", " a b", None, "", "x", "a b", "x" * 200_000, "x" * 200_000, "\x1c", "a \x0b\x0c b"]
    ids = [5, 3, 9, 1, 8, 7, 6, 2, 4, 10, 11, 0]
    got = {r.doc_id: r for r in exact_dedup.dedup_batch(docs_of(spark, texts, ids), F.col("doc_id") <= 5).collect()}
    norm = {i: re.sub(r"[\x20\x09-\x0D]+", " ", t or "") for i, t in zip(ids, texts, strict=True)}
    for i, t in norm.items():
        same = [j for j, u in norm.items() if u == t]
        assert (got[i].keep_id, got[i].group_size, got[i].kept) == (min(same), len(same), i == min(same))


def test_exact_rows_without_or_with_equal_ids(spark):
    got = exact_dedup.dedup_batch(docs_of(spark, ["a", "a", "a", "b", "b"], [None, 1, 1, None, None]), F.col("doc_id") > 0).collect()
    assert sum(r.kept for r in got) == 2 and len(got) == 5
    assert {r.keep_id for r in got if r.text_sha256.startswith("ca978")} == {1}
    assert exact_dedup.first_copies(docs_of(spark, ["a", "a", "a", "b", "b"], [None, 1, 1, None, None]), F.col("doc_id") > 0).count() == 2
    assert exact_dedup.dedup_batch(docs_of(spark, []), F.lit(True)).count() == 0


def test_batches_read_a_stored_snapshot(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "snapshot")
    old = docs_of(spark, ["a", "b", "b", "c c", None], [10, 11, 12, 13, None])
    exact_dedup.write_snapshot(old, path)
    files = {f: f.stat().st_mtime_ns for f in tmp_path.rglob("*") if f.is_file()}
    with pytest.raises(Exception, match="PATH_ALREADY_EXISTS|already exists"):
        exact_dedup.write_snapshot(old, path)
    monkeypatch.setattr(exact_dedup, "build_filters", None)  # nothing is built again
    for texts, ids, want in (
        (["b", "x", "x", "c\n c"], [1, 2, 3, 20], {1: (1, 3, True), 2: (2, 2, True), 3: (2, 2, False), 20: (13, 2, False)}),
        (["", "y", "a"], [5, 6, 10], {5: (5, 2, True), 6: (6, 1, True), 10: (10, 2, False)}),
        ([], [], {}),
    ):
        got = exact_dedup.dedup_incoming(docs_of(spark, texts, ids), exact_dedup.open_snapshot(spark, path), old).collect()
        assert {r.doc_id: (r.keep_id, r.group_size, r.kept) for r in got} == want
    assert {f: f.stat().st_mtime_ns for f in tmp_path.rglob("*") if f.is_file()} == files


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_joins_deal_hot_keys_out(spark, how):
    rows = spark.createDataFrame([(0 if i % 3 else i % 7, i) for i in range(600)], "k long, i long")
    table = spark.createDataFrame([(k, k * 10) for k in (0, 1, 2, 3, 9)], "k long, v long")
    got = joined(rows, table, ["k"], "i", Scratch(spark, "test"), how)
    assert got.columns == rows.join(table, ["k"], how).columns
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, rows.join(table, ["k"], how).collect()), key=str)


def test_word_hashes_follow_the_words():
    words = "One two\tONE  été one Été".encode()
    h = word_hashes(words)
    assert len(h) == 6 and h[0] == h[2] == h[4] and h[3] != h[5] and len({*h.tolist()}) == 4
    assert len(word_hashes(b"")) == len(word_hashes(b" \n")) == 0
    assert len(shingle_set(b"a b a b a b", 3)) == 2 and len(shingle_set(b"a b", 3)) == 1 and shingle_set(b"a b", 3)[0] != shingle_set(b"a b c", 3)[0]


def test_odd_sketch_differs_by_at_most_two_bits_a_value():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**63, 500, dtype=np.uint64)
    b = np.concatenate([a[:450], rng.integers(0, 2**63, 50, dtype=np.uint64)])
    x, y = near_dedup.minhashes(a), near_dedup.minhashes(b)
    bits = int(np.bitwise_count((near_dedup.bands_and_sketch(x)[1] ^ near_dedup.bands_and_sketch(y)[1]).view(np.uint64)).sum())
    assert 0 < bits <= 2 * int((x != y).sum())


def test_estimates_are_near_true_similarities():
    rng = np.random.default_rng(4)
    for share in (0.99, 0.95, 0.9, 0.85, 0.8, 0.7):
        errors, bits = [], []
        for _ in range(200):
            n = int(800 * share)
            a = rng.integers(0, 2**63, 800, dtype=np.uint64)
            b = np.concatenate([a[:n], rng.integers(0, 2**63, 800 - n, dtype=np.uint64)])
            x, y = (near_dedup.bands_and_sketch(near_dedup.minhashes(s))[1].view(np.uint64) for s in (a, b))
            bits.append(int(np.bitwise_count(x ^ y).sum()))
            errors.append(near_dedup.estimate(bits[-1]) - n / (1600 - n))
        j = n / (1600 - n)
        assert abs(np.mean(errors)) < 0.015 and np.std(errors) < 1.2 * near_dedup.deviation(j)
        if n / (1600 - n) >= 0.8:
            assert max(bits) <= near_dedup.most_bits(80)
    unlike = [int(np.bitwise_count(near_dedup.bands_and_sketch(near_dedup.minhashes(rng.integers(0, 2**63, 300, dtype=np.uint64)))[1].view(np.uint64) ^ near_dedup.bands_and_sketch(near_dedup.minhashes(rng.integers(0, 2**63, 300, dtype=np.uint64)))[1].view(np.uint64)).sum()) for _ in range(50)]
    assert min(unlike) > near_dedup.most_bits(80) > near_dedup.most_bits(85)


def brute(texts, ids, width, percent):
    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        return {tuple(w[i : i + width]) for i in range(max(len(w) - width + 1, 1))} if w else set()

    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i, a in enumerate(sets):
        for j in range(i):
            b = sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                root[find(i)] = find(j)
    comp = {}
    for i in range(len(texts)):
        comp[find(i)] = min(comp.get(find(i), ids[i]), ids[i])
    return {ids[i]: (len(sets[i]), comp[find(i)]) for i in range(len(texts))}


def family(seed, n=130, most=9):
    """Near copies of one text at and around the threshold, so that many pairs are no links."""
    r = random.Random(seed)
    vocab = [f"w{i}" for i in range(4000)]
    base = [r.choice(vocab) for _ in range(90)]
    out = []
    for _ in range(n):
        w = list(base)
        for _ in range(r.randint(0, most)):
            w[r.randrange(len(w))] = r.choice(vocab)
        out.append(" ".join(w))
    return out


@pytest.mark.parametrize(("width", "percent", "rounds"), [(3, 85, 6), (3, 85, 0), (5, 80, 0)])
def test_near_components_equal_brute_force(spark, monkeypatch, width, percent, rounds):
    monkeypatch.setattr(near_dedup, "ROUNDS_OF_HEADS", rounds)
    monkeypatch.setattr(near_dedup, "BLOCK", 16)
    texts = family(1) + family(2, 60, 4) + ["the same short line"] * 20 + [None, "", " ", "a", "A", "a b", "x " * 30_000] + [f"only {i} here {i * 7} and {i * 3} more {i}" for i in range(40)]
    ids = random.Random(4).sample(range(10_000), len(texts))
    got = {r.doc_id: r for r in near_dedup.near_duplicates(docs_of(spark, texts, ids), width, percent).collect()}
    want = brute(texts, ids, width, percent)
    assert {i: (r.n_shingles, r.component_id) for i, r in got.items()} == want
    assert all(r.kept == (i == r.component_id) for i, r in got.items())


def test_near_without_ids_or_rows(spark):
    got = near_dedup.near_duplicates(docs_of(spark, ["a b c d e f", "a b c d e f", "q", None], [None, None, None, None])).collect()
    assert len(got) == 4 and all(r.component_id is None and r.kept for r in got)
    assert near_dedup.near_duplicates(docs_of(spark, [])).count() == 0
    assert near_dedup.keep_one(docs_of(spark, ["a b c d e f", "a b c d e f", "q", None], [4, 3, 2, 1])).count() == 3


def test_one_row_of_each_component_stays(spark):
    texts = ["a b c d e f"] * 4 + ["q r s t u v w", "q r s t u v w", None, None, " ", "a b c d e f"]
    ids = [None, None, 7, 7, None, None, None, None, 3, 9]
    kept = near_dedup.keep_one(docs_of(spark, texts, ids)).collect()
    assert sorted((str(r.doc_id), str(r.text)) for r in kept) == [("3", " "), ("7", "a b c d e f"), ("None", "None"), ("None", "None"), ("None", "q r s t u v w")]


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(0, 60)] + [(1000, i) for i in range(1001, 1100)] + [(5, 5)] + [(2000, 2001), (2001, 2000)]
    got = {r.node: r.root for r in connected_components(spark.createDataFrame(edges, "u long, v long"), Scratch(spark, "test")).collect()}
    assert Counter(got.values()) == {0: 61, 1000: 100, 2000: 2}
    assert connected_components(spark.createDataFrame([], "u long, v long"), Scratch(spark, "test")).count() == 0
