"""Near duplicates and vector search against brute force."""

import random

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from veilframe.llm import components, golay, near_dup, vector_search


def brute_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] if len(words) >= 4 else [b" ".join(words)] if words else []
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(prints):
    ids = sorted(prints)
    label = {i: i for i in ids}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for a in ids:
        for b in ids:
            if a < b and bin(prints[a] ^ prints[b]).count("1") <= 4:
                x, y = root(a), root(b)
                label[max(x, y)] = min(x, y)
    return {i: root(i) for i in ids}


def test_golay_is_perfect_and_covers_two_errors():
    rng = np.random.default_rng(0)
    words = rng.integers(0, 1 << 23, 3000)
    index, real = golay.nearby_indices(words)
    parity, *_ = golay._tables()
    code = (index << 11) | parity[index]
    away = np.bitwise_count((code ^ words[:, None]).astype(np.uint32))
    assert (away[:, 0] <= 3).all() and (away[real] <= 4).all() and (real[:, 1:].any(1) == (away[:, 0] == 3)).all()
    flips = np.array([sum(1 << b for b in random.Random(i).sample(range(23), 2)) for i in range(3000)])
    other, real2 = golay.nearby_indices(words ^ flips)
    for a, ra, b, rb in zip(index, real, other, real2, strict=True):
        assert set(a[ra]) & set(b[rb])


def test_keys_meet_within_four_bits():
    rng = random.Random(2)
    for _ in range(200):
        a = rng.getrandbits(64)
        b = a
        for bit in rng.sample(range(64), 4):
            b ^= 1 << bit
        keys, owner = near_dup.golay_keys(np.array([a, b], np.uint64))
        assert set(keys[owner == 0].tolist()) & set(keys[owner == 1].tolist())


def test_groups_match_brute_force(spark, make_docs):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(300)]
    base = [" ".join(rng.choice(vocabulary) for _ in range(rng.randint(30, 90))) for _ in range(40)]
    texts = []
    for t in base:
        for _ in range(6):
            words = t.split()
            words[rng.randrange(len(words))] = rng.choice(vocabulary)
            texts.append(" ".join(words))
    texts += ["", "  ", "One", "one", "A b C", *base[:10]]
    docs = make_docs([(i * 3, t, None, None) for i, t in enumerate(texts)])
    got = {r.doc_id: r for r in near_dup.near_duplicates(docs).collect()}
    prints = {i * 3: brute_fingerprint(t) for i, t in enumerate(texts)}
    assert {k: int(v.fingerprint, 16) for k, v in got.items()} == prints
    assert {k: v.component_id for k, v in got.items()} == brute_components(prints)


def test_large_keys_are_cut_without_losing_links(spark):
    rng = np.random.default_rng(1)
    centre = rng.integers(-(2**62), 2**62)
    close = {int(centre ^ (1 << int(a)) ^ (1 << int(b))) for a, b in rng.integers(0, 60, (400, 2))}
    far = {int(x) for x in rng.integers(-(2**62), 2**62, 300)}
    frame = spark.createDataFrame([(x,) for x in close | far], "fp long")
    whole = components.component_labels(near_dup.fingerprint_links(frame))
    cut = components.component_labels(near_dup.fingerprint_links(frame, part=20, sample=1))
    assert {tuple(r) for r in whole.collect()} == {tuple(r) for r in cut.collect()}
    assert whole.where(F.col("label") == min(close)).count() >= len(close)


def test_odd_rows_of_near_duplicates(make_docs, odd_rows):
    got = near_dup.near_duplicates(make_docs(odd_rows)).collect()
    assert sorted((r.doc_id or 0, r.component_id or 0) for r in got) == sorted([(1, 1), (2, 1), (3, 3), (4, 4), (5, 4), (0, 0), (7, 7), (7, 7)])
    kept = near_dup.keep_one(make_docs(odd_rows))
    assert kept.columns == make_docs(odd_rows).columns
    assert sorted(r.doc_id or 0 for r in kept.collect()) == [0, 1, 3, 4, 7]
    assert near_dup.near_duplicates(make_docs([])).count() == 0


def test_keep_one_drops_only_rows_linked_to_kept_ones(make_docs):
    rng = random.Random(9)
    words = [f"w{i}" for i in range(500)]
    texts = [" ".join(rng.choices(words, k=900)) for _ in range(12)]
    near = texts[0] + " changed"
    rows = [(1, texts[0], "en", "a"), (1, texts[1], "en", "a"), (None, texts[2], None, "b"), (None, texts[2], None, "b"), (None, texts[0], None, "b"), (5, near, "en", "a"), (6, texts[3], "en", "a"), (6, texts[3], "fr", "a"), (None, texts[4], None, None)]
    rows += [(7, texts[5], "en", "hot")] * 300 + [(None, texts[6], None, "hot")] * 300
    kept = [(r.doc_id, r.text) for r in near_dup.keep_one(make_docs(rows).repartition(5)).collect()]
    prints = {t: brute_fingerprint(t) for t in {t for _, t, *_ in rows}}
    linked = lambda a, b: bin(prints[a] ^ prints[b]).count("1") <= 4
    assert linked(texts[0], near)
    assert sorted((i or 0, t) for i, t in kept) == sorted([(1, texts[0]), (1, texts[1]), (0, texts[2]), (6, texts[3]), (0, texts[4]), (7, texts[5]), (0, texts[6])])
    assert near_dup.keep_one(make_docs([])).count() == 0


def test_more_large_keys_than_are_broadcast(spark):
    rng = np.random.default_rng(1)
    centre = int(rng.integers(-(2**62), 2**62))
    close = {centre ^ (1 << int(a)) ^ (1 << int(b)) for a, b in rng.integers(0, 60, (300, 2))}
    frame = spark.createDataFrame([(x,) for x in close], "fp long")
    few = near_dup.fingerprint_links(frame, part=20, sample=1, broadcast_keys=3)
    assert {r.label for r in components.component_labels(few).collect()} == {min(close)}


def test_components_of_chains_and_stars(spark):
    chain = [(i, i + 1) for i in range(60)] + [(1000, i) for i in range(1001, 1200)] + [(5, 5)]
    rng = random.Random(3)
    rng.shuffle(chain)
    got = {r.node: r.label for r in components.component_labels(spark.createDataFrame(chain, "u long, v long")).collect()}
    assert got == {**{i: 0 for i in range(61)}, **{i: 1000 for i in range(1000, 1200)}}


def brute_nearest(rows, every, k):
    unit = {i: np.array(v, float) / np.linalg.norm(np.array(v, float)) for i, v in rows}
    out = {}
    for q in unit:
        if q % every == 0:
            scores = sorted((-float(unit[q] @ unit[i]), i) for i in unit if i != q)
            out[q] = [i for _, i in scores[:k]]
    return out


@pytest.mark.parametrize("clustered", [False, True])
def test_recall_against_brute_force(spark, clustered):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 32)) * (3 if clustered else 0)
    rows = [(i, (centres[i % 12] + rng.normal(size=32)).tolist()) for i in range(3000)]
    got: dict = {}
    for r in vector_search.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 50).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    true = brute_nearest([(i, np.array(v, np.float32)) for i, v in rows], 50, 5)
    assert got.keys() == true.keys() and all(sorted(v) == [1, 2, 3, 4, 5] for v in got.values())
    assert np.mean([len({x[0] for x in got[q].values()} & set(true[q])) / 5 for q in true]) >= 0.9


@pytest.mark.parametrize("kind", ["queries apart from the rest", "a prime length"])
def test_recall_on_other_rows(spark, kind):
    """Few cells suffice for the many near copies, not for the queries; and codes of one part rank hardly."""
    rng = np.random.default_rng(4)
    if kind == "a prime length":
        x = rng.normal(size=(8000, 61))
    else:
        x = (rng.normal(size=(20, 32)) * 3)[rng.integers(20, size=8000)] + 0.1 * rng.normal(size=(8000, 32))
        x[::50] = rng.normal(size=(160, 32)) * 3
    rows = list(enumerate(x.tolist()))
    got: dict = {}
    for r in vector_search.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 50).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    true = brute_nearest(rows, 50, 5)
    assert np.mean([len(got[q] & set(true[q])) / 5 for q in true]) >= 0.9


def test_odd_vectors(spark):
    rows = [(0, [1.0, 0.0]), (1, [2.0, 0.0]), (2, [3.0, 0.0]), (3, [0.0, 1.0]), (4, None), (5, [0.0, 0.0]), (6, [float("nan"), 1.0]), (7, [float("inf"), 1.0]), (8, [None, 1.0]), (None, [1.0, 1.0]), (1, [2.0, 0.0]), (9, [1.0, 2.0, 3.0])]
    frame = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, cell string")
    got = sorted(map(tuple, vector_search.nearest(frame, 50).collect()))
    assert [(q, r, v) for q, r, v, _ in got] == [(0, 1, 1), (0, 2, 2), (0, 3, 3)] and got[0][3] == 1.0
    assert vector_search.nearest(frame.where("false"), 50).count() == 0


def test_each_length_is_searched_and_an_id_counts_by_its_nearest_row(spark):
    rows = [(i, [1.0, float(i)]) for i in range(0, 60)] + [(i, [1.0, 0.0, float(i)]) for i in range(100, 104)] + [(1, [5.0, 0.1])] + [(50, [9.0, 9.0])] * 3
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got: dict = {}
    for r in vector_search.nearest(frame, 50).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append(r.vec_id)
    assert got[0][0] == 1 and got[100] == [101, 102, 103] and sorted(got) == [0, 50, 100] and all(len(set(v)) == len(v) for v in got.values())


def test_a_crowd_of_one_code_is_reranked_whole(spark):
    rng = np.random.default_rng(5)
    base = rng.normal(size=8)
    rows = [(i, (base + 1e-6 * rng.normal(size=8)).tolist()) for i in range(2000)] + [(i, rng.normal(size=8).tolist()) for i in range(2000, 2300)]
    got: dict = {}
    for r in vector_search.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<double>"), 100).collect():
        got.setdefault(r.query_id, set()).add(r.vec_id)
    true = brute_nearest(rows, 100, 5)
    assert np.mean([len(got[q] & set(true[q])) / 5 for q in true if q < 2000]) >= 0.9


@pytest.mark.parametrize("size", ["0.01", "0.1"])
def test_registered_query_against_brute_force(spark, size):
    """Recall on the whole registered table, and every score and order as brute force gives them."""
    from veilframe.llm import queries

    folder = f"/root/testdata/sf{size}"
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{folder}/embeddings.parquet").collect() if r.embedding is not None and any(r.embedding)]
    true = brute_nearest(rows, 50, 5)
    unit = {i: np.array(v, float) / np.linalg.norm(np.array(v, float)) for i, v in rows}
    got: dict = {}
    for r in queries.op4_ivf_pq(spark, folder).orderBy("query_id", "rank").collect():
        assert r.score == pytest.approx(float(unit[r.query_id] @ unit[r.vec_id]), abs=1e-12)
        got.setdefault(r.query_id, []).append((-r.score, r.vec_id))
    assert got.keys() == true.keys() and all(v == sorted(v) and len(v) == 5 for v in got.values())
    assert np.mean([len({i for _, i in got[q]} & set(true[q])) / 5 for q in true]) >= 0.9


def test_crowd_of_equal_vectors_ties_to_small_ids(spark):
    rng = np.random.default_rng(8)
    rows = [(i, [1.0, 2.0, 3.0, 4.0]) for i in range(1500)] + [(i, rng.normal(size=4).tolist()) for i in range(1500, 1800)]
    got = vector_search.nearest(spark.createDataFrame(rows, "vec_id long, embedding array<float>"), 500).where("query_id = 500").orderBy("rank").collect()
    assert [r.vec_id for r in got] == [0, 1, 2, 3, 4]
