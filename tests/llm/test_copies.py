import random
from collections import defaultdict

import pytest

from loomspark.llm import graph, jaccard


def brute(rows, k, num, den):
    """Least reachable id of every id, all pairs of sets compared."""
    sets = [(i, s) for i, s in {(i, frozenset(jaccard.shingles(t, k).tolist())) for i, t in rows if i is not None}]
    up = {i: i for i, _ in sets}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    where = defaultdict(list)
    for n, (_, s) in enumerate(sets):
        for h in s:
            where[h].append(n)
    for n, (i, s) in enumerate(sets):
        common = defaultdict(int)
        for h in s:
            for o in where[h]:
                common[o] += o < n
        for o, c in common.items():
            if o < n and den * c >= num * (len(s) + len(sets[o][1]) - c):
                a, b = root(i), root(sets[o][0])
                up[max(a, b)] = min(a, b)
    return {i: root(i) for i in up}


@pytest.fixture(scope="module")
def texts():
    rng = random.Random(3)
    vocabulary = ["".join(rng.choice("abcdefgh") for _ in range(3)) for _ in range(400)]

    def near(words, edits):
        w = list(words)
        for _ in range(edits):
            w[rng.randrange(len(w))] = rng.choice(vocabulary)
        return " ".join(w)

    rows = []
    for _ in range(40):
        base = [rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 5, 8, 13, 30, 80, 200]))]
        rows += [(rng.randrange(10**6), near(base, rng.choice([0, 1, 1, 2, 4]) if len(base) > 3 else 0)) for _ in range(rng.choice([1, 2, 3, 10]))]
    base = [rng.choice(vocabulary) for _ in range(120)]
    rows += [(rng.randrange(10**6), near(base, rng.choice([1, 2, 3]))) for _ in range(120)]  # one large group, many beyond the limit of one another
    rows += [(rng.randrange(10**6), " ".join(base)) for _ in range(20)]
    return [*rows, (7, None), (8, ""), (9, "  \t"), (10, "A b c d"), (11, "a B  c\nd"), (12, "x"), (13, "X"), (12, "x"), (14, "É é"), (15, "é é"), (16, " ".join(f"w{i}" for i in range(30_000))), (None, "A b c d")]


@pytest.mark.parametrize(("k", "num", "den", "members"), [(3, 90, 100, 1000), (3, 90, 100, 10), (5, 80, 100, 1000)])
def test_classes_are_those_of_all_pairs(spark, texts, monkeypatch, k, num, den, members):
    monkeypatch.setattr(jaccard, "MEMBERS", members)  # 10: the large groups' way as well
    df = spark.createDataFrame([(*r, 1, "x") for r in texts], "doc_id long, text string, n int, component string")
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard.classes(df, k, num, den).collect()}
    want = brute(texts, k, num, den)
    assert got == {(i, len(jaccard.shingles(t, k)), want[i] if i is not None else None) for i, t in texts}


def test_large_groups_with_repeated_rows(spark, monkeypatch):
    rng = random.Random(7)
    base = [f"v{i}" for i in range(400)]
    rows, pairs = [], []
    for n in range(12):
        a = [f"{w}x{n}" for w in base]
        b = list(a)
        for i in rng.sample(range(400), 6):
            b[i] = "changed"
        rows += [(2 * n, " ".join(a)), (2 * n + 1, " ".join(b))]
        pairs.append((2 * n, 2 * n + 1))
    rows += [(1, " ".join(f"{w}y" for w in base))] * 3  # another text of that size under one doc_id
    assert all(brute(rows, 3, 90, 100)[b] == a for a, b in pairs)
    df = spark.createDataFrame([r for r in rows for _ in range(9)], "doc_id long, text string")
    monkeypatch.setattr(jaccard, "MEMBERS", 2)
    got = {r["doc_id"]: r["component_id"] for r in jaccard.classes(df, 3, 90, 100).collect()}
    assert got == brute(rows, 3, 90, 100)


def test_one_of_each_group_stays(spark, texts):
    df = spark.createDataFrame([(*r, "x") for r in texts], "doc_id long, text string, key string")
    kept = jaccard.keep_first(df)
    assert kept.columns == df.columns
    ids = [r["doc_id"] for r in kept.collect()]
    want = brute(texts, 5, 80, 100)
    assert sorted(i for i in ids if i is not None) == sorted(set(want.values())) and ids.count(None) == 1
    assert jaccard.classes(df.limit(0)).collect() == [] and jaccard.keep_first(df.limit(0)).collect() == []


def test_sketches_bound_differences_from_below():
    rng = random.Random(1)
    import numpy as np

    for _ in range(50):
        a = np.unique(jaccard.mix(np.array(rng.sample(range(10**6), rng.randint(1, 400)), np.uint64)))
        b = np.unique(np.r_[a[: rng.randrange(len(a) + 1)], jaccard.mix(np.array(rng.sample(range(10**6), 5), np.uint64))])
        assert jaccard.apart(jaccard.sketch(a), jaccard.sketch(b)) <= len(np.setxor1d(a, b))


def test_linked_sets_share_a_key():
    import numpy as np

    rng = random.Random(2)
    ranks = np.array([rng.randrange(256) for _ in range(1 << 12)], np.uint8)
    for num in (80, 90):
        for _ in range(150):
            a = np.unique(jaccard.mix(np.array(rng.sample(range(10**7), rng.randint(1, 300)), np.uint64)))
            drop = rng.randint(0, max(0, len(a) * (100 - num) // 150))
            b = np.unique(np.r_[a[drop:], jaccard.mix(np.array(rng.sample(range(10**7), drop // 2 + rng.randint(0, 1)), np.uint64))])
            if jaccard.linked(a, b, num, 100):
                assert np.array_equal(a, b) or all(set(jaccard.keys(a, num, 100, r).tolist()) & set(jaccard.keys(b, num, 100, r).tolist()) for r in (None, ranks))


def test_components(spark):
    rng = random.Random(5)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(i, i + 1) for i in range(1000, 1060)] + [(2000, 2000 + i) for i in range(1, 40)] + [(5, 5)]
    up = {x: x for e in edges for x in e}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)
    got = {r["node"]: r["component"] for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: root(x) for x in up if root(x) != x}
    assert graph.components(spark.createDataFrame([], "a long, b long")).collect() == []


def beyond_the_threshold(n, pairs, seed=9):
    """Texts of one passage, each with edits of its own that take it beyond the threshold of all others, and near copies of some."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for i in range(n):
        own = list(base)
        for j in range(5):
            own[60 * j + rng.randrange(50)] = f"e{i}x{j}"
        rows.append(own)
    for i in range(pairs):
        own = list(rows[rng.randrange(n)])
        own[rng.randrange(300)] = f"c{i}"
        rows.append(own)
    return [(f"d{i:05d}", " ".join(w)) for i, w in enumerate(rows)]


def brute_by_matrix(rows, k, num, den):
    """Least reachable id, from the intersections of all sets as one product of matrices."""
    import numpy as np

    sets = [jaccard.shingles(t, k) for _, t in rows]
    every, counts = np.unique(np.concatenate(sets), return_counts=True)
    shared = every[counts > 1]
    x = np.zeros((len(sets), len(shared)), np.float32)
    for i, s in enumerate(sets):
        at = np.searchsorted(shared, s)
        at[at == len(shared)] = 0
        x[i, at[shared[at] == s]] = 1
    common = x @ x.T
    n = np.array([len(s) for s in sets])
    up = {i: i for i, _ in rows}

    def root(a):
        while up[a] != a:
            a = up[a]
        return a

    for i, j in np.argwhere(np.triu(den * common >= num * (n[:, None] + n[None] - common), 1)):
        a, b = root(rows[i][0]), root(rows[j][0])
        up[max(a, b)] = min(a, b)
    return {i: root(i) for i in up}


def test_text_ids_and_a_large_group_beyond_the_threshold(spark):
    rows = beyond_the_threshold(700, 120)
    want = brute_by_matrix(rows, 5, 80, 100)
    assert 600 < len(set(want.values())) < 710
    df = spark.createDataFrame(rows, "doc_id string, text string").repartition(4)
    assert {r["doc_id"]: r["component_id"] for r in jaccard.classes(df, 5, 80, 100).collect()} == want
    kept = jaccard.keep_first(df)
    assert {r["doc_id"] for r in kept.collect()} == set(want.values())


def test_which_row_of_an_id_stays(spark):
    rows = [("a", "the first text of this id is the least one", 2), ("a", "zebras come last in the order of texts here", 1), ("b", "the first text of this id is the least one", 3), ("c", None, 1), ("c", "", 1), ("c", None, 0), ("d", "x y", 5), ("d", "x y", 4)]
    df = spark.createDataFrame(rows, "doc_id string, text string, n int")
    assert sorted(map(tuple, jaccard.keep_first(df).collect())) == [("a", "the first text of this id is the least one", 2), ("c", "", 1), ("d", "x y", 4)]
