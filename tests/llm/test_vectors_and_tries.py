"""Hard negatives, exact top-k and the prefix trie against brute force, on fixtures with nulls, ties, repeats and copies."""

import hashlib
import math
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import assert_same

SF = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<float>, label int"
NAN, INF = float("nan"), float("inf")


def vector_rows(n=240, width=6):
    rng = np.random.default_rng(5)
    # clusters, so that scores tie and trees can leave siblings out; one third are copies of one vector
    centres = rng.normal(size=(8, width))
    rows = []
    for i in range(n):
        v = centres[0] if i % 3 == 0 else centres[i % 8] + rng.normal(size=width) * 0.05
        rows.append((i, [float(np.float32(x)) for x in np.round(v, 2)], int(rng.integers(0, 3))))
    bad = [(1000, None, 1), (1020, [1.0, None, 0.0, 0.0, 0.0, 0.0], 1), (1040, [NAN] * 6, 2), (1060, [INF] + [0.0] * 5, 2), (1080, [-INF] + [0.0] * 5, 0)]
    odd = [(None, [1.0] * 6, 1), (1100, [], 1), (1120, [2.0, 3.0], 2), (1140, [1.0] * 6, None), (40, [0.5] * 6, 2), (40, [0.5] * 6, 2), (1160, [3e38] * 6, 0), (-20, [0.25] * 6, 1), (-100, [-0.5] * 6, 0)]
    return rows + bad + odd


def fixed(v, scale):
    return [math.floor(max(min(x * scale, 1 << 24), -(1 << 24))) for x in v]


def taking(rows, scale, label):
    out = []
    for i, v, c in rows:
        if i is not None and v is not None and not (label and c is None) and all(x is not None and math.isfinite(x) for x in v):
            out.append((i, fixed([float(np.float32(x)) for x in v], scale), str(c)))
    return out


def dot(a, b):
    return sum(x * y for x, y in zip(a, b))


def crowd(df):
    for c in ("id", "v", "own", "nth", "score", "rank", "key", "block", "region", "anchor", "depth", "side", "info", "lo", "hi"):
        if c not in df.columns:
            df = df.withColumn(c, F.lit("clash"))
    return df


def topk_by_hand(rows, k):
    use = taking(rows, 64, False)
    asked = {}
    for i, v, _ in use:
        if i % 20 == 0:
            asked[i] = min(asked.get(i, v), v)
    out = []
    for q, v in asked.items():
        found = sorted((-dot(v, x), i) for i, x, _ in use if i != q)[:k]
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(found)]
    return sorted(out)


@pytest.mark.parametrize("held,k", [(1 << 25, 20), (1500, 7), (1500, 1000)])
def test_exact_topk(spark, monkeypatch, held, k):
    from mediasift.llm import exact_topk

    monkeypatch.setattr(exact_topk, "HELD_BYTES", held)
    monkeypatch.setattr(exact_topk, "QUERY_BLOCK", 5)
    df = crowd(spark.createDataFrame(vector_rows(), VECTORS).repartition(3))
    got = exact_topk.search(df, F.col("vec_id") % 20 == 0, k)
    assert sorted(map(tuple, got.collect())) == topk_by_hand(vector_rows(), k)


def test_exact_topk_of_nothing(spark):
    from mediasift.llm.exact_topk import search

    df = spark.createDataFrame(vector_rows(), VECTORS)
    assert search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0
    assert search(df, F.lit(False)).count() == 0
    assert search(df.where("vec_id = 20"), F.lit(True)).count() == 0
    with pytest.raises(ValueError):
        search(df, F.lit(True), 0)


def negatives_by_hand(rows):
    use = taking(rows, 256, True)
    anchors = {}
    for i, v, c in use:
        if i % 20 == 0:
            anchors[i] = min(anchors.get(i, (c, v)), (c, v))
    out = []
    for a, (c, v) in anchors.items():
        scored = sorted((-dot(v, x), i, d) for i, x, d in use if i != a)
        for p, i, _ in [x for x in scored if x[2] == c][:5]:
            window = [x for x in scored if x[2] != c and 80 * -p <= 100 * -x[0] <= 100 * -p][:5]
            out += [(a, i, r + 1, x[1], -p, -x[0]) for r, x in enumerate(window)]
    return sorted(out)


@pytest.mark.parametrize("small", [False, True])
def test_hard_negatives(spark, monkeypatch, small):
    from mediasift.llm import hyperplane_tree as ht

    if small:
        for name, value in {"SAMPLE": 12, "ROOT_POINTS": 4, "POINTS": 3, "LEAF": 8, "HELD_BYTES": 1200, "QUERY_BLOCK": 5}.items():
            monkeypatch.setattr(ht, name, value)
    df = crowd(spark.createDataFrame(vector_rows(), VECTORS).repartition(3))
    got = sorted(map(tuple, ht.hard_negatives(df, F.col("vec_id") % 20 == 0).collect()))
    assert got == negatives_by_hand(vector_rows()) and len(got) > 50


def test_hard_negatives_of_nothing(spark):
    from mediasift.llm.hyperplane_tree import RESULT, hard_negatives

    df = spark.createDataFrame(vector_rows(), VECTORS)
    for part in (df.limit(0), df.where("embedding is null"), df.where("vec_id = 20"), df.where("label = 1")):
        got = hard_negatives(part, F.col("vec_id") % 20 == 0)
        assert got.count() == 0 and got.schema.simpleString() == RESULT.simpleString()


def test_tree_leaves_siblings_out():
    from mediasift.llm import hyperplane_tree as ht

    rng = np.random.default_rng(3)
    v = (rng.normal(size=(40, 8))[rng.integers(0, 40, 20_000)] * 256 + rng.normal(size=(20_000, 8)) * 4).astype(np.int32)
    most = int((v.astype(np.int64) ** 2).sum(axis=1).max())
    points = ht.spread_points(ht.lift(v[:500], most), 8, most)
    tree = ht.Tree(np.arange(20_000), ["a"] * 20_000, v, most, points)
    s = ht.Search(tree, v[:50], np.arange(50), ["a"] * 50, True, np.full(50, -(1 << 62)), np.full(50, 1 << 62), 5)
    s.run(points)
    score = v[:50].astype(np.int64) @ v.astype(np.int64).T
    for i in range(50):
        order = sorted((-int(x), j) for j, x in enumerate(score[i]) if j != i)[:5]
        assert [(-int(x), int(j)) for x, j in zip(s.score[i], s.found[i])] == order
    assert s.compared < 50 * 20_000 / 2


def crc(c):
    return zlib.crc32(str(c).encode()) % 9


def mod(c, m):
    return c % m if c >= 0 else -(-c % m)


def trie_by_hand(rows, graft=True):
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            role, text = role or "", text or ""
            sha = hashlib.sha256(f"{len(role.encode())}:{role}{text}".encode()).hexdigest()
            own.setdefault(c, []).append((turn is not None, turn or 0, sha, role, text))
    own = {c: [x[3:] for x in sorted(v)] for c, v in own.items()}
    built = {c: own.get(c - mod(c, 5), [])[: crc(c)] + v[crc(c) :] if graft else v for c, v in own.items()}
    members, ends = {}, {}
    for c, v in built.items():
        for d in range(len(v) + 1):
            members.setdefault(tuple(v[:d]), []).append(c)
        ends.setdefault(tuple(v), []).append(c)
    kids = {k: 0 for k in members}
    for k in members:
        if k:
            kids[k[:-1]] += 1
    leaves, saved = {k: 0 for k in members}, {k: 0 for k in members}
    for k, m in members.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += kids[k] == 0
            saved[k[:d]] += (len(m) - 1) * len(k[-1][1].encode()) if k else 0
    return sorted((min(m), len(k), min(members[k[:-1]]) if k else None, len(m), kids[k], leaves[k], saved[k], hashlib.sha256(",".join(map(str, sorted(ends.get(k, [])))).encode()).hexdigest()) for k, m in members.items())


CONVERSATIONS = "conv_id long, turn long, role string, text string"


def conversation_rows():
    rng, rows = np.random.default_rng(8), []
    for c in range(60):
        for t in range(int(rng.integers(1, 6))):
            rows.append((c, t, ["user", "assistant"][t % 2], f"text {rng.integers(0, 2)} é"))
    rows += [(200 + c, t, "user", "same") for c in range(40) for t in range(3)]  # copies
    rows += [(300, t, "user", f"long {t}") for t in range(150)] + [(301, t, "user", f"long {t}") for t in range(149)]  # a hot conversation and one that follows it
    rows += [(302, None, "user", "x")] * 30 + [(302, 5, "user", "y"), (302, 5, "tool", "z"), (302, 5, None, None), (302, None, "", "")]  # repeats, ties, nulls
    rows += [(None, 1, "user", "lost"), (-7, 1, "user", "a"), (-5, 1, "user", "b"), (-5, 2, "user", "c"), (403, 1, "user", "no base"), (2**63 - 1, 1, "user", "edge"), (-(2**63), 1, "user", "edge")]
    return rows


@pytest.mark.parametrize("small,graft", [(False, True), (True, True), (True, False)])
def test_prefix_trie(spark, monkeypatch, small, graft):
    from mediasift.llm import prefix_trie as pt

    if small:
        for name, value in {"SPAN": 4, "BLOCK_ARCS": 40, "ONE_TASK": 5, "CHAIN_PART": 3, "PIECE_IDS": 2}.items():
            monkeypatch.setattr(pt, name, value)
    rows = conversation_rows()
    df = crowd(spark.createDataFrame(rows, CONVERSATIONS).repartition(5))
    got = [tuple(r) for r in (pt.prefix_trie(df, pt.grafted, 8) if graft else pt.prefix_trie(df)).collect()]
    assert sorted(r[:8] for r in got) == trie_by_hand(rows, graft)
    # the places of the arcs are those of one tour, and nest
    assert sorted([r[8] for r in got] + [r[9] for r in got]) == list(range(2 * len(got)))
    assert all(r[8] < r[9] and (r[9] - r[8] == 1) == (r[4] == 0) for r in got)


def test_prefix_trie_of_nothing(spark):
    from mediasift.llm import prefix_trie as pt

    df = spark.createDataFrame([(None, 1, "user", "a")], CONVERSATIONS)
    assert pt.prefix_trie(df, pt.grafted, 8).count() == 0
    one = spark.createDataFrame([(1, 1, None, None)], CONVERSATIONS)
    assert sorted(tuple(r)[:8] for r in pt.prefix_trie(one).collect()) == trie_by_hand([(1, 1, None, None)], False)


@pytest.mark.parametrize("name", ["op11_hard_negatives", "op12_exact_topk", "op13_prefix_trie"])
def test_matches_sql(spark, name):
    from mediasift.llm import queries

    assert_same(spark, queries.queries()[name], queries.oracle_sql()[name], SF)
