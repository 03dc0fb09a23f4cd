import numpy as np
import pytest

from riskweave.llm import neighbours
from riskweave.llm.graph import connected_components
from riskweave.llm.neighbours import near_vectors
from riskweave.llm.topk import exact_topk

SCHEMA = "vec_id long, embedding array<float>, label int, id long, part int"


def rows(seed=3, hot=700):
    r = np.random.default_rng(seed)
    unit = lambda v: (v / np.linalg.norm(v)).astype(np.float32)
    centre = unit(r.standard_normal(16))
    out = [unit(centre + 0.035 * r.standard_normal(16)) for _ in range(hot)] + [centre] * 5 + [unit(r.standard_normal(16)) for _ in range(200)]
    for _ in range(30):
        c = unit(r.standard_normal(16))
        out += [unit(c + 0.04 * r.standard_normal(16)) for _ in range(3)]
    odd = [None, [], [0.0] * 16, [None] * 16, [float("nan")] * 16, [float("inf")] * 16, [1.0, 0.0]]
    vectors = [v.tolist() for v in out] + odd
    return [(i, v, None if i % 97 == 5 else 0 if i < hot + 50 else i % 3, 1, 2) for i, v in enumerate(vectors)]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(rows(), SCHEMA)


def test_near_vectors_equal_brute_force(spark, table):
    data = rows()
    ok = [(i, np.array(v, dtype=np.float32).astype(float), lab) for i, v, lab, *_ in data if lab is not None and v and len(v) == 16 and all(x is not None and np.isfinite(x) for x in v) and any(v)]
    ids, x, label = np.array([o[0] for o in ok]), np.array([o[1] for o in ok]), np.array([o[2] for o in ok])
    x /= np.linalg.norm(x, axis=1)[:, None]
    linked = (x @ x.T >= 0.98) & (label[:, None] == label[None, :]) & ~np.eye(len(ids), dtype=bool)
    component, changed = ids.copy(), True
    while changed:
        after = np.array([min(component[i], component[linked[i]].min(initial=component[i])) for i in range(len(ids))])
        changed, component = (after != component).any(), after
    want = {i: (0, i) for i, *_ in data} | {int(i): (int(n), int(c)) for i, n, c in zip(ids, linked.sum(axis=1), component, strict=True)}
    got = {r.vec_id: (r.n_links, r.component_id) for r in near_vectors(table).collect()}
    assert got == want
    assert near_vectors(table.limit(0)).count() == 0


def test_large_leaves_are_compared_whole(spark, monkeypatch):
    monkeypatch.setattr(neighbours, "PART", 16)
    r = np.random.default_rng(8)
    x = np.repeat(r.standard_normal(16) + 0.25 * r.standard_normal((150, 16)), 2, axis=0) + 0.01 * r.standard_normal((300, 16))  # a dense region of pairs
    x /= np.linalg.norm(x, axis=1)[:, None]
    reps = spark.createDataFrame([(i, 1, 1, v.tobytes()) for i, v in enumerate(x)], "id long, place long, copies long, raw binary")
    leaves = neighbours._leaves(reps, 1, 1, 3)
    edges = neighbours._compare(leaves, reps, 8, 0.9, 0.98).where("cosine >= 0.98").select("a", "b")
    component = {r.id: r.component for r in connected_components(edges).collect()}
    leaf = {r.id: r.leaf for r in leaves.collect()}
    pairs = [(a, b) for a in range(300) for b in range(a) if x[a] @ x[b] >= 0.98 and leaf[a] == leaf[b]]
    assert len(pairs) > 100 and all(component.get(a, a) == component.get(b, -b - 1) for a, b in pairs)


def test_audit_counts_vectors_alike(spark):
    audit = spark.createDataFrame([(1, 5000, 4990)] * 20 + [(1, 1, 0)] * 10, "place long, links long, found long").toPandas()
    assert neighbours._recall(audit, 8) == 0 and neighbours._recall(audit[:20], 8) > 0.99 and neighbours._recall(audit[:0], 8) is None


@pytest.mark.parametrize("pairs", [6, 0])
def test_recall_is_measured_however_few_links_there_are(spark, pairs):
    r = np.random.default_rng(6)
    x = r.standard_normal((4_000, 32))
    x[:pairs] = x[2_000 : 2_000 + pairs] + 0.02 * r.standard_normal((pairs, 32))
    rows_ = [(i, v.tolist(), 1) for i, v in enumerate(x)]
    got = near_vectors(spark.createDataFrame(rows_, "vec_id long, embedding array<double>, label int"), audit_rows=20).collect()
    assert sum(v.n_links for v in got) == 2 * pairs and got[0].audited_recall == 1 and (got[0].audited_links >= 2 * pairs if pairs else got[0].audited_links == 0)
    assert sorted(v.vec_id for v in got if not v.kept) == list(range(2_000, 2_000 + pairs))


def test_labels_that_miss_links_are_compared_whole(spark, table, monkeypatch):
    shown = lambda df: {tuple(r)[:4] for r in df.collect()}
    want = shown(near_vectors(table))
    monkeypatch.setattr(neighbours, "_leaves", lambda reps, *_: neighbours._blocks(reps.where("id % 50 = 0").select("id", reps.place.alias("leaf"))))
    got = near_vectors(table)
    assert shown(got) == want and got.first().audited_recall == 1 and got.first().audited_links > 0


def test_repeated_ids_of_vectors_dont_link_with_themselves(spark):
    a, b = [1.0, 0.0, 0.0], [0.0, 1.0, 0.0]
    data = [(7, a, 1), (7, a, 1), (8, a, 1), (9, b, 1), (9, b, 1), (10, b, 2), (None, b, 1), (11, None, 1), (11, None, 1)]
    got = near_vectors(spark.createDataFrame(data, "vec_id long, embedding array<float>, label int")).collect()
    assert sorted(((r.vec_id, r.n_links, r.component_id, r.kept) for r in got), key=str) == sorted([(7, 1, 7, True), (7, 1, 7, True), (8, 1, 7, False), (9, 0, 9, True), (9, 0, 9, True), (10, 0, 10, True), (None, 0, None, False), (11, 0, 11, True), (11, 0, 11, True)], key=str)


def test_rounds_find_what_trees_have_missed(spark):
    r = np.random.default_rng(4)
    x = r.standard_normal((40, 1, 16)) + 0.02 * r.standard_normal((40, 5, 16))  # 40 groups of five
    x = (x / np.linalg.norm(x, axis=2)[:, :, None]).reshape(200, 16)
    reps = spark.createDataFrame([(i, 1, 1, v.tobytes()) for i, v in enumerate(x)], "id long, place long, copies long, raw binary")
    chain = [(5 * g + i, 5 * g + i + 1, float(x[5 * g + i] @ x[5 * g + i + 1])) for g in range(40) for i in range(4)]
    edges, settled = neighbours._descend(spark.createDataFrame(chain, "a long, b long, cosine double"), None, reps, 8, 12, 0.9, 0.98)
    want = {(a, b) for a in range(200) for b in range(200) if a != b and x[a] @ x[b] >= 0.9}
    assert {tuple(r) for r in settled.collect()} == want and len(want) > 2 * len(chain)
    after, _ = neighbours._descend(edges, settled, reps, 8, 1, 0.9, 0.98)
    assert after.count() == edges.count()  # settled lists give no further round


@pytest.mark.parametrize(("block_rows", "block_queries"), [(32_768, 192), (100, 7)])
def test_topk_equals_brute_force(spark, table, block_rows, block_queries):
    ok = [(i, np.floor(64 * np.array(v, dtype=np.float32).astype(float)).astype(int)) for i, v, *_ in rows() if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    ids, x = np.array([o[0] for o in ok]), np.zeros((len(ok), 16), dtype=int)
    for at, (_, v) in enumerate(ok):
        x[at, : len(v)] = v
    want = []
    for q in np.flatnonzero(ids % 20 == 0):
        score = x @ x[q]
        order = [i for i in np.lexsort((ids, -score)) if i != q][:20]
        want += [(int(ids[q]), n, int(ids[i]), int(score[i])) for n, i in enumerate(order, 1)]
    got = exact_topk(table, block_rows=block_rows, block_queries=block_queries)
    assert sorted(map(tuple, got.collect())) == sorted(want)
    assert exact_topk(table.limit(0)).count() == 0 and exact_topk(table.where("vec_id = 0")).count() == 0


def test_topk_of_large_components_and_repeated_rows(spark):
    r = np.random.default_rng(9)
    scale = [1.0, 1e3, 3e10, 1e-3, 2e12]
    data = [(i, (r.standard_normal(2) * scale[i % 5]).tolist()) for i in range(60)] + [(20, [1.0, 2.0]), (20, [1.0, 2.0]), (3, [5.0, 5.0]), (3, [5.0, 5.0]), (None, [1.0, 1.0]), (61, None)]
    data[20] = (20, [0.5, 1.5])
    rows_ = [(i, [int(np.floor(64 * c)) for c in v]) for i, v in data if i is not None and v is not None]
    want = []
    for q, asked in {i: min(v for j, v in data if j == i) for i, _ in rows_ if i % 20 == 0}.items():
        query = [int(np.floor(64 * c)) for c in asked]
        scored = sorted((-sum(a * b for a, b in zip(query, v, strict=True)), i) for i, v in rows_ if i != q)[:20]
        want += [(q, n, i, -s) for n, (s, i) in enumerate(scored, 1)]
    frame = lambda d: spark.createDataFrame(d, "vec_id long, embedding array<double>")
    for block_rows in (8192, 7):
        assert sorted(map(tuple, exact_topk(frame(data), block_rows=block_rows, block_queries=2).collect())) == sorted(want)
    huge = frame([(0, [1e300]), (1, [1e300])])
    with pytest.raises(Exception, match="beyond 64 bits"):
        exact_topk(huge).collect()
    few = frame([(0, [1e300]), (1, [-1e300]), *[(i, [float(i)]) for i in range(2, 30)]])
    with pytest.raises(Exception, match="beyond 64 bits"):
        exact_topk(few, modulus=20).collect()  # products of 2 to 29 with 1e300 are beyond it
    least = frame([(0, [1.0]), (1, [-1e300]), *[(i, [float(i)]) for i in range(2, 30)]])
    assert [tuple(x) for x in exact_topk(least, modulus=30).orderBy("rank").limit(2).collect()] == [(0, 1, 29, 64 * 64 * 29), (0, 2, 28, 64 * 64 * 28)]
