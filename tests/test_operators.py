from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from vecinity.functions import vectors
from vecinity.operators import aggregates, components, evaluate, graph, learn, probe, search
from vecinity.operators.components import connected_components
from vecinity.operators.families import E2LSH, AllPairsSimHash, PCAHash, RotatedPCAHash, SimHash, SparseSimHash, pack

RNG = np.random.default_rng(3)
X = RNG.standard_normal((120, 8))


@pytest.fixture(scope="module")
def items(spark):
    return spark.createDataFrame([(i, [float(v) for v in x]) for i, x in enumerate(X)], "id long, vec array<float>").cache()


def test_dense_functions(spark):
    df = spark.createDataFrame([([3.0, 4.0], [4.0, 3.0]), ([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    got = df.select(vectors.dot(F.col("a"), F.col("b")), vectors.norm(F.col("a")), vectors.e2(F.col("a"), F.col("b")), vectors.angular(F.col("a"), F.col("b")), vectors.normalize(F.col("a"))).collect()
    assert got[0][0] == 24 and got[0][1] == 5 and got[0][2] == pytest.approx(2**0.5) and got[0][3] == pytest.approx(np.arccos(24 / 25)) and got[0][4] == [0.6, 0.8]
    assert got[1][3] == pytest.approx(np.pi / 2) and got[1][4] is None


def test_sparse_functions(spark):
    kind = "array<struct<idx:int,val:double>>"
    df = spark.createDataFrame([([(0, 1.0), (5, 2.0)], [(5, 3.0), (9, 1.0)], [1.0, 2.0, 3.0]), ([], [(1, 1.0)], [1.0])], f"a {kind}, b {kind}, d array<double>")
    got = df.select(vectors.dot_sparse(F.col("a"), F.col("b")), vectors.dot_sparse_dense(F.col("a"), F.col("d")), vectors.angular_sparse(F.col("a"), F.col("b")), vectors.normalize_sparse(F.col("a"))).collect()
    assert got[0][0] == 6 and got[0][1] == 1 and got[0][2] == pytest.approx(np.arccos(6 / (5**0.5 * 10**0.5)))
    assert got[1][0] == 0 and got[1][2] == pytest.approx(np.pi / 2) and got[1][3] is None
    table = df.select("a", "b").toArrow().combine_chunks()
    assert vectors.sparse_angles(table.column("a").combine_chunks(), table.column("b").combine_chunks())[0] == pytest.approx(got[0][2])


def test_pack_bits(spark):
    assert spark.range(1).select(vectors.pack_bits(F.array(F.lit(1), F.lit(0), F.lit(1)))).first()[0] == 5
    assert pack(np.array([[1, 0, 1], [0, 0, 0]])).tolist() == [5, 0]


def exact(q, metric="e2"):
    return vectors.rowwise(metric, np.repeat(X[q : q + 1], len(X), 0), X)


def test_linear_scan_is_exact(items):
    got = search.linear_scan(items.where("id in (0, 7)"), items, 5).collect()
    for q in (0, 7):
        order = [i for i in np.lexsort((np.arange(len(X)), exact(q))) if i != q][:5]
        assert [r["item_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == order


@pytest.mark.parametrize("metric", ["e2", "sq_e2", "angular"])
def test_copies_at_the_boundary_go_by_id(spark, metric):
    """300 copies of one vector, the smallest ids last, nearer to the queries than all others but two."""
    one = RNG.standard_normal(8)
    rows = [(5000 + i, one) for i in range(299, -1, -1)] + [(i, one * 3 + x) for i, x in enumerate(RNG.standard_normal((500, 8)) * 9)]
    rows += [(9000, one * 1.001 + 0.001 * RNG.standard_normal(8)), (9001, one)]
    df = spark.createDataFrame([(i, [float(v) for v in x]) for i, x in rows], "id long, vec array<double>").coalesce(1)
    ids, x = np.array([i for i, _ in rows]), np.array([v for _, v in rows])
    asked = (9000, 9001, 5007, 5299, 3)
    got = search.linear_scan(df.where(F.col("id").isin(*asked)), df, 20, metric).collect()
    for q in asked:
        d = vectors.rowwise(metric, np.repeat(x[ids == q], len(x), 0), x)
        want = [i for i in ids[np.lexsort((ids, d))] if i != q][:20]
        assert [r["item_id"] for r in sorted((r for r in got if r["query_id"] == q), key=lambda r: r["rank"])] == want


def test_blocks_of_queries_give_the_same(items, monkeypatch):
    whole = {tuple(r) for r in search.linear_scan(items, items, 3).collect()}
    monkeypatch.setattr(search, "BLOCK_VALUES", 100)
    assert {tuple(r) for r in search.linear_scan(items, items, 3).collect()} == whole


@pytest.mark.parametrize("family", [E2LSH(4, 2, 8, 2.0, 1), SimHash(4, 4, 8, 1), AllPairsSimHash(6, 4, 8, 1)])
def test_lsh_is_part_of_the_scan(items, family):
    got = search.lsh_join(items.where("id < 5"), items, family).collect()
    assert {(q, q) for q in range(5)} <= {(r["query_id"], r["item_id"]) for r in got}
    codes = family.codes(X.astype(np.float32).astype(float))
    want = {(q, i) for q in range(5) for i in range(len(X)) if (codes[q] == codes[i]).all(axis=1).any()}
    assert {(r["query_id"], r["item_id"]) for r in got} == want


def test_recall_grows_with_tables_and_falls_with_rows(items):
    pairs = lambda t, r: search.candidates(SimHash(t, r, 8, 2).signatures(items.where("id < 10")), search.build_index(items, SimHash(t, r, 8, 2))).count()
    assert pairs(1, 6) <= pairs(1, 3)
    small = SimHash(2, 4, 8, 2)
    large = SimHash(2, 4, 8, 2)
    large.tables, large.directions, large.offsets = 3, np.vstack([small.directions, RNG.standard_normal((4, 8))]), np.zeros(12)
    one, two = (search.candidates(f.signatures(items.where("id < 10")), search.build_index(items, f)).count() for f in (small, large))
    assert one <= two


def test_all_pairs_has_its_tables(items):
    with pytest.raises(ValueError):
        AllPairsSimHash(5, 4, 8)
    got = AllPairsSimHash(10, 2, 8).signatures(items.where("id = 0")).collect()
    assert sorted(r["table"] for r in got) == list(range(10))


def test_sparse_simhash_has_bits_and_tables(spark):
    df = spark.createDataFrame([(1, [(0, 0.1), (1, 1.1), (2, -0.1), (3, -1.1)]), (2, [])], "id long, vec array<struct<idx:int,val:double>>")
    plain, pairs = SparseSimHash(10, 2).signatures(df).collect(), SparseSimHash(10, 2, all_pairs=True).signatures(df).collect()
    assert len(plain) == 10 and len(pairs) == 10 and all(0 <= r["sig"][0] < 4 for r in plain + pairs)
    sql = spark.range(5).select(*[F.expr(SparseSimHash.coefficient("id", str(f))) for f in range(3)]).collect()
    assert [[r[f] for f in range(3)] for r in sql] == np.stack([SparseSimHash.coefficients(np.arange(5), f) for f in range(3)], 1).tolist()


@given(st.lists(st.floats(0, 10), min_size=1, max_size=10), st.integers(1, 40))
@settings(max_examples=50, deadline=None)
def test_probe_order(cost, probes):
    got = probe.cheapest_masks(np.array(cost), probes)
    assert got[0] == (0.0, 0) and len({m for _, m in got}) == len(got) == min(probes, 1 << len(cost))
    assert all(a[0] <= b[0] + 1e-9 for a, b in zip(got, got[1:]))


def test_probe_order_of_long_codes():
    cost = RNG.uniform(0, 1, 16)
    got = probe.cheapest_masks(cost, 30)
    sums = np.sort(((np.arange(1 << 16)[:, None] >> np.arange(15, -1, -1)) & 1) @ cost)[:30]
    assert np.allclose([g[0] for g in got], sums) and len({m for _, m in got}) == 30


def test_qd_search_with_all_probes_is_exact(items):
    family = learn.fit_pca(items, 4)
    got = probe.qd_search(items.where("id = 3"), items, family, probes=16, k=4)
    order = np.lexsort((np.arange(len(X)), exact(3)))[:4].tolist()
    assert [r["item_id"] for r in got.orderBy("rank").collect()] == order


def test_fit_pca_equals_numpy(items):
    x = X.astype(np.float32).astype(float)
    values, directions = np.linalg.eigh(np.cov(x.T, bias=True))
    family = learn.fit_pca(items, 3)
    for k in range(3):
        assert abs(abs(family.components[0, k] @ directions[:, -1 - k]) - 1) < 1e-6
    assert np.allclose(family.mean, x.mean(0))


def test_hamming(items):
    family = RotatedPCAHash(np.eye(8)[:6], np.eye(6))
    got = probe.hamming_search(items.where("id = 1"), items, family, 7).orderBy("rank").collect()
    codes = family.codes(X.astype(np.float32).astype(float))[:, 0, 0]
    d = np.array([int(codes[1] ^ c).bit_count() for c in codes])
    assert [r["item_id"] for r in got] == np.lexsort((np.arange(len(X)), d))[:7].tolist()


def test_expansion_reaches_what_plain_rounds_reach(items):
    family, radius = AllPairsSimHash(6, 2, 8, 1), 0.9
    got = {(r["query_id"], r["item_id"]) for r in probe.expand_search(items.where("id < 3"), items, family, radius, 4).collect()}
    codes = family.codes(X.astype(np.float32).astype(float))[:, :, 0]
    want = set()
    for q in range(3):
        front, seen = {q}, set()
        for _ in range(3):
            near = {i for f in front for i in range(len(X)) if (codes[f] == codes[i]).any()} - seen
            front = {i for i in near if exact(q, "angular")[i] <= radius}
            seen |= front
        want |= {(q, i) for i in seen}
    assert got == want


@given(st.lists(st.tuples(st.integers(0, 30), st.integers(0, 30)), max_size=40))
@settings(max_examples=5, deadline=None)
def test_components(spark, edges):
    got = {r["id"]: r["label"] for r in connected_components(spark.createDataFrame(edges, "src long, dst long")).collect()}
    label = {v: v for e in edges for v in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    assert got == {v: c for v, c in label.items() if any(v in e and e[0] != e[1] for e in edges)}


@given(st.lists(st.tuples(st.integers(-20, 60), st.integers(-20, 60)), max_size=60))
@settings(max_examples=300, deadline=None)
def test_edges_settled_in_one_task(edges):
    label = {v: v for e in edges for v in e}
    for _ in label:
        for a, b in edges:
            label[a] = label[b] = min(label[a], label[b])
    u, v = np.array(edges, np.int64).reshape(-1, 2).T
    ids, got = components.settled(u, v)
    assert dict(zip(ids.tolist(), got.tolist())) == label


def test_small_edge_tables_take_few_jobs(spark, monkeypatch):
    """A path of 300: in one task, or by rounds, the same components; only the rounds write a table each."""
    written, save = [], components.saved
    monkeypatch.setattr(components, "saved", lambda df, name: written.append(name) or save(df, name))
    path = spark.range(300).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    want = {(v, 0) for v in range(301)}
    assert {tuple(r) for r in connected_components(path).collect()} == want and len(written) == 2
    assert {tuple(r) for r in connected_components(path, small=299).collect()} == want and len(written) > 5
    assert connected_components(path.where("src < 0")).columns == ["id", "label"]


def test_long_path_is_one_component(spark):
    path = spark.range(10_000).select(F.col("id").alias("src"), (F.col("id") + 1).alias("dst"))
    assert {tuple(r) for r in connected_components(path).select("label").distinct().collect()} == {(0,)}


@pytest.mark.parametrize("meet", [256, 7])
def test_descent_joins_the_whole_reverse_list_of_a_hub(spark, monkeypatch, meet):
    """Vertices 1 to 60 know only the hub 0; 59 and 60, its furthest reverse neighbours, are copies of each other."""
    monkeypatch.setattr(graph, "MEET", meet, raising=False)
    x = [(0, [0.0, 0.0])] + [(i, [float(i), float(i % 7)]) for i in range(1, 59)] + [(59, [100.0, 0.0]), (60, [100.0, 0.0])]
    vecs = spark.createDataFrame(x, "id long, vec array<double>")
    edges = spark.createDataFrame([(i, 0, v[0] ** 2 + v[1] ** 2) for i, v in x[1:]], "src long, dst long, dist double")
    got = {(r["src"], r["dst"]) for r in graph.descent_round(edges, vecs, 3).collect()}
    assert {(59, 60), (60, 59)} <= got
    at = np.array([v for _, v in x])
    d = ((at[1:, None] - at[None]) ** 2).sum(2)
    want = {(i, int(j)) for i in range(1, 61) for j in [j for j in np.lexsort((np.arange(61), d[i - 1])) if j != i][:3]}
    assert {(a, b) for a, b in got if a} == want


def test_descent_improves(items):
    truth = graph.exact_graph(items, 8)
    start = graph.random_graph(items, 8, "sq_e2")
    mean = lambda g: evaluate.graph_recall(g, truth).agg(F.avg("recall")).first()[0]
    built = graph.knn_graph(items, 8, 5)
    assert mean(start) < mean(built) and mean(built) > 0.9
    assert built.where("src = dst").count() == 0


def test_bfs_votes(spark):
    v = spark.range(7).select("id")
    g = spark.createDataFrame([(0, 2), (1, 2), (1, 3), (2, 4), (3, 4)], "src long, dst long")
    got = {r["id"]: r["label"] for r in graph.bfs_cluster(v, g, [0, 1]).collect()}
    assert got == {0: 0, 1: 1, 2: 0, 3: 1, 4: 0, 5: 2, 6: 2}


def plain_ring(x, node, bits, rounds, update):
    """Consensus learning written out node by node."""
    names, d = sorted(set(node)), x.shape[1]
    n = len(names)
    c = [np.eye(d, bits) for _ in names]
    near = [(np.eye(d, bits), np.eye(d, bits)) for _ in names]
    dual = [0.6 * np.eye(d, bits) for _ in names]
    own = [x[node == k].T for k in names]
    b = [np.where(c[k].T @ own[k] >= 0, 1.0, -1.0) for k in range(n)]
    for _ in range(rounds):
        for k in range(n):
            s = 2 * b[k] @ own[k].T - dual[k].T + 0.1 * (near[k][0].T + near[k][1].T)
            g, _, h = np.linalg.svd(s, full_matrices=False)
            c[k] = h.T @ g.T
        near = [(c[(k - 1) % n], c[(k + 1) % n]) for k in range(n)]
        dual = [dual[k] + 0.2 * (2 * c[k] - near[k][0] - near[k][1]) for k in range(n)]
        if update:
            b = [np.where(c[k].T @ own[k] >= 0, 1.0, -1.0) for k in range(n)]
    return dict(zip(names, c))


@pytest.mark.parametrize("per_node, update", [(40, False), (40, True), (120, False), (60, False)])
def test_dish_equals_a_plain_ring(items, per_node, update):
    x, node = X.astype(np.float32).astype(float), np.arange(len(X)) // per_node
    want = plain_ring(x, node, 4, 6, update)
    got = learn.fit_dish(items, 4, per_node, rounds=6, update_codes=update)
    assert set(got) == set(want) and all(np.allclose(got[k], want[k], atol=1e-8) and np.allclose(got[k].T @ got[k], np.eye(4)) for k in want)
    codes = {r["id"]: r["code"] for r in learn.dish_codes(items, got, per_node).collect()}
    assert codes == {i: int(pack((x[i] @ want[node[i]] >= 0)[None])[0]) for i in range(len(X))}


def test_dish_codes_rank_better_than_random_directions(spark):
    """Recall of the 10 nearest among the 20 of smallest Hamming distance, against random orthonormal directions."""
    rng = np.random.default_rng(4)
    x = rng.standard_normal((600, 4)) @ rng.standard_normal((4, 16)) * 3 + rng.standard_normal((600, 16)) * 0.3
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, vec array<double>")
    learned = learn.fit_dish(df, 8, 600)[0]

    def recall(c):
        b = x @ c >= 0
        near = np.argsort(((x[:, None] - x[None]) ** 2).sum(2), 1, kind="stable")[:, :10]
        found = np.argsort((b[:, None] != b[None]).sum(2), 1, kind="stable")[:, :20]
        return np.mean([len(set(n) & set(f)) / 10 for n, f in zip(near, found)])

    assert recall(learned) > np.mean([recall(np.linalg.qr(rng.standard_normal((16, 8)))[0]) for _ in range(5)]) - 0.02


@pytest.mark.parametrize("values", [search.BLOCK_VALUES, 200])
def test_self_scan_equals_scan(items, monkeypatch, values):
    want = {tuple(r) for r in search.top_k(search.scan(items, items, "e2", 5, exclude_self=True), 5).collect()}
    monkeypatch.setattr(search, "BLOCK_VALUES", values)
    assert {tuple(r) for r in search.top_k(search.self_scan(items, "e2", 5), 5).collect()} == want
    near = search.self_scan(items, "angular", radius=0.8).collect()
    assert len(near) == sum((exact(q, "angular") <= 0.8).sum() - 1 for q in range(len(X)))


def test_radius_of_long_vectors_keeps_the_border(spark):
    """Vectors of lengths near 1e5, where a matrix product cancels: those at the radius exactly are answers."""
    far = np.zeros((40, 16))
    far[:, 0], far[:, 1] = 1e5, np.arange(40) * 0.25
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(far)], "id long, vec array<double>")
    got = {(r["query_id"], r["item_id"]) for r in search.exact_radius(df.where("id < 5"), df, 2.0, "e2").collect()}
    assert got == {(q, i) for q in range(5) for i in range(40) if abs(q - i) <= 8}


def test_metrics_and_hooks_of_ones_own(items):
    manhattan = lambda a, b: np.abs(a[:, None] - b[None]).sum(2)
    got = search.linear_scan(items.where("id = 3"), items, 4, manhattan).orderBy("rank").collect()
    d = np.abs(X.astype(np.float32) - X[3].astype(np.float32)).sum(1)
    assert [r["item_id"] for r in got] == [i for i in np.argsort(d, kind="stable") if i != 3][:4]
    family = SimHash(4, 2, 8, 1)
    column = lambda a, b: F.aggregate(F.zip_with(a, b, lambda x, y: F.abs(x - y).cast("double")), F.lit(0.0), lambda s, v: s + v)
    some = search.lsh_join(items.where("id = 3"), items, family, metric=column, answer=lambda x: x > 0).collect()
    assert some and all(r["dist"] == pytest.approx(d[r["item_id"]], abs=1e-4) and r["dist"] > 0 for r in some)
    pairs = lambda forward: search.candidates(family.signatures(items.where("id = 3")), search.build_index(items, family), forward=forward)
    assert pairs(lambda met: met.where("table = 0")).count() < pairs(None).count()


@pytest.mark.parametrize("blocks", [1, 4])
def test_descent_by_blocks_equals_the_round(items, blocks):
    start = graph.random_graph(items, 6, "sq_e2")
    labels = items.select("id", (F.col("id") % blocks).alias("label"))
    rows = lambda g: sorted((r["src"], r["dst"], round(r["dist"], 6)) for r in g.collect())
    assert rows(graph.descent_round_blocks(start, items, labels, 6)) == rows(graph.descent_round(start, items, 6))


def test_blocks_are_cut_into_parts_of_bounded_size(spark, monkeypatch):
    """One block with a hub of 300 spokes (44,850 pairs) among vertices of few: no part of it holds many pairs or vectors, and the round stays whole."""
    x = np.random.default_rng(8).standard_normal((301, 4))
    items = spark.createDataFrame([(i, [float(v) for v in row]) for i, row in enumerate(x)], "id long, vec array<double>")
    start = spark.createDataFrame([(i, 0, float(((x[i] - x[0]) ** 2).sum())) for i in range(1, 301)] + [(i, i + 1, float(((x[i] - x[i + 1]) ** 2).sum())) for i in range(1, 300)], "src long, dst long, dist double")
    labels = items.select("id", F.lit(1).cast("long").alias("label"))
    want = sorted((r["src"], r["dst"], round(r["dist"], 9)) for r in graph.descent_round(start, items, 5).collect())
    monkeypatch.setattr(graph, "MEET", 20)
    monkeypatch.setattr(graph, "PART_PAIRS", 2000)
    around = start.select("src", "dst").unionAll(graph.reverse(start.select("src", "dst")).select("src", "dst")).distinct()
    cells = graph.parts_of_blocks(around, labels, 4).groupBy("part", "src", "ba", "bb").count().collect()
    pairs = {}
    for r in cells:
        pairs[r["part"]] = pairs.get(r["part"], 0) + r["count"] * (r["count"] - 1) // 2
    assert len(pairs) > 20 and max(pairs.values()) < 10_000
    got = sorted((r["src"], r["dst"], round(r["dist"], 9)) for r in graph.descent_round_blocks(start, items, labels, 5).collect())
    assert got == want


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


def test_buckets_meet_in_tasks_and_no_candidate_is_shuffled(items):
    for family, options in ((SimHash(4, 3, 8, 1), {}), (E2LSH(3, 2, 8, 2.0, 1), {"exclude_self": True}), (AllPairsSimHash(6, 4, 8, 1), {"radius": 1.2})):
        asked = items.where("id < 40")
        got = search.lsh_join(asked, items, family, **options)
        assert "Exchange" not in plan(got) and "Join" not in plan(got)
        want = search.verify(search.candidates(family.signatures(asked), search.build_index(items, family), options.get("exclude_self", False)), asked, items, family.metric, options.get("radius"))
        rows = lambda df: sorted((r["query_id"], r["item_id"], round(r["dist"], 6)) for r in df.collect())
        assert rows(got) == rows(want)


def test_expansion_makes_rows_only_of_pairs_within_the_radius(items, monkeypatch):
    """Every vector shares a bucket with every other; only the near pairs are written."""
    seen = []
    monkeypatch.setattr(probe, "saved", lambda df, name, f=probe.saved: seen.append((name, out := f(df, name))) or out)
    probe.expand_search(items.where("id < 20"), items, AllPairsSimHash(10, 2, 8, 1), 0.3, 4).collect()
    assert sum(df.count() for _, df in seen) < 200


@pytest.mark.parametrize("family", [None, SparseSimHash(6, 4), SparseSimHash(6, 4, all_pairs=True)])
@pytest.mark.parametrize("signed", [False, True])
def test_sparse_vectors_meet_in_tasks_and_nothing_is_shuffled(spark, monkeypatch, family, signed):
    """Frequent and rare indexes, negative values that cancel, an empty and a null vector, several blocks and runs."""
    rng = np.random.default_rng(5)
    rows = []
    for i in range(60):
        idx = sorted({*rng.integers(0, 400, 6).tolist(), *rng.integers(0, 4, 3).tolist()})
        rows.append((i, [(k, float(rng.choice([-1.0, 1.0])) if signed else float(rng.uniform(0.1, 1))) for k in idx]))
    rows += [(60, []), (61, None), (62, [(0, 1.0), (900, 1.0)]), (63, [(0, 1.0), (900, -1.0)])]
    df = spark.createDataFrame(rows, "id long, vec array<struct<idx:int,val:double>>")
    monkeypatch.setattr(search, "BLOCK_ENTRIES", 100)
    monkeypatch.setattr(search, "MEETINGS", 200)
    asked = df.where("id % 2 = 0")
    vecs = {i: dict(v or []) for i, v in rows}
    dot = lambda a, b: sum(x * vecs[b].get(k, 0.0) for k, x in vecs[a].items())
    if family is None:
        got = search.sparse_products(asked, df)
        want = {(a, b): dot(a, b) for a in vecs for b in vecs if a % 2 == 0 and vecs[a].keys() & vecs[b].keys()}
    else:
        got = search.lsh_join_sparse(asked, df, family, radius=1.3, exclude_self=True)
        met = search.candidates(family.signatures(asked), family.signatures(df), True).collect()
        angle = lambda a, b: np.arccos(np.clip(dot(a, b) / (dot(a, a) * dot(b, b)) ** 0.5, -1, 1))
        want = {(a, b): d for a, b in met if (d := angle(a, b)) <= 1.3}
    assert "Exchange" not in plan(got) and "Join" not in plan(got)
    found = got.collect()
    assert len(found) == len(want) and {(r[0], r[1]): round(r[2], 9) + 0.0 for r in found} == {k: round(v, 9) + 0.0 for k, v in want.items()}


def test_sparse_distances(spark):
    df = spark.createDataFrame([(0, [(0, 1.0), (5, 2.0)]), (1, [(5, 3.0)]), (2, [(7, 1.0)])], "id long, vec array<struct<idx:int,val:double>>")
    assert [(r[0], r[1], round(r[2], 9)) for r in search.sparse_scan(df.where("id = 0"), df, "e2", exclude_self=True).collect()] == [(0, 1, round(2**0.5, 9))]


@pytest.mark.parametrize("metric", ["dot", "arc"])
@pytest.mark.parametrize("large", [False, True])
def test_rounded_answers_leave_a_task_by_value(spark, monkeypatch, metric, large):
    """All answers, each rounded half away from zero, ascending in each held part; several blocks, runs and held parts, repeated ids, values too large to hold."""
    rng = np.random.default_rng(6)
    values = [-0.3, 0.5, 0.001, 1.2345675, 1e9] if large else [-0.3, 0.5, 0.001, 0.0000005]
    rows = [(i % 55, [(int(k), float(rng.choice(values))) for k in sorted({*rng.integers(0, 9, 4).tolist()})]) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, vec array<struct<idx:int,val:double>>").coalesce(1)
    monkeypatch.setattr(search, "BLOCK_ENTRIES", 80)
    monkeypatch.setattr(search, "MEETINGS", 200)
    plain = search.sparse_scan(df.where("id % 2 = 0"), df, metric).collect()
    want = sorted((r[0], r[1], float(Decimal(repr(r[2])).quantize(Decimal("0.000001"), ROUND_HALF_UP)) + 0.0) for r in plain)
    for held in (150, 100_000):
        monkeypatch.setattr(search, "HELD", held)
        got = search.sparse_scan(df.where("id % 2 = 0"), df, metric, places=6)
        assert plan(got).count("Project") == plan(search.sparse_scan(df.where("id % 2 = 0"), df, metric)).count("Project") and "Exchange" not in plan(got)
        found = [tuple(r) for r in got.collect()]
        assert sorted(found) == want
        if not large or metric == "arc":  # a new start for each block of queries and each held part at most
            assert sum(b[2] < a[2] for a, b in zip(found, found[1:])) <= 3 + len(found) // held


def test_words_are_counted_without_a_shuffle_and_rows_of_one_id_together(spark, tmp_path):
    from vecinity.plans import registry

    rows = [(1, "A b b"), (2, None), (3, "12 ..."), (4, "b"), (4, "c\u00e9 B")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r["id"]: sorted(round(e["val"], 6) for e in r["vec"]) for r in registry.sparse_items(spark, str(tmp_path)).collect()}
    assert got == {1: [round(5**-0.5, 6), round(2 * 5**-0.5, 6)], 4: [round(5**-0.5, 6), round(2 * 5**-0.5, 6)]}
    spark.createDataFrame(rows[:4], "doc_id long, text string").write.parquet(str(tmp_path / "once" / "documents.parquet"))
    assert "Exchange" not in plan(registry.sparse_items(spark, str(tmp_path / "once")))


def test_top_k_ties(spark):
    df = spark.createDataFrame([(0, i, float(5 - i)) for i in range(5)] + [(1, 9, 1.0), (1, 8, 1.0)], "query_id long, item_id long, dist double")
    got = search.top_k(df, 3).orderBy("query_id", "rank").collect()
    assert [(r["item_id"], r["dist"]) for r in got if r["query_id"] == 0] == [(4, 1.0), (3, 2.0), (2, 3.0)]
    assert [r["item_id"] for r in got if r["query_id"] == 1] == [8, 9]


def test_helpers_on_empty(spark):
    none = spark.createDataFrame([], "k long, v double")
    assert aggregates.arg_extreme(none, "k", "v").collect() == [(None, None)]
    assert aggregates.keyed_combine(none, "k", "v").count() == 0
    no_items = spark.createDataFrame([], "id long, vec array<float>")
    assert search.linear_scan(no_items, no_items).count() == 0
    assert graph.random_graph(no_items, 3, "e2").count() == 0


def test_null_vectors_are_left_out(spark, items):
    more = items.unionAll(spark.createDataFrame([(999, None)], "id long, vec array<float>"))
    assert search.linear_scan(more.where("id in (0, 999)"), more, 3).where("item_id = 999 or query_id = 999").count() == 0
    assert SimHash(2, 3, 8).signatures(more).where("id = 999").count() == 0


def test_pca_hash_bits():
    family = PCAHash(np.zeros(2), np.array([[[1.0, 0.0], [0.0, 1.0]]]))
    assert family.codes(np.array([[1.0, -1.0], [-1.0, 0.0]]))[:, 0, 0].tolist() == [2, 1]
