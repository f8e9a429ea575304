"""Queries on further operators: extension points, block-wise graphs, labels and the remaining vector functions."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from vecinity.functions import vectors
from vecinity.operators import aggregates, graph, probe, search
from vecinity.operators.families import SparseSimHash
from vecinity.plans.lineage import saved
from vecinity.plans.registry import DESCENT_SQL, DIM, E2, E2_CAND_SQL, E2_FN_SQL, E2_SIGS_SQL, E_SQL, EVERY, PAIRS_SQL, PCA, QD_SQL, RANDOM_SQL, SELF_SQL, SPARSE_PAIRS_SQL, T_SQL, WIDTH, _cells_sql, asked, items, knn10, query, rounded, sparse_items, table


@query(f"WITH {E_SQL}, c AS (SELECT x.id, y.v FROM e x JOIN e y ON y.id = x.id % 7), p AS (SELECT a.id AS query_id, b.id AS item_id, list_distance(a.v, b.v) AS d FROM c a, c b WHERE a.id % {EVERY} = 0 AND a.id <> b.id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, item_id) AS rank FROM p) SELECT query_id, item_id, round(d, 6) AS dist, rank::INT AS rank FROM r WHERE rank <= 100")
def linear_scan_copies(spark, sf_dir):
    """Exact top-k where every vector has many copies: equal distances go by id."""
    all_ = items(spark, sf_dir)
    copies = all_.select("id", (F.col("id") % 7).alias("of")).join(all_.select(F.col("id").alias("of"), "vec"), "of").select("id", "vec")
    return rounded(search.linear_scan(asked(copies), copies, 100, "e2"), "dist")


@query(f"WITH {E_SQL}, p AS (SELECT a.id AS query_id, b.id AS item_id, list_sum(list_transform(range(1, {DIM + 1}), lambda i: abs(a.v[i] - b.v[i]))) AS d FROM e a, e b WHERE a.id % {EVERY} = 0 AND a.id <> b.id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, item_id) AS rank FROM p) SELECT query_id, item_id, round(d, 6) AS dist, rank::INT AS rank FROM r WHERE rank <= 10")
def scan_own_metric(spark, sf_dir):
    """Exact top-k under a metric given as a function of two matrices."""
    all_ = items(spark, sf_dir)
    return rounded(search.linear_scan(asked(all_), all_, 10, lambda a, b: np.abs(a[:, None] - b[None]).sum(2)), "dist")


@query(f"{E2_CAND_SQL} SELECT query_id, item_id, round(d, 6) AS dist FROM p WHERE d BETWEEN 0.5 AND 1.25")
def answers_by_hook(spark, sf_dir):
    """Candidates answered by a distance column and a condition of one's own."""
    all_ = items(spark, sf_dir)
    own = lambda a, b: F.sqrt(vectors.square_e2(a, b))
    return rounded(search.lsh_join(asked(all_), all_, E2, metric=own, answer=lambda d: d.between(0.5, 1.25)), "dist")


@query(f"{E2_SIGS_SQL} SELECT DISTINCT x.id AS query_id, y.id AS item_id FROM s x JOIN s y USING (t, sig) WHERE x.id % {EVERY} = 0 AND t < 2")
def buckets_by_hook(spark, sf_dir):
    """Candidates of buckets that pass on only what a function lets through."""
    all_ = items(spark, sf_dir)
    return search.candidates(E2.signatures(asked(all_)), search.build_index(all_, E2), forward=lambda met: met.where("table < 2"))


@query(f"{QD_SQL.replace('probe_no < 20', 'probe_no < 24')}, p AS (SELECT query_id, probe_no // 8 AS round, s.id AS item_id, list_distance(a.v, b.v) AS d FROM pr JOIN s ON s.code = pr.sig JOIN e a ON a.id = query_id JOIN e b ON b.id = s.id), cn AS (SELECT query_id, round, count(*) AS n FROM p GROUP BY ALL), hd AS (SELECT a.query_id, a.round, coalesce(sum(b.n), 0) AS had FROM cn a LEFT JOIN cn b ON b.query_id = a.query_id AND b.round < a.round GROUP BY ALL) SELECT query_id, item_id, round(d, 6) AS dist, round::INT AS round FROM p JOIN hd USING (query_id, round) WHERE had < 20")
def qd_rounds(spark, sf_dir):
    """Probing by rounds of eight buckets; a query with 20 answers asks no more, the others go on."""
    all_ = items(spark, sf_dir)
    return rounded(probe.rounds_search(asked(all_), all_, PCA, probe.QDProbes(PCA, 8, 3, enough=20)), "dist")


@query("SELECT l_suppkey, round(max(l_quantity) - min(l_quantity), 6) AS spread FROM lineitem GROUP BY 1")
def keyed_combine_own(spark, sf_dir):
    """Values of a key combined by a function of one's own."""
    return aggregates.keyed_combine(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_quantity", lambda c: F.max(c) - F.min(c), "spread").withColumn("spread", F.round("spread", 6))


@query(f"{SPARSE_PAIRS_SQL} SELECT query_id, item_id, round(sqrt(greatest(0.0, 2 - 2 * dot)), 5) AS dist FROM p WHERE query_id <> item_id")
def sparse_e2(spark, sf_dir):
    """Euclidean distances of sparse vectors that share a word with a query's."""
    all_ = saved(sparse_items(spark, sf_dir), "sparse")
    return search.sparse_scan(asked(all_), all_, "e2", exclude_self=True).withColumn("dist", F.round("dist", 5) + F.lit(0.0))


PLAIN_SPARSE = SparseSimHash(24, 10)


def _plain_sparse_sql() -> str:
    fn = PLAIN_SPARSE.coefficient("idx::BIGINT", "fn")
    return f"WITH {T_SQL}, b AS (SELECT id, fn // 10 AS h, fn % 10 AS r, sum(val * {fn}) AS proj FROM s, range(240) t(fn) GROUP BY ALL), g AS (SELECT id, h, sum(CASE WHEN proj >= 0 THEN 1 << (9 - r)::INT ELSE 0 END)::BIGINT AS sig FROM b GROUP BY id, h), c AS (SELECT DISTINCT x.id AS query_id, y.id AS item_id FROM g x JOIN g y USING (h, sig) WHERE x.id % {EVERY} = 0), p AS (SELECT query_id, item_id, acos(least(1.0, sum(a.val * b.val))) AS d FROM c JOIN s a ON a.id = query_id JOIN s b ON b.id = item_id AND a.idx = b.idx GROUP BY ALL)"


@query(f"{_plain_sparse_sql()} SELECT query_id, item_id, round(d, 6) AS dist FROM p WHERE d <= 0.5")
def simhash_sparse(spark, sf_dir):
    """Radius join of sparse vectors by plain signatures."""
    all_ = saved(sparse_items(spark, sf_dir), "sparse")
    return rounded(search.lsh_join_sparse(asked(all_), all_, PLAIN_SPARSE, radius=0.5), "dist")


@query(f"WITH {E2_FN_SQL} SELECT fn::INT AS fn, unnest(range(0, {DIM}))::INT AS pos, unnest(a) AS a, b::DOUBLE AS b FROM f")
def family_functions(spark, sf_dir):
    """The coefficients of a family's functions."""
    return E2.functions(spark)


@query(f"{E2_SIGS_SQL} SELECT id, fn::INT AS fn, round(proj - floor(proj / {WIDTH}) * {WIDTH}, 6) + 0.0 AS residual FROM h")
def e2lsh_residuals(spark, sf_dir):
    return rounded(E2.residuals(items(spark, sf_dir)), "residual")


def blocks_of(spark, sf_dir):
    return items(spark, sf_dir).select("id", (F.col("id") % 7).alias("label"))


@query(f"{SELF_SQL}, n AS (SELECT id % 7 AS label, id FROM e UNION SELECT src % 7, dst FROM g) SELECT label, count(*) AS requests FROM n GROUP BY label")
def request_counts(spark, sf_dir):
    """Different vectors that each block of a graph's vertices needs."""
    return graph.request_counts(knn10(spark, sf_dir), blocks_of(spark, sf_dir))


@query(f"{SELF_SQL}, n AS (SELECT id % 7 AS label, id FROM e UNION SELECT src % 7, dst FROM g) SELECT label, id FROM n")
def requested_ids(spark, sf_dir):
    return graph.requested(knn10(spark, sf_dir), blocks_of(spark, sf_dir))


@query(f"{DESCENT_SQL} SELECT src, dst, round(d * d, 6) AS dist FROM al QUALIFY row_number() OVER (PARTITION BY src ORDER BY d, dst) <= 10")
def nn_descent_blocks(spark, sf_dir):
    """The descent round block by block."""
    all_ = items(spark, sf_dir)
    start = saved(graph.random_graph(all_, 10, "sq_e2"), "random")
    return rounded(graph.descent_round_blocks(start, all_, blocks_of(spark, sf_dir), 10), "dist")


@query(f"{SELF_SQL} SELECT e.id, least(e.id, coalesce(min(g.src), e.id))::BIGINT AS label FROM e LEFT JOIN g ON g.dst = e.id GROUP BY e.id")
def label_propagation(spark, sf_dir):
    """Labels reset to ids and sent once along the edges."""
    return graph.propagate_labels(knn10(spark, sf_dir), graph.reset_labels(items(spark, sf_dir)))


@query(f"{SELF_SQL}, l AS (SELECT DISTINCT src AS id, dst % 7 AS label FROM g) SELECT id, label FROM l QUALIFY row_number() OVER (PARTITION BY id ORDER BY label) = 3")
def nth_label(spark, sf_dir):
    return graph.nth_labels(knn10(spark, sf_dir), blocks_of(spark, sf_dir), 3)


def _descent_sql(rounds: int) -> str:
    """Seeding and the rounds written out one after the other."""
    cells = _cells_sql(3).removeprefix(f"WITH {E_SQL}, ")
    best = "QUALIFY row_number() OVER (PARTITION BY src ORDER BY d, dst) <= 10"
    parts = [RANDOM_SQL, cells, "hm AS (SELECT l.id, l.center AS lc, r.center AS rc FROM l JOIN r USING (id) WHERE l.r = 0 AND r.r = 0)", "sp AS (SELECT DISTINCT l.id AS src, hm.id AS dst FROM l JOIN r USING (id) JOIN hm ON hm.lc = l.center AND hm.rc = r.center WHERE l.id <> hm.id)", "sd AS (SELECT src, dst, list_distance(a.v, b.v) AS d FROM sp JOIN e a ON a.id = src JOIN e b ON b.id = dst)", f"ms AS (SELECT src, dst, d FROM sd {best})", f"k0 AS (SELECT * FROM (SELECT src, dst, min(d) AS d FROM (SELECT * FROM g0 UNION ALL SELECT * FROM ms) GROUP BY ALL) {best})"]
    for n in range(rounds):
        parts.append(f"nb{n} AS (SELECT src, dst FROM k{n} UNION SELECT dst, src FROM k{n}), pp{n} AS (SELECT DISTINCT x.dst AS a, y.dst AS b FROM nb{n} x JOIN nb{n} y ON x.src = y.src AND x.dst < y.dst), pd{n} AS (SELECT pp{n}.a, pp{n}.b, list_distance(p.v, q.v) AS d FROM pp{n} JOIN e p ON p.id = pp{n}.a JOIN e q ON q.id = pp{n}.b), k{n + 1} AS (SELECT * FROM (SELECT src, dst, min(d) AS d FROM (SELECT src, dst, d FROM k{n} UNION ALL SELECT a, b, d FROM pd{n} UNION ALL SELECT b, a, d FROM pd{n}) GROUP BY ALL) {best})")
    return ", ".join(parts) + f" SELECT src, dst, round(d * d, 6) AS dist FROM k{rounds}"


@query(_descent_sql(2))
def knn_graph_two_rounds(spark, sf_dir):
    """The whole graph builder: random and multi-index start, then two rounds."""
    return rounded(graph.knn_graph(items(spark, sf_dir), 10, 2), "dist")
