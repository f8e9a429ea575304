"""The engine's own queries over the test tables, and their SQL where SQL has them.

Hash coefficients are drawn once from a seed, rounded, and written into both. Searches take as queries every row whose id is divisible by
100, against all rows.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecinity.functions import vectors
from vecinity.operators import aggregates, evaluate, graph, learn, probe, search
from vecinity.operators.families import E2LSH, AllPairsSimHash, PCAHash, RotatedPCAHash, SimHash, SparseSimHash
from vecinity.plans.lineage import saved, scratch
from vecinity.sources import binary, text

DIM = 64
WIDTH = 2.0
RADIUS = 1.2
SPARSE_DIM = 500_000
EVERY = 100

# Parameters that reach a recall of 0.9 against the exact scans (README).
E2 = E2LSH(8, 2, DIM, WIDTH, seed=7)
SIM = SimHash(12, 3, DIM, seed=7)
ALL_PAIRS = AllPairsSimHash(55, 4, DIM, seed=7)
SPARSE = SparseSimHash(55, 14, all_pairs=True)


def _model(bits: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """A fixed model: a mean and orthonormal directions, rounded."""
    rng = np.random.default_rng(seed)
    return np.round(rng.normal(0, 0.01, DIM), 6), np.round(np.linalg.qr(rng.standard_normal((DIM, bits)))[0].T, 6)


MEAN, DIRECTIONS = _model(8, 11)
PCA = PCAHash(MEAN, DIRECTIONS[None])
ROTATION = np.round(np.linalg.qr(np.random.default_rng(13).standard_normal((8, 8)))[0], 6)
ROTATED = RotatedPCAHash(DIRECTIONS, ROTATION)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    """Registers a query under its name, with its SQL."""

    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            SQL[fn.__name__] = sql
        return fn

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def items(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))


def asked(all_items: DataFrame) -> DataFrame:
    """The stated query set."""
    return all_items.where(F.col("id") % EVERY == 0)


def word_vectors(batches, unit: bool):
    """(id, vec) of batches of (id, lower-cased text): how often each index occurs, in ascending order, at length 1 if unit; texts without words are left out."""
    known = {}
    for batch in batches:
        ids, sizes, idx, val = [], [0], [], []
        for one, text_ in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            tf = Counter()
            for w, n in Counter(re.findall("[a-z]+", text_)).items():
                k = known.get(w)
                if k is None:
                    k = int.from_bytes(hashlib.md5(w.encode()).digest()[:4], "big") % SPARSE_DIM
                    if len(known) < MEMORY:
                        known[w] = k
                tf[k] += n
            if tf:
                k, n = np.fromiter(tf.keys(), np.int32, len(tf)), np.fromiter(tf.values(), float, len(tf))
                order = np.argsort(k)
                ids.append(one)
                sizes.append(len(k))
                idx.append(k[order])
                val.append(n[order] / np.sqrt((n * n).sum()) if unit else n[order])
        entries = pa.StructArray.from_arrays([pa.array(np.concatenate([np.zeros(0, np.int32), *idx])), pa.array(np.concatenate([np.zeros(0), *val]))], ["idx", "val" if unit else "tf"])
        yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.ListArray.from_arrays(pa.array(np.cumsum(sizes), pa.int32()), entries)], ["id", "vec"])


#: Words whose hashes a task remembers.
MEMORY = 500_000


def sparse_items(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as term-frequency vectors of length 1: idx is a 32-bit hash of the word modulo SPARSE_DIM.

    Words are counted a document at a time, without a shuffle; only rows that share an id are brought together."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("id"), "text")
    texts = docs.where("text is not null").select("id", F.lower("text").alias("text"))
    entries = lambda name: f"id long, vec array<struct<idx:int,{name}:double>>"
    again = docs.groupBy("id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("id")
    if not again.take(1):
        return texts.mapInArrow(lambda batches: word_vectors(batches, True), entries("val"))
    one = texts.join(again, texts["id"].eqNullSafe(again["id"]), "left_anti").mapInArrow(lambda batches: word_vectors(batches, True), entries("val"))
    many = texts.join(again, texts["id"].eqNullSafe(again["id"]), "left_semi").mapInArrow(lambda batches: word_vectors(batches, False), entries("tf"))
    tf = many.select("id", F.explode("vec").alias("e")).groupBy("id", F.col("e.idx").alias("idx")).agg(F.sum("e.tf").alias("tf"))
    rows = tf.groupBy("id").agg(F.sqrt(F.sum(F.col("tf") * F.col("tf"))).alias("n"), F.array_sort(F.collect_list(F.struct("idx", F.col("tf").alias("val")))).alias("vec"))
    return one.unionAll(rows.select("id", F.transform("vec", lambda e: F.struct(e["idx"].alias("idx"), (e["val"] / F.col("n")).alias("val"))).alias("vec")))


def rounded(df: DataFrame, *cols: str) -> DataFrame:
    """The columns at six places, without negative zeros."""
    return df.withColumns({c: F.round(c, 6) + F.lit(0.0) for c in cols})


def numbers(x) -> str:
    return "[" + ", ".join(repr(float(v)) for v in x) + "]::DOUBLE[]"


def rows_sql(name: str, cols: str, rows) -> str:
    return f"{name}({cols}) AS (VALUES {', '.join('(' + ', '.join(str(v) for v in r) + ')' for r in rows)})"


E_SQL = "e AS (SELECT vec_id AS id, embedding::DOUBLE[] AS v FROM embeddings)"
Q_SQL = f"q AS (SELECT * FROM e WHERE id % {EVERY} = 0)"
ANGLE_SQL = "acos(greatest(-1.0, least(1.0, list_inner_product(a.v, b.v) / (sqrt(list_inner_product(a.v, a.v)) * sqrt(list_inner_product(b.v, b.v))))))"
PAIRS_SQL = f"WITH {E_SQL}, {Q_SQL}, p AS (SELECT a.id AS query_id, b.id AS item_id, list_distance(a.v, b.v) AS e2, {ANGLE_SQL} AS ang FROM q a, e b)"
T_SQL = f"""w AS (SELECT doc_id AS id, unnest(regexp_extract_all(lower(text), '[a-z]+')) AS w FROM documents),
tf AS (SELECT id, (('0x' || substr(md5(w), 1, 8))::BIGINT % {SPARSE_DIM})::INT AS idx, count(*)::DOUBLE AS c FROM w GROUP BY ALL),
s AS (SELECT id, idx, c / sqrt(sum(c * c) OVER (PARTITION BY id)) AS val FROM tf)"""


# Vector functions.


@query(f"WITH {E_SQL} SELECT id, round(list_inner_product(v, list_reverse(v)), 6) + 0.0 AS dot FROM e")
def vec_dot(spark, sf_dir):
    return rounded(items(spark, sf_dir).select("id", vectors.dot(F.col("vec"), F.reverse("vec")).alias("dot")), "dot")


@query(f"WITH {E_SQL} SELECT id, round(sqrt(list_inner_product(v, v)), 6) AS norm FROM e")
def vec_norm(spark, sf_dir):
    return rounded(items(spark, sf_dir).select("id", vectors.norm(F.col("vec")).alias("norm")), "norm")


@query(f"WITH {E_SQL}, u AS (SELECT id, unnest(range(0, len(v))) AS pos, unnest(v) AS x, sqrt(list_inner_product(v, v)) AS n FROM e) SELECT id, pos::INT AS pos, round(x / n, 6) + 0.0 AS x FROM u")
def vec_normalize(spark, sf_dir):
    return rounded(items(spark, sf_dir).select("id", F.posexplode(vectors.normalize(F.col("vec"))).alias("pos", "x")), "x")


def _distances(spark, sf_dir, metric):
    all_ = items(spark, sf_dir)
    return rounded(search.scan(asked(all_), all_, metric), "dist")


@query(f"{PAIRS_SQL} SELECT query_id, item_id, round(e2 * e2, 6) AS dist FROM p")
def dist_sq_e2(spark, sf_dir):
    return _distances(spark, sf_dir, "sq_e2")


@query(f"{PAIRS_SQL} SELECT query_id, item_id, round(e2, 6) AS dist FROM p")
def dist_e2(spark, sf_dir):
    return _distances(spark, sf_dir, "e2")


@query(f"{PAIRS_SQL} SELECT query_id, item_id, round(ang, 6) AS dist FROM p")
def dist_angular(spark, sf_dir):
    return _distances(spark, sf_dir, "angular")


SPARSE_PAIRS_SQL = f"WITH {T_SQL}, p AS (SELECT a.id AS query_id, b.id AS item_id, sum(a.val * b.val) AS dot FROM s a JOIN s b ON a.idx = b.idx AND a.id % {EVERY} = 0 GROUP BY ALL)"


@query(f"{SPARSE_PAIRS_SQL} SELECT query_id, item_id, round(dot, 6) AS dot FROM p")
def sparse_dot(spark, sf_dir):
    all_ = saved(sparse_items(spark, sf_dir), "sparse")
    return search.sparse_products(asked(all_), all_, places=6)


@query(f"{SPARSE_PAIRS_SQL} SELECT query_id, item_id, round(acos(least(1.0, dot)), 6) AS dist FROM p")
def sparse_angular(spark, sf_dir):
    all_ = saved(sparse_items(spark, sf_dir), "sparse")
    return search.sparse_scan(asked(all_), all_, "arc", places=6)


DENSE = np.round(np.random.default_rng(17).standard_normal(DIM), 6)


@query(f"WITH {T_SQL}, d AS (SELECT id, sum(CASE WHEN idx < {DIM} THEN val * ({numbers(DENSE)})[idx + 1] ELSE 0 END) AS dot FROM s GROUP BY id) SELECT id, round(dot, 6) + 0.0 AS dot FROM d")
def sparse_dense_dot(spark, sf_dir):
    dense = F.array(*[F.lit(float(x)) for x in DENSE])
    return rounded(sparse_items(spark, sf_dir).select("id", vectors.dot_sparse_dense(F.col("vec"), dense).alias("dot")), "dot")


# Exact search.


@query(f"{PAIRS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY e2, item_id) AS rank FROM p WHERE query_id <> item_id) SELECT query_id, item_id, round(e2, 6) AS dist, rank::INT AS rank FROM r WHERE rank <= 20")
def linear_scan_topk(spark, sf_dir):
    all_ = items(spark, sf_dir)
    return rounded(search.linear_scan(asked(all_), all_, 20, "e2"), "dist")


SELF_SQL = f"WITH {E_SQL}, p AS (SELECT a.id AS src, b.id AS dst, list_distance(a.v, b.v) AS d FROM e a, e b WHERE a.id <> b.id), g AS (SELECT *, row_number() OVER (PARTITION BY src ORDER BY d, dst) AS rank FROM p QUALIFY rank <= 10)"


@query(f"{SELF_SQL} SELECT src, dst, round(d * d, 6) AS dist, rank::INT AS rank FROM g")
def linear_scan_self_graph(spark, sf_dir):
    return rounded(graph.exact_graph(items(spark, sf_dir), 10), "dist")


@query(f"{PAIRS_SQL} SELECT query_id, item_id, round(ang, 6) AS dist FROM p WHERE ang <= {RADIUS}")
def exact_radius(spark, sf_dir):
    all_ = items(spark, sf_dir)
    return rounded(search.exact_radius(asked(all_), all_, RADIUS), "dist")


# E2LSH.

E2_FN_SQL = rows_sql("f", "fn, t, a, b", [(i, i // E2.rows, numbers(a), float(b)) for i, (a, b) in enumerate(zip(E2.directions, E2.offsets))])
E2_SIGS_SQL = f"WITH {E_SQL}, {Q_SQL}, {E2_FN_SQL}, h AS (SELECT id, t, fn, list_inner_product(v, a) + b AS proj FROM e, f), s AS (SELECT id, t, string_agg(floor(proj / {WIDTH})::BIGINT::VARCHAR, ',' ORDER BY fn) AS sig FROM h GROUP BY id, t)"
E2_CAND_SQL = f"{E2_SIGS_SQL}, c AS (SELECT DISTINCT x.id AS query_id, y.id AS item_id FROM s x JOIN s y USING (t, sig) WHERE x.id % {EVERY} = 0), p AS (SELECT query_id, item_id, list_distance(a.v, b.v) AS d FROM c JOIN e a ON a.id = query_id JOIN e b ON b.id = item_id)"


def sig_text(df: DataFrame) -> DataFrame:
    return df.withColumn("sig", F.array_join(F.transform("sig", lambda x: x.cast("string")), ","))


@query(f"{E2_SIGS_SQL} SELECT id, t::INT AS \"table\", sig FROM s")
def e2lsh_signatures(spark, sf_dir):
    return sig_text(E2.signatures(items(spark, sf_dir)))


@query(f"{E2_SIGS_SQL} SELECT id, fn::INT AS fn, round(proj, 6) + 0.0 AS proj FROM h")
def e2lsh_projections(spark, sf_dir):
    return rounded(E2.projections(items(spark, sf_dir)), "proj")


@query(f"{E2_CAND_SQL} SELECT query_id, item_id FROM c")
def e2lsh_candidates(spark, sf_dir):
    all_ = items(spark, sf_dir)
    return search.candidates(E2.signatures(asked(all_)), search.build_index(all_, E2))


@query(f"{E2_CAND_SQL} SELECT query_id, item_id, round(d, 6) AS dist FROM p")
def e2lsh_join(spark, sf_dir):
    all_ = items(spark, sf_dir)
    return rounded(search.lsh_join(asked(all_), all_, E2), "dist")


@query(f"{E2_CAND_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, item_id) AS rank FROM p) SELECT query_id, item_id, round(d, 6) AS dist, rank::INT AS rank FROM r WHERE rank <= 10")
def e2lsh_topk(spark, sf_dir):
    all_ = items(spark, sf_dir)
    return rounded(search.lsh_join(asked(all_), all_, E2, k=10), "dist")


@query(f"{E2_SIGS_SQL} SELECT t::INT AS \"table\", count(DISTINCT sig) AS buckets, count(*)::BIGINT AS entries FROM s GROUP BY t")
def lsh_table_stats(spark, sf_dir):
    return search.table_stats(search.build_index(items(spark, sf_dir), E2))


@query(f"{E2_SIGS_SQL} SELECT t::INT AS \"table\", sig, count(*) AS n FROM s GROUP BY t, sig")
def bucket_occupancy(spark, sf_dir):
    return sig_text(search.bucket_occupancy(search.build_index(items(spark, sf_dir), E2)))


# SimHash and all-pairs SimHash.


def sim_sql(family, rows: int, name: str) -> str:
    fns = rows_sql("f", "fn, h, bit, a", [(i, i // rows, rows - 1 - i % rows, numbers(a)) for i, a in enumerate(family.directions)])
    return f"{fns}, {name} AS (SELECT id, h, sum(CASE WHEN list_inner_product(v, a) >= 0 THEN (1 << bit) ELSE 0 END)::BIGINT AS sig FROM e, f GROUP BY id, h)"


SIM_SQL = f"WITH {E_SQL}, {sim_sql(SIM, SIM.rows, 's')}"


@query(f"{SIM_SQL} SELECT id, h::INT AS \"table\", sig FROM s")
def simhash_signatures(spark, sf_dir):
    return SIM.signatures(items(spark, sf_dir)).withColumn("sig", F.get("sig", F.lit(0)))


@query(f"{SIM_SQL}, c AS (SELECT DISTINCT x.id AS query_id, y.id AS item_id FROM s x JOIN s y USING (h, sig) WHERE x.id % {EVERY} = 0) SELECT query_id, item_id, round({ANGLE_SQL}, 6) AS dist FROM c JOIN e a ON a.id = query_id JOIN e b ON b.id = item_id")
def simhash_join(spark, sf_dir):
    all_ = items(spark, sf_dir)
    return rounded(search.lsh_join(asked(all_), all_, SIM), "dist")


AP_SQL = f"WITH RECURSIVE {E_SQL}, {sim_sql(ALL_PAIRS, ALL_PAIRS.half, 'half')}, s AS (SELECT x.id, x.h * 100 + y.h AS t, (x.sig << {ALL_PAIRS.half}) | y.sig AS sig FROM half x JOIN half y ON x.id = y.id AND x.h < y.h)"


@query(f"{AP_SQL}, c AS (SELECT DISTINCT x.id AS query_id, y.id AS item_id FROM s x JOIN s y USING (t, sig) WHERE x.id % {EVERY} = 0), p AS (SELECT query_id, item_id, {ANGLE_SQL} AS d FROM c JOIN e a ON a.id = query_id JOIN e b ON b.id = item_id) SELECT query_id, item_id, round(d, 6) AS dist FROM p WHERE d <= {RADIUS}")
def allpairs_simhash_radius(spark, sf_dir):
    all_ = items(spark, sf_dir)
    return rounded(search.lsh_join(asked(all_), all_, ALL_PAIRS, radius=RADIUS), "dist")


def _sparse_sql() -> str:
    fn = SPARSE.coefficient("idx::BIGINT", "fn")
    bits = f"b AS (SELECT id, fn // {SPARSE.half} AS h, fn % {SPARSE.half} AS r, sum(val * {fn}) AS proj FROM s, range({SPARSE.halves * SPARSE.half}) t(fn) GROUP BY ALL)"
    return f"WITH {T_SQL}, {bits}, half AS (SELECT id, h, sum(CASE WHEN proj >= 0 THEN 1 << ({SPARSE.half} - 1 - r)::INT ELSE 0 END)::BIGINT AS sig FROM b GROUP BY id, h), g AS (SELECT x.id, x.h * 100 + y.h AS t, (x.sig << {SPARSE.half}) | y.sig AS sig FROM half x JOIN half y ON x.id = y.id AND x.h < y.h), c AS (SELECT DISTINCT x.id AS query_id, y.id AS item_id FROM g x JOIN g y USING (t, sig) WHERE x.id % {EVERY} = 0), p AS (SELECT query_id, item_id, acos(least(1.0, sum(a.val * b.val))) AS d FROM c JOIN s a ON a.id = query_id JOIN s b ON b.id = item_id AND a.idx = b.idx GROUP BY ALL)"


@query(f"{_sparse_sql()} SELECT query_id, item_id, round(d, 6) AS dist FROM p WHERE d <= 0.5")
def allpairs_simhash_sparse(spark, sf_dir):
    all_ = saved(sparse_items(spark, sf_dir), "sparse")
    return rounded(search.lsh_join_sparse(asked(all_), all_, SPARSE, radius=0.5), "dist")


# Learned codes and probing.

PCA_FN_SQL = rows_sql("f", "bit, a, b", [(i, numbers(a), repr(float(b))) for i, (a, b) in enumerate(zip(PCA.directions, PCA.offsets))])
PCA_SQL = f"WITH {E_SQL}, {PCA_FN_SQL}, h AS (SELECT id, bit, list_inner_product(v, a) + b AS proj FROM e, f), s AS (SELECT id, sum(CASE WHEN proj >= 0 THEN 1 << (7 - bit)::INT ELSE 0 END)::BIGINT AS code FROM h GROUP BY id)"
QD_SQL = f"{PCA_SQL}, m AS (SELECT id AS query_id, mask, round(sum(CASE WHEN (mask >> (7 - bit)::INT) & 1 = 1 THEN abs(proj) ELSE 0 END), 12) AS qd FROM h, range(256) t(mask) WHERE id % {EVERY} = 0 GROUP BY ALL), n AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY qd, mask) - 1 AS probe_no FROM m QUALIFY probe_no < 20), pr AS (SELECT query_id, probe_no, xor(code, mask) AS sig, qd FROM n JOIN s ON s.id = query_id)"


@query(f"{PCA_SQL} SELECT id, code FROM s")
def pca_codes(spark, sf_dir):
    return PCA.signatures(items(spark, sf_dir)).select("id", F.get("sig", F.lit(0)).alias("code"))


@query(f"{QD_SQL} SELECT query_id, probe_no::INT AS probe_no, sig, round(qd, 6) AS qd FROM pr")
def qd_probe_sequence(spark, sf_dir):
    probes = probe.qd_probes(asked(items(spark, sf_dir)), PCA, 20)
    return rounded(probes.select("query_id", "probe_no", F.get("sig", F.lit(0)).alias("sig"), "qd"), "qd")


@query(f"{QD_SQL}, p AS (SELECT query_id, s.id AS item_id, list_distance(a.v, b.v) AS d FROM pr JOIN s ON s.code = pr.sig JOIN e a ON a.id = query_id JOIN e b ON b.id = s.id), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, item_id) AS rank FROM p) SELECT query_id, item_id, round(d, 6) AS dist, rank::INT AS rank FROM r WHERE rank <= 20")
def qd_topk(spark, sf_dir):
    all_ = items(spark, sf_dir)
    return rounded(probe.qd_search(asked(all_), all_, PCA, 20, 20), "dist")


def _hamming_sql(codes: str) -> str:
    return f"{codes}, p AS (SELECT a.id AS query_id, b.id AS item_id, bit_count(xor(a.code, b.code))::BIGINT AS d FROM s a, s b WHERE a.id % {EVERY} = 0), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY d, item_id) AS rank FROM p) SELECT query_id, item_id, d AS dist, rank::INT AS rank FROM r WHERE rank <= 20"


@query(_hamming_sql(PCA_SQL))
def hamming_topk(spark, sf_dir):
    all_ = items(spark, sf_dir)
    return probe.hamming_search(asked(all_), all_, PCA, 20)


ROT_FN_SQL = rows_sql("f", "bit, a", [(i, numbers(a)) for i, a in enumerate(ROTATED.directions)])


@query(_hamming_sql(f"WITH {E_SQL}, {ROT_FN_SQL}, s AS (SELECT id, sum(CASE WHEN list_inner_product(v, a) > 0 THEN 1 << (7 - bit)::INT ELSE 0 END)::BIGINT AS code FROM e, f GROUP BY id)"))
def rotated_hamming_topk(spark, sf_dir):
    all_ = items(spark, sf_dir)
    return probe.hamming_search(asked(all_), all_, ROTATED, 20)


def _expansion_sql(radius: float, rounds: int) -> str:
    """The rounds written out one after the other."""
    parts = [AP_SQL, f"f0 AS (SELECT id AS query_id, id AS item_id FROM e WHERE id % {EVERY} = 0)"]
    done = []
    for n in range(rounds):
        before = " UNION ALL ".join(f"SELECT query_id, item_id FROM r{k}" for k in done) or "SELECT NULL, NULL WHERE false"
        parts.append(f"c{n} AS (SELECT DISTINCT f.query_id, y.id AS item_id FROM f{n} f JOIN s x ON x.id = f.item_id JOIN s y USING (t, sig) WHERE (f.query_id, y.id) NOT IN ({before}))")
        parts.append(f"r{n} AS (SELECT query_id, item_id, {ANGLE_SQL} AS d, {n} AS round FROM c{n} JOIN e a ON a.id = query_id JOIN e b ON b.id = item_id WHERE {ANGLE_SQL} <= {radius})")
        parts.append(f"f{n + 1} AS (SELECT query_id, item_id FROM r{n})")
        done.append(n)
    return ", ".join(parts) + " " + " UNION ALL ".join(f"SELECT query_id, item_id, round(d, 6) AS dist, round::INT AS round FROM r{n}" for n in done)


@query(_expansion_sql(1.25, 4))
def candidate_expansion(spark, sf_dir):
    all_ = items(spark, sf_dir)
    return rounded(probe.expand_search(asked(all_), all_, ALL_PAIRS, 1.25, 5), "dist")


# Graphs.


def knn10(spark, sf_dir) -> DataFrame:
    return saved(graph.exact_graph(items(spark, sf_dir), 10), "graph")


@query(f"{SELF_SQL} SELECT dst AS src, src AS dst, round(d * d, 6) AS dist FROM g")
def graph_reverse(spark, sf_dir):
    return rounded(graph.reverse(knn10(spark, sf_dir).drop("rank")), "dist")


@query(f"{SELF_SQL}, u AS (SELECT src, dst FROM g UNION SELECT dst, src FROM g) SELECT src AS id, count(*) AS degree FROM u GROUP BY src")
def graph_degree(spark, sf_dir):
    return graph.degree(knn10(spark, sf_dir))


IN_SQL = f"{SELF_SQL}, i AS (SELECT dst AS id, count(*) AS indegree FROM g GROUP BY dst)"


@query(f"{IN_SQL} SELECT id, indegree FROM i ORDER BY indegree DESC, id LIMIT 10")
def graph_top_indegree(spark, sf_dir):
    return graph.top_in_degree(knn10(spark, sf_dir), 10)


@query(f"{IN_SQL}, x AS (SELECT id, indegree FROM i ORDER BY indegree DESC, id LIMIT 1), n AS (SELECT id, indegree FROM i ORDER BY indegree, id LIMIT 1) SELECT 'max' AS kind, id, indegree FROM x UNION ALL SELECT 'min', id, indegree FROM n")
def indegree_max_min(spark, sf_dir):
    degrees = graph.in_degree(knn10(spark, sf_dir))
    side = lambda kind, largest: aggregates.arg_extreme(degrees, "id", "indegree", largest).select(F.lit(kind).alias("kind"), "id", "indegree")
    return side("max", True).unionAll(side("min", False))


NEAR_SQL = f"WITH RECURSIVE {E_SQL}, g AS (SELECT a.id AS src, b.id AS dst FROM e a, e b WHERE a.id <> b.id AND {ANGLE_SQL} <= 1.15)"


def near_graph(spark, sf_dir) -> DataFrame:
    """All pairs within an angle of 1.15."""
    all_ = items(spark, sf_dir)
    return saved(search.self_scan(all_, "angular", radius=1.15).select(F.col("query_id").alias("src"), F.col("item_id").alias("dst")), "near")


CC_SQL = f"{NEAR_SQL}, reach(a, b) AS (SELECT id, id FROM e UNION SELECT r.a, g.dst FROM reach r JOIN g ON g.src = r.b), c AS (SELECT a AS id, min(b) AS label FROM reach GROUP BY a)"


@query(f"{CC_SQL} SELECT id, label FROM c")
def graph_components(spark, sf_dir):
    return graph.components_of(items(spark, sf_dir), near_graph(spark, sf_dir))


@query(f"{CC_SQL} SELECT label, count(*) AS size FROM c GROUP BY label")
def component_sizes(spark, sf_dir):
    return graph.component_sizes(graph.components_of(items(spark, sf_dir), near_graph(spark, sf_dir)))


CLUSTERS = [3, 1, 4, 1, 5, 9, 2]


@query(f"WITH {E_SQL} SELECT id, ([{', '.join(map(str, CLUSTERS))}])[(id % {len(CLUSTERS)} + 1)::INT]::BIGINT AS label FROM e")
def cluster_random(spark, sf_dir):
    return graph.random_cluster(items(spark, sf_dir), CLUSTERS)


@query(f"{NEAR_SQL}, l1 AS (SELECT e.id, least(e.id, min(g.dst)) AS label FROM e LEFT JOIN g ON g.src = e.id GROUP BY e.id), l2 AS (SELECT l1.id, least(l1.label, min(n.label)) AS label FROM l1 LEFT JOIN g ON g.src = l1.id LEFT JOIN l1 n ON n.id = g.dst GROUP BY l1.id, l1.label) SELECT id, label FROM l2")
def cluster_hop_min(spark, sf_dir):
    return graph.hop_cluster(items(spark, sf_dir), near_graph(spark, sf_dir), 2)


SEEDS = [0, 7, 21, 42, 99, 150, 200, 333]


def _bfs_sql(rounds: int) -> str:
    parts = [NEAR_SQL, f"d0 AS (SELECT id, id AS label, 0 AS wave FROM e WHERE id IN ({', '.join(map(str, SEEDS))}))"]
    for n in range(1, rounds + 1):
        parts.append(f"v{n} AS (SELECT g.dst AS id, d.label, count(*) AS n FROM d{n - 1} d JOIN g ON g.src = d.id WHERE d.wave = {n - 1} AND g.dst NOT IN (SELECT id FROM d{n - 1}) GROUP BY ALL), w{n} AS (SELECT id, label FROM v{n} QUALIFY row_number() OVER (PARTITION BY id ORDER BY n DESC, label) = 1), d{n} AS (SELECT * FROM d{n - 1} UNION ALL SELECT id, label, {n} FROM w{n})")
    return ", ".join(parts) + f" SELECT e.id, coalesce(d.label, {max(SEEDS) + 1})::BIGINT AS label FROM e LEFT JOIN d{rounds} d ON d.id = e.id"


@query(_bfs_sql(12))
def cluster_bfs(spark, sf_dir):
    return graph.bfs_cluster(items(spark, sf_dir), near_graph(spark, sf_dir), SEEDS, 12)


def _centers_sql(name: str, seed: int) -> str:
    return f"{name} AS (SELECT id AS center, v FROM e ORDER BY (id * 1103515245 + {12345 + seed * 7919}) % 2147483648, id LIMIT (SELECT floor(2 * sqrt(count(*)))::BIGINT FROM e))"


def _cells_sql(top: int) -> str:
    side = lambda n, c: f"{n} AS (SELECT i.id, c.center, row_number() OVER (PARTITION BY i.id ORDER BY round(list_distance(i.v, c.v) ** 2, 9), c.center) - 1 AS r FROM e i, {c} c QUALIFY r < {top})"
    return f"WITH {E_SQL}, {_centers_sql('lc', 0)}, {_centers_sql('rc', 1)}, {side('l', 'lc')}, {side('r', 'rc')}"


@query(f"{_cells_sql(1)} SELECT l.id, l.center AS left_center, r.center AS right_center FROM l JOIN r USING (id)")
def multiindex_cells(spark, sf_dir):
    return graph.multi_index_cells(items(spark, sf_dir))


@query(f"{_cells_sql(3)}, h AS (SELECT l.id, l.center AS lc, r.center AS rc FROM l JOIN r USING (id) WHERE l.r = 0 AND r.r = 0), p AS (SELECT DISTINCT l.id AS src, h.id AS dst FROM l JOIN r USING (id) JOIN h ON h.lc = l.center AND h.rc = r.center WHERE l.id <> h.id), d AS (SELECT src, dst, list_distance(a.v, b.v) AS d FROM p JOIN e a ON a.id = src JOIN e b ON b.id = dst) SELECT src, dst, round(d * d, 6) AS dist FROM d QUALIFY row_number() OVER (PARTITION BY src ORDER BY d, dst) <= 10")
def multiindex_seed(spark, sf_dir):
    return rounded(graph.multi_index_seed(items(spark, sf_dir), 10), "dist")


RANDOM_SQL = f"""WITH {E_SQL}, n AS (SELECT max(id) + 1 AS n FROM e),
dr AS (SELECT DISTINCT id AS src, (id + 1 + (id * 7919 + j * 104729 + j * j * 31) % (n - 1)) % n AS dst FROM e, n, range(1, 21) t(j)),
g0 AS (SELECT src, dst, list_distance(a.v, b.v) AS d FROM dr JOIN e a ON a.id = src JOIN e b ON b.id = dst QUALIFY row_number() OVER (PARTITION BY src ORDER BY d, dst) <= 10)"""
DESCENT_SQL = f"""{RANDOM_SQL}, bk AS (SELECT dst AS src, src AS dst, d FROM g0),
nb AS (SELECT src, dst FROM g0 UNION SELECT src, dst FROM bk), pp AS (SELECT DISTINCT x.dst AS a, y.dst AS b FROM nb x JOIN nb y ON x.src = y.src AND x.dst < y.dst),
pd AS (SELECT pp.a, pp.b, list_distance(a.v, b.v) AS d FROM pp JOIN e a ON a.id = pp.a JOIN e b ON b.id = pp.b),
al AS (SELECT src, dst, min(d) AS d FROM (SELECT src, dst, d FROM g0 UNION ALL SELECT a, b, d FROM pd UNION ALL SELECT b, a, d FROM pd) GROUP BY ALL)"""


@query(f"{RANDOM_SQL} SELECT src, dst, round(d * d, 6) AS dist FROM g0")
def random_graph(spark, sf_dir):
    return rounded(graph.random_graph(items(spark, sf_dir), 10, "sq_e2"), "dist")


@query(f"{DESCENT_SQL} SELECT src, dst, round(d * d, 6) AS dist FROM al QUALIFY row_number() OVER (PARTITION BY src ORDER BY d, dst) <= 10")
def nn_descent_1iter(spark, sf_dir):
    all_ = items(spark, sf_dir)
    return rounded(graph.descent_round(saved(graph.random_graph(all_, 10, "sq_e2"), "random"), all_, 10), "dist")


@query()
def nn_descent_recall(spark, sf_dir):
    """Mean recall of the built graph; iterative, tested against the exact graph."""
    all_ = items(spark, sf_dir)
    found = graph.knn_graph(all_, 10, 6)
    return evaluate.graph_recall(found, knn10(spark, sf_dir)).agg(F.round(F.avg("recall"), 6).alias("recall"))


# Aggregation, samples, evaluation.


@query("SELECT l_returnflag, round(sum(l_quantity), 2) AS sum_qty FROM lineitem GROUP BY 1")
def keyed_combine_sum(spark, sf_dir):
    return aggregates.keyed_combine(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_quantity", "sum", "sum_qty").withColumn("sum_qty", F.round("sum_qty", 2))


@query("SELECT l_suppkey, min(l_extendedprice) AS lowest FROM lineitem GROUP BY 1")
def keyed_combine_min(spark, sf_dir):
    return aggregates.keyed_combine(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_extendedprice", "min", "lowest")


@query("SELECT l_suppkey, max(l_extendedprice) AS highest FROM lineitem GROUP BY 1")
def keyed_combine_max(spark, sf_dir):
    return aggregates.keyed_combine(table(spark, sf_dir, "lineitem"), "l_suppkey", "l_extendedprice", "max", "highest")


@query("SELECT round(sum(o_totalprice), 2) AS sum_value, count(*) AS n FROM orders")
def global_sum_count(spark, sf_dir):
    return aggregates.sum_count(table(spark, sf_dir, "orders"), "o_totalprice").withColumn("sum_value", F.round("sum_value", 2))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 10")
def global_topk(spark, sf_dir):
    return aggregates.global_top(table(spark, sf_dir, "orders"), "o_orderkey", "o_totalprice", 10)


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 1")
def arg_max(spark, sf_dir):
    return aggregates.arg_extreme(table(spark, sf_dir, "orders"), "o_orderkey", "o_totalprice")


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 1")
def arg_min(spark, sf_dir):
    return aggregates.arg_extreme(table(spark, sf_dir, "orders"), "o_orderkey", "o_totalprice", False)


@query("SELECT o_orderkey FROM orders ORDER BY (o_orderkey * 1103515245 + 12345) % 2147483648, o_orderkey LIMIT 50")
def sample_fixed(spark, sf_dir):
    return aggregates.sample_exact(table(spark, sf_dir, "orders").select("o_orderkey"), "o_orderkey", 50)


TRUTH_SQL = f"{E2_CAND_SQL}, tr AS (SELECT a.id AS query_id, b.id AS item_id, list_distance(a.v, b.v) AS d FROM q a, e b QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY d, item_id) <= 10), re AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY d, item_id) <= 10)"


def _answers(spark, sf_dir):
    all_ = items(spark, sf_dir)
    return saved(search.lsh_join(asked(all_), all_, E2, k=10), "answers"), saved(search.linear_scan(asked(all_), all_, 10, exclude_self=False), "truth")


@query(f"{TRUTH_SQL} SELECT tr.query_id, count(re.item_id) / 10.0::DOUBLE AS recall FROM tr LEFT JOIN re USING (query_id, item_id) GROUP BY 1")
def recall_at_k(spark, sf_dir):
    return evaluate.recall(*_answers(spark, sf_dir), 10)


@query(f"{TRUTH_SQL}, a AS (SELECT query_id, d, row_number() OVER (PARTITION BY query_id ORDER BY d, item_id) AS r FROM re), b AS (SELECT query_id, d AS t, row_number() OVER (PARTITION BY query_id ORDER BY d, item_id) AS r FROM tr) SELECT query_id, round(avg(d / t), 6) AS error FROM a JOIN b USING (query_id, r) WHERE t > 0 GROUP BY query_id")
def error_ratio(spark, sf_dir):
    return rounded(evaluate.error_ratio(*_answers(spark, sf_dir), 10), "error")


@query(f"{RANDOM_SQL}, x AS (SELECT a.id AS src, b.id AS dst, list_distance(a.v, b.v) AS d FROM e a, e b WHERE a.id <> b.id QUALIFY row_number() OVER (PARTITION BY a.id ORDER BY list_distance(a.v, b.v), b.id) <= 10), n2 AS (SELECT src, count(*) AS t FROM x GROUP BY 1), n1 AS (SELECT src, count(*) AS f FROM g0 GROUP BY 1), h AS (SELECT src, count(*) AS h FROM x JOIN g0 USING (src, dst) GROUP BY 1) SELECT src, round(coalesce(h, 0)::DOUBLE / least(t, f), 6) AS recall FROM n2 JOIN n1 USING (src) LEFT JOIN h USING (src)")
def graph_recall(spark, sf_dir):
    return rounded(evaluate.graph_recall(graph.random_graph(items(spark, sf_dir), 10, "sq_e2"), knn10(spark, sf_dir)), "recall")


# Formats.

NUM = "round({}, 6)::DECIMAL(18,6)::VARCHAR"
TOP_SQL = f"{PAIRS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY e2, item_id) AS rank FROM p WHERE query_id <> item_id QUALIFY rank <= 20)"


@query(f"{TOP_SQL} SELECT query_id::VARCHAR || ' ' || item_id::VARCHAR || ' ' || {NUM.format('e2')} AS line FROM r")
def format_triplet(spark, sf_dir):
    all_ = items(spark, sf_dir)
    return text.triplet_lines(search.linear_scan(asked(all_), all_, 20))


@query(f"{TOP_SQL} SELECT query_id::VARCHAR || ' ' || string_agg(item_id::VARCHAR || ' ' || {NUM.format('e2')}, ' ' ORDER BY rank) AS line FROM r GROUP BY query_id")
def format_pairs(spark, sf_dir):
    all_ = items(spark, sf_dir)
    return text.pair_lines(search.linear_scan(asked(all_), all_, 20))


@query(f"{TOP_SQL} SELECT count(DISTINCT query_id)::VARCHAR || chr(9) || '20' AS line FROM r UNION ALL SELECT query_id::VARCHAR || chr(9) || string_agg(item_id::VARCHAR || chr(9) || {NUM.format('e2')}, chr(9) ORDER BY rank) AS line FROM r GROUP BY query_id")
def format_lshbox(spark, sf_dir):
    all_ = items(spark, sf_dir)
    return text.truth_lines(saved(search.linear_scan(asked(all_), all_, 20), "truth"), 20)


@query(f"{TOP_SQL} SELECT query_id, rank::INT AS rank, item_id, round(e2, 6) AS dist FROM r")
def parse_lshbox(spark, sf_dir):
    """The truth file written and read again."""
    path = scratch(spark, "lshbox")
    text.write_lines(format_lshbox(spark, sf_dir), path)
    return text.read_truth(spark, path)


@query(f"WITH {T_SQL} SELECT id, idx, round(val::FLOAT::DOUBLE, 6) AS val FROM s")
def parse_idlibsvm(spark, sf_dir):
    """Sparse vectors written as idlibsvm lines and read again."""
    path = scratch(spark, "idlibsvm")
    pairs = F.concat_ws(" ", F.transform("vec", lambda e: F.concat_ws(":", e["idx"].cast("string"), e["val"].cast("string"))))
    text.write_lines(sparse_items(spark, sf_dir).select(F.concat_ws(" ", F.col("id").cast("string"), pairs).alias("line")), path)
    got = text.read_idlibsvm(spark, path).select("id", F.explode("vec").alias("e"))
    return got.select("id", F.col("e.idx").alias("idx"), F.round(F.col("e.val").cast("double"), 6).alias("val"))


@query(f"WITH {E_SQL}, u AS (SELECT id, unnest(range(0, len(v))) AS pos, unnest(v) AS x FROM e) SELECT id, pos::INT AS pos, round(x, 6) + 0.0 AS x FROM u")
def idfvecs_round_trip(spark, sf_dir):
    """Vectors written as idfvecs and read again."""
    path = scratch(spark, "idfvecs")
    binary.write_vectors(items(spark, sf_dir), path)
    got = binary.read_vectors(spark, path, dim=DIM).select("id", F.posexplode("vec").alias("pos", "x"))
    return rounded(got.withColumn("x", F.col("x").cast("double")), "x")


# Learning.


@query()
def pca_fit_codes(spark, sf_dir):
    """Codes of a PCA hash fitted on the table; tested against numpy."""
    all_ = items(spark, sf_dir)
    return learn.fit_pca(all_, 12).signatures(all_).select("id", F.get("sig", F.lit(0)).alias("code"))


NODE = 100


@query(f"WITH {E_SQL}, x AS (SELECT id // {NODE} AS node, v, unnest(range(0, 16)) AS bit FROM e), y AS (SELECT node, bit, unnest(range(0, {DIM})) AS pos, unnest(v) AS x, CASE WHEN v[bit + 1] >= 0 THEN 1 ELSE -1 END AS b FROM x) SELECT node::BIGINT AS node, bit::INT AS bit, pos::INT AS pos, round(sum(b * x), 6) + 0.0 AS m FROM y GROUP BY ALL")
def dish_products(spark, sf_dir):
    """B X' of each node under the first matrix: the only pass of consensus learning over the data."""
    found = learn.products(learn.with_node(items(spark, sf_dir), NODE), np.eye(DIM, 16))
    rows = [(int(n), b, p, float(x)) for n, m in found.items() for b, r in enumerate(m) for p, x in enumerate(r)]
    return rounded(spark.createDataFrame(rows, "node long, bit int, pos int, m double"), "m")


SIGNS = np.round(np.linalg.qr(np.random.default_rng(19).standard_normal((DIM, 12)))[0], 6)


@query(f"WITH {E_SQL}, {rows_sql('f', 'bit, a', [(k, numbers(a)) for k, a in enumerate(SIGNS.T)])} SELECT id // {NODE} AS node, id, sum(CASE WHEN list_inner_product(v, a) >= 0 THEN 1 << (11 - bit)::INT ELSE 0 END)::BIGINT AS code FROM e, f GROUP BY ALL")
def sign_codes(spark, sf_dir):
    """sgn(C'X) under given matrices, the same for all nodes."""
    all_ = items(spark, sf_dir)
    nodes = [r["node"] for r in learn.with_node(all_, NODE).select("node").distinct().collect()]
    return learn.dish_codes(all_, {n: SIGNS for n in nodes}, NODE)


@query()
def dish_codes(spark, sf_dir):
    """Codes of hash functions learned by consensus, each item under its node's own; iterative, tested against a plain ring in numpy."""
    all_ = items(spark, sf_dir)
    return learn.dish_codes(all_, learn.fit_dish(all_, 16, NODE), NODE)


@query(f"WITH {E_SQL}, u AS (SELECT id, unnest(range(0, {DIM})) AS i, unnest(v) AS x FROM e), m AS (SELECT i, avg(x) AS m FROM u GROUP BY i) SELECT a.i::INT AS i, b.i::INT AS j, round(avg(a.x * b.x) - any_value(p.m) * any_value(q.m), 6) + 0.0 AS cov FROM u a JOIN u b USING (id) JOIN m p ON p.i = a.i JOIN m q ON q.i = b.i GROUP BY a.i, b.i")
def pca_covariance(spark, sf_dir):
    """The covariance from which PCA hashing learns: one pass of moments."""
    n, total, outer = learn.moments(items(spark, sf_dir))
    cov = outer / n - np.outer(total / n, total / n)
    return rounded(spark.createDataFrame([(i, j, float(x)) for i, r in enumerate(cov) for j, x in enumerate(r)], "i int, j int, cov double"), "cov")


# Queries on formats and further operators register themselves.
from vecinity.plans import formats, further  # noqa: E402, F401
