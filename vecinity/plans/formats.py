"""Queries on sources and sinks: tables written in a format and read again."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from vecinity.operators import learn, search
from vecinity.operators.families import RotatedPCAHash
from vecinity.plans import config
from vecinity.plans.lineage import saved, scratch
from vecinity.plans.registry import DIM, DIRECTIONS, E_SQL, EVERY, NODE, NUM, PAIRS_SQL, PCA, PCA_SQL, RADIUS, ROTATION, SELF_SQL, SIGNS, T_SQL, TOP_SQL, asked, items, knn10, numbers, query, rounded, rows_sql, sparse_items
from vecinity.sources import binary, models, text

BYTE = "floor((x::DOUBLE + 1) * 127)::INT"


def bytes_of(df):
    """Vectors in [-1, 1] as whole numbers from 0 to 254."""
    return df.select("id", F.transform("vec", lambda x: F.floor((x.cast("double") + 1) * 127).cast("smallint")).alias("vec"))


@query(f"WITH {E_SQL}, u AS (SELECT id, unnest(range(0, len(v))) AS pos, unnest(v) AS x FROM e WHERE id % 7 <> 0) SELECT id, pos::INT AS pos, round(x, 6) + 0.0 AS x FROM u")
def parse_records(spark, sf_dir):
    """Lines `id;x;x...` read by a function of one's own; every seventh is broken and dropped."""

    def parser(line):
        key, *rest = line.split(";")
        return int(key), [float(x) for x in rest]

    lines = items(spark, sf_dir).select(F.when(F.col("id") % 7 == 0, F.lit("no;numbers")).otherwise(F.concat_ws(";", F.col("id").cast("string"), F.transform("vec", lambda x: x.cast("double").cast("string")))).alias("value"))
    got = text.parse_records(lines, parser, "id long, vec array<double>").select("id", F.posexplode("vec").alias("pos", "x"))
    return rounded(got, "x")


@query(f"{TOP_SQL} SELECT query_id, rank::INT AS rank, item_id, round(e2, 6) AS dist FROM r")
def parse_lshbox_self(spark, sf_dir):
    """A truth file whose lines begin with the query itself, which the reader drops."""
    all_ = items(spark, sf_dir)
    path = scratch(spark, "lshbox")
    text.write_lines(text.truth_lines(saved(search.linear_scan(asked(all_), all_, 21, exclude_self=False), "truth"), 21), path)
    return text.read_truth(spark, path, drop_self=True)


@query(f"{SELF_SQL} SELECT src, dst, round(d * d, 6) AS dist FROM g UNION ALL SELECT dst, src, round(d * d, 6) AS dist FROM g")
def parse_graph_both_ways(spark, sf_dir):
    """A graph file, read with its edges in both directions."""
    path = scratch(spark, "graph")
    text.write_lines(text.pair_lines(knn10(spark, sf_dir).select(F.col("src").alias("query_id"), F.col("dst").alias("item_id"), "dist", "rank")), path)
    return rounded(text.read_graph(spark, path, both_ways=True), "dist")


@query(f"WITH {E_SQL}, u AS (SELECT id, unnest(range(0, len(v))) AS pos, unnest(v) AS x FROM e) SELECT id // {NODE} AS node, id, pos::INT AS pos, {BYTE} AS x FROM u")
def idbvecs_chunks(spark, sf_dir):
    """Byte vectors written and read with the node that each run of ids belongs to."""
    path = scratch(spark, "idbvecs")
    binary.write_vectors(bytes_of(items(spark, sf_dir)), path, "idbvecs")
    return binary.read_chunks(spark, path, NODE).select("node", "id", F.posexplode("vec").alias("pos", "x")).withColumn("x", F.col("x").cast("int"))


@query(f"{PCA_SQL} SELECT id, code FROM s")
def pca_model_file(spark, sf_dir):
    """Codes under a text model that was written and read again."""
    path = scratch(spark, "pca-model")
    spark.createDataFrame([(models.write_pca(PCA),)], "value string").coalesce(1).write.text(path)
    return models.read_pca(spark, path).signatures(items(spark, sf_dir)).select("id", F.get("sig", F.lit(0)).alias("code"))


ROWS32 = np.hstack([DIRECTIONS, ROTATION]).astype("<f4")
ROTATED32 = RotatedPCAHash(ROWS32[:, :DIM].astype(float), ROWS32[:, DIM:].astype(float))


@query(f"WITH {E_SQL}, {rows_sql('f', 'bit, a', [(k, numbers(a)) for k, a in enumerate(ROTATED32.directions)])} SELECT id, sum(CASE WHEN list_inner_product(v, a) > 0 THEN 1 << (7 - bit)::INT ELSE 0 END)::BIGINT AS code FROM e, f GROUP BY id")
def rotated_model_file(spark, sf_dir):
    """Codes under a binary model that was written and read again."""
    path = scratch(spark, "rotated-model")
    system, base = binary.place(path)
    with system.open_output_stream(base, compression=None) as out:
        out.write(np.array([3, 1, DIM, len(ROWS32), 0], "<i4").tobytes() + np.zeros(3, "<f4").tobytes() + ROWS32.tobytes())
    return models.read_rotated(path).signatures(items(spark, sf_dir)).select("id", F.get("sig", F.lit(0)).alias("code"))


@query(f"WITH {E_SQL}, o AS (SELECT row_number() OVER (ORDER BY id) - 1 AS id, v FROM e), u AS (SELECT id, unnest(range(0, len(v))) AS pos, unnest(v) AS x FROM o) SELECT id, pos::INT AS pos, round(x, 6) + 0.0 AS x FROM u")
def fvecs_to_idfvecs(spark, sf_dir):
    """Vectors without ids, numbered by position and written with ids."""
    path = scratch(spark, "fvecs")
    binary.write_vectors(items(spark, sf_dir).coalesce(1).sortWithinPartitions("id"), path, "fvecs")
    binary.convert(spark, path, path + "-ids")
    got = binary.read_vectors(spark, path + "-ids", dim=DIM).select("id", F.posexplode("vec").alias("pos", "x"))
    return rounded(got.withColumn("x", F.col("x").cast("double")), "x")


@query(f"WITH {T_SQL}, o AS (SELECT id, row_number() OVER (ORDER BY id) - 1 AS n FROM (SELECT DISTINCT id FROM s) QUALIFY n < 150) SELECT n AS id, idx, round(val::FLOAT::DOUBLE, 6) AS val FROM s JOIN o USING (id)")
def parse_ordinal(spark, sf_dir):
    """Sparse lines whose ids are ignored: numbered by place, the first 150 read."""
    path = scratch(spark, "ordinal")
    pairs = F.concat_ws(" ", F.transform("vec", lambda e: F.concat_ws(":", e["idx"].cast("string"), e["val"].cast("string"))))
    text.write_lines(sparse_items(spark, sf_dir).coalesce(1).sortWithinPartitions("id").select(F.concat_ws(" ", F.col("id").cast("string"), pairs).alias("line")), path)
    got = text.read_ordinal(spark, path, 150).select("id", F.explode("vec").alias("e"))
    return got.select("id", F.col("e.idx").alias("idx"), F.round(F.col("e.val").cast("double"), 6).alias("val"))


@query(f"{TOP_SQL} SELECT query_id, item_id, round(e2, 6) AS dist FROM r")
def parse_triplets(spark, sf_dir):
    """Triplet lines written and read again."""
    all_ = items(spark, sf_dir)
    path = scratch(spark, "triplets")
    text.write_lines(text.triplet_lines(search.linear_scan(asked(all_), all_, 20)), path)
    return text.read_triplets(spark, path)


SETTINGS = "# a job\nband = 4\nrow=3\n\nW = 20000\ninput = a=b\n"


@query("SELECT * FROM (VALUES ('band', '4'), ('row', '3'), ('W', '20000'), ('input', 'a=b')) t(name, value)")
def config_settings(spark, sf_dir):
    """A job's settings from their file."""
    path = scratch(spark, "config")
    spark.createDataFrame([(SETTINGS.rstrip("\n"),)], "value string").coalesce(1).write.text(path)
    read = "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())
    return spark.createDataFrame(list(config.parse_config(read, ("band", "row")).items()), "name string, value string")


@query(f"WITH {E_SQL} SELECT ' ' || array_to_string(list_transform(v, lambda x: {BYTE}), ' ') AS line FROM e")
def format_vectors(spark, sf_dir):
    """Vector lines."""
    return text.vector_lines(bytes_of(items(spark, sf_dir)))


@query(f"{PAIRS_SQL}, r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY ang, item_id) AS rank FROM p WHERE ang <= {RADIUS} AND query_id <> item_id) SELECT count(DISTINCT query_id)::VARCHAR || chr(9) || '{RADIUS}' AS line FROM r UNION ALL SELECT query_id::VARCHAR || chr(9) || string_agg(item_id::VARCHAR || chr(9) || {NUM.format('ang')}, chr(9) ORDER BY rank) AS line FROM r GROUP BY query_id")
def format_lshbox_radius(spark, sf_dir):
    """A truth file of a radius: all within it, nearest first."""
    all_ = items(spark, sf_dir)
    found = search.top_k(search.exact_radius(asked(all_), all_, RADIUS, exclude_self=True), 1 << 30)
    return text.truth_lines(saved(found, "truth"), RADIUS)


@query(f"WITH {E_SQL}, {rows_sql('f', 'bit, a', [(k, numbers(a)) for k, a in enumerate(SIGNS.T)])} SELECT id // {NODE} AS node, id::VARCHAR || ' ' || string_agg(CASE WHEN list_inner_product(v, a) >= 0 THEN '1' ELSE '0' END, ' ' ORDER BY bit) AS line FROM e, f GROUP BY id")
def format_codes(spark, sf_dir):
    """Code lines written in a folder per node, and read again."""
    all_ = items(spark, sf_dir)
    nodes = [r["node"] for r in learn.with_node(all_, NODE).select("node").distinct().collect()]
    path = scratch(spark, "codes")
    text.write_lines(text.code_lines(learn.dish_codes(all_, {n: SIGNS for n in nodes}, NODE), SIGNS.shape[1]), path, by="node")
    return spark.read.text(path).select(F.col("node").cast("long").alias("node"), F.col("value").alias("line"))


@query(f"WITH {E_SQL}, o AS (SELECT id, v FROM e ORDER BY (id * 1103515245 + 12345) % 2147483648, id LIMIT 50), u AS (SELECT id, unnest(range(0, len(v))) AS pos, unnest(v) AS x FROM o) SELECT id, pos::INT AS pos, round(x, 6) + 0.0 AS x FROM u")
def idfvecs_sample(spark, sf_dir):
    """An exact sample written as idfvecs and read again."""
    path = scratch(spark, "sample")
    binary.write_sample(items(spark, sf_dir), 50, path)
    got = binary.read_vectors(spark, path, dim=DIM).select("id", F.posexplode("vec").alias("pos", "x"))
    return rounded(got.withColumn("x", F.col("x").cast("double")), "x")
