"""Text formats of vectors, answers, truth and graphs, read and written with DataFrame functions."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def parse_idlibsvm(lines: DataFrame, line: str = "value", mode: str = "permissive") -> DataFrame:
    """(id, vec) of lines `id idx:val idx:val ...`, vec ascending by idx. A malformed line is dropped, or fails with mode failfast."""
    parts = F.split(F.trim(F.col(line)), r"[ \t]+")
    pairs = F.transform(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(0))), lambda x: F.struct(F.split_part(x, F.lit(":"), F.lit(1)).try_cast("int").alias("idx"), F.split_part(x, F.lit(":"), F.lit(2)).try_cast("float").alias("val")))
    got = lines.select(F.get(parts, F.lit(0)).try_cast("long").alias("id"), F.array_sort(pairs).alias("vec"))
    good = F.col("id").isNotNull() & (F.size("vec") > 0) & ~F.exists("vec", lambda e: e["idx"].isNull() | e["val"].isNull())
    if mode == "failfast":
        return got.where(F.assert_true(F.coalesce(good, F.lit(False)), F.lit("malformed idlibsvm line")).isNull())
    return got.where(good)


def read_idlibsvm(spark: SparkSession, path: str, mode: str = "permissive") -> DataFrame:
    return parse_idlibsvm(spark.read.text(path), mode=mode)


def parse_records(lines: DataFrame, parser: Callable[[str], tuple] | Callable[[Column], Column], schema: str, line: str = "value", mode: str = "permissive", column: bool = False) -> DataFrame:
    """Records of a format of one's own. parser: a function of a line to a tuple of schema's fields, or with `column` of a column to a struct of them.

    A record whose parser fails (or gives null) is dropped, or with mode failfast an error."""
    if column:
        made = lines.select(parser(F.col(line)).alias("r"))
        made = made.where(F.assert_true(F.col("r").isNotNull(), F.lit("malformed record")).isNull()) if mode == "failfast" else made.where("r is not null")
        return made.select("r.*")
    kind = StructType.fromDDL(schema)

    def run(batches):
        from pyspark.sql.pandas.types import to_arrow_schema

        arrow = to_arrow_schema(kind)
        for batch in batches:
            rows = []
            for x in batch.column(0).to_pylist():
                try:
                    rows.append(parser(x))
                except Exception:
                    if mode == "failfast":
                        raise
            rows = [r for r in rows if r is not None]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(arrow)], schema=arrow)

    return lines.select(F.col(line)).mapInArrow(run, kind)


def with_ordinal(df: DataFrame, name: str = "ordinal") -> DataFrame:
    """Rows numbered from 0 in the order of the table's partitions (of one file: of its lines). Counts of partitions come first, a number each."""
    marked = df.withColumn("__at", F.monotonically_increasing_id())
    sizes = sorted((r[0], r[1]) for r in marked.groupBy(F.shiftright("__at", 33).alias("p")).agg(F.count(F.lit(1)).alias("n")).collect())
    before, told = 0, []
    for p, n in sizes:
        told.append((p, before))
        before += n
    starts = df.sparkSession.createDataFrame(told, "__p long, __before long")
    placed = marked.withColumn("__p", F.shiftright("__at", 33)).join(F.broadcast(starts), "__p")  # a row per partition
    return placed.withColumn(name, F.col("__before") + F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))).select(*[F.col(f"`{c}`") for c in df.columns], name)


def read_ordinal(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """(id, vec) of an idlibsvm file whose first token is ignored: ids are the lines' numbers from 0; with `most` only the first so many."""
    lines = with_ordinal(spark.read.text(path))
    lines = lines if most is None else lines.where(F.col("ordinal") < most)
    numbered = lines.select(F.concat_ws(" ", F.col("ordinal").cast("string"), F.regexp_replace("value", r"^\s*\S+", "")).alias("value"))
    return parse_idlibsvm(numbered)


def parse_pairs(lines: DataFrame, first: str, second: str, line: str = "value") -> DataFrame:
    """(first, rank, second, dist) of lines `q i d i d ...`; a line with two tokens or fewer (a header) is skipped. rank starts at 1."""
    parts = F.split(F.trim(F.col(line)), r"[ \t]+")
    pairs = F.transform(F.sequence(F.lit(1), F.floor((F.size(parts) - 1) / 2).cast("int")), lambda k: F.struct(F.get(parts, 2 * k - 1).cast("long").alias("i"), F.get(parts, 2 * k).cast("double").alias("d")))
    rows = lines.where(F.size(parts) > 2).select(F.get(parts, F.lit(0)).cast("long").alias(first), F.posexplode(pairs).alias("rank", "e"))
    return rows.select(first, (F.col("rank") + 1).cast("int").alias("rank"), F.col("e.i").alias(second), F.col("e.d").alias("dist"))


def read_truth(spark: SparkSession, path: str, drop_self: bool = False) -> DataFrame:
    """(query_id, rank, item_id, dist) of an lshbox file; drop_self leaves each line's first pair (the query itself) out."""
    got = parse_pairs(spark.read.text(path), "query_id", "item_id")
    return got.where("rank > 1").withColumn("rank", F.col("rank") - 1) if drop_self else got


def read_graph(spark: SparkSession, path: str, both_ways: bool = False) -> DataFrame:
    """(src, dst, dist) of lines `q i d i d ...`."""
    edges = parse_pairs(spark.read.text(path), "src", "dst").select("src", "dst", "dist")
    return edges.unionAll(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"), "dist")) if both_ways else edges


def read_triplets(spark: SparkSession, path: str) -> DataFrame:
    """(query_id, item_id, dist) of lines `q i d`."""
    return spark.read.csv(path, sep=" ", schema="query_id long, item_id long, dist double")


def number(x: Column) -> Column:
    """A distance as text with six places."""
    return F.round(x, 6).cast("decimal(18,6)").cast("string")


def triplet_lines(answers: DataFrame) -> DataFrame:
    """(line): `q i d`."""
    return answers.select(F.concat_ws(" ", F.col("query_id").cast("string"), F.col("item_id").cast("string"), number(F.col("dist"))).alias("line"))


def pair_lines(ranked: DataFrame, sep: str = " ") -> DataFrame:
    """(line): `q i d i d ...`, one line per query by rank; ranked has at most k rows a query."""
    pair = F.struct("rank", F.concat_ws(sep, F.col("item_id").cast("string"), number(F.col("dist"))).alias("p"))
    by = ranked.groupBy("query_id").agg(F.array_sort(F.collect_list(pair)).alias("ps"))
    return by.select(F.concat_ws(sep, F.col("query_id").cast("string"), F.concat_ws(sep, F.transform("ps", lambda x: x["p"]))).alias("line"))


def truth_lines(ranked: DataFrame, k: int | float) -> DataFrame:
    """(line): an lshbox file's header, `queries k` or `queries radius`, and its rows, parted by tabs."""
    head = ranked.agg(F.countDistinct("query_id").alias("n")).select(F.concat_ws("\t", F.col("n").cast("string"), F.lit(str(k))).alias("line"))
    return head.unionAll(pair_lines(ranked, "\t"))


def vector_lines(items: DataFrame) -> DataFrame:
    """(line): the elements of each vector, each after a blank."""
    return items.select(F.concat(F.lit(" "), F.concat_ws(" ", F.transform("vec", lambda x: x.cast("string")))).alias("line"))


def code_lines(codes: DataFrame, bits: int) -> DataFrame:
    """(node, line): `id b0 b1 ...` of packed codes."""
    digits = F.transform(F.split(F.lpad(F.bin("code"), bits, "0"), ""), lambda x: x)
    return codes.select("node", F.concat_ws(" ", F.col("id").cast("string"), F.concat_ws(" ", digits)).alias("line"))


def write_lines(lines: DataFrame, path: str, by: str | None = None) -> None:
    """Lines as text files, one per task; by names a column that becomes folders."""
    (lines.write.partitionBy(by) if by else lines.write).text(path)
