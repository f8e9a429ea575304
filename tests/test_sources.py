import numpy as np
import pytest
from pyspark.sql import functions as F

from vecinity.operators.families import PCAHash
from vecinity.plans.config import parse_config
from vecinity.sources import binary, models, text


@pytest.mark.parametrize("kind", ["idfvecs", "fvecs", "idbvecs"])
def test_binary_round_trip(spark, tmp_path, kind, monkeypatch):
    element = "smallint" if kind == "idbvecs" else "float"
    df = spark.createDataFrame([(i, [i % 200, (i * 7) % 200, 1]) for i in range(50)], "id long, vec array<int>").selectExpr("id", f"cast(vec as array<{element}>) vec").coalesce(1)
    path = str(tmp_path / "v")
    assert binary.write_vectors(df, path, kind).first()["records"] == 50
    monkeypatch.setattr(binary, "RANGE", 160)
    got = binary.read_vectors(spark, path, kind, dim=3)
    assert sorted((r["id"], [int(x) for x in r["vec"]]) for r in got.collect()) == [(i, [i % 200, (i * 7) % 200, 1]) for i in range(50)]
    with pytest.raises(Exception, match="true"):
        binary.read_vectors(spark, path, kind, dim=4).collect()


def test_chunks_have_nodes(spark, tmp_path):
    rows = np.zeros(6, binary.layout("idbvecs", 2))
    rows["id"], rows["dim"] = np.arange(6), 2
    (tmp_path / "b").write_bytes(rows.tobytes())
    assert sorted(r["node"] for r in binary.read_chunks(spark, str(tmp_path / "b"), 2).collect()) == [0, 0, 1, 1, 2, 2]


def test_idlibsvm_modes(spark):
    lines = spark.createDataFrame([("7 2:1.5 1:0.5",), ("8\t3:1",), ("bad",), ("9 x:1",), ("",), (None,)], "value string")
    got = text.parse_idlibsvm(lines).collect()
    assert [(r["id"], [tuple(e) for e in r["vec"]]) for r in got] == [(7, [(1, 0.5), (2, 1.5)]), (8, [(3, 1.0)])]
    with pytest.raises(Exception, match="malformed"):
        text.parse_idlibsvm(lines, mode="failfast").collect()


def test_records_of_a_format_of_ones_own(spark):
    lines = spark.createDataFrame([("1|a",), ("x|b",), ("2|c",), (None,), ("3",)], "value string")
    parser = lambda line: (int(line.split("|")[0]), line.split("|")[1])
    assert sorted(tuple(r) for r in text.parse_records(lines, parser, "id long, name string").collect()) == [(1, "a"), (2, "c")]
    with pytest.raises(Exception, match="invalid literal|split"):
        text.parse_records(lines, parser, "id long, name string", mode="failfast").collect()
    column = lambda c: F.when(F.split_part(c, F.lit("|"), F.lit(1)).try_cast("long").isNotNull(), F.struct(F.split_part(c, F.lit("|"), F.lit(1)).cast("long").alias("id"), F.split_part(c, F.lit("|"), F.lit(2)).alias("name")))
    assert sorted(tuple(r) for r in text.parse_records(lines, column, "id long, name string", column=True).collect()) == [(1, "a"), (2, "c"), (3, "")]


def test_ordinals_of_a_file_read_in_ranges(spark, tmp_path):
    (tmp_path / "f").write_text("".join(f"{900 + k} {k}:1.0\n" for k in range(500)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "700b")
    try:
        got = text.read_ordinal(spark, str(tmp_path / "f"), 400).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert sorted((r["id"], r["vec"][0]["idx"]) for r in got) == [(k, k) for k in range(400)]


def test_writing_again_leaves_nothing_of_the_run_before(spark, tmp_path):
    df = spark.range(40).selectExpr("id", "array(cast(id as float)) vec")
    binary.write_vectors(df.repartition(4), str(tmp_path / "v"))
    binary.write_vectors(df.where("id < 3").coalesce(1), str(tmp_path / "v"))
    assert binary.read_vectors(spark, str(tmp_path / "v")).count() == 3


def test_scratch_is_discarded(spark):
    import os

    from vecinity.plans.lineage import discard, saved
    from vecinity.plans.timer import Timer

    table = saved(spark.range(3), "x")
    assert table.count() == 3 and table.scratch_path.startswith("file:///")
    discard(table)
    assert not os.path.exists(table.scratch_path[7:])
    timer = Timer()
    assert timer.mark("one") >= 0 and timer.total >= timer.phases[0][1]


def test_truth_and_graph_files(spark, tmp_path):
    (tmp_path / "t").write_text("2\t2\n5\t5\t0\t6\t1.5\n7\t7\t0\t5\t2.5\n")
    assert sorted(tuple(r) for r in text.read_truth(spark, str(tmp_path / "t"), drop_self=True).collect()) == [(5, 1, 6, 1.5), (7, 1, 5, 2.5)]
    (tmp_path / "g").write_text("1 2 0.5 3 0.7\n")
    assert sorted(tuple(r) for r in text.read_graph(spark, str(tmp_path / "g"), both_ways=True).collect()) == [(1, 2, 0.5), (1, 3, 0.7), (2, 1, 0.5), (3, 1, 0.7)]
    text.write_lines(text.triplet_lines(spark.createDataFrame([(1, 2, 0.25)], "query_id long, item_id long, dist double")), str(tmp_path / "q"))
    assert [tuple(r) for r in text.read_triplets(spark, str(tmp_path / "q")).collect()] == [(1, 2, 0.25)]


def test_code_and_vector_lines(spark):
    codes = spark.createDataFrame([(0, 3, 5)], "node long, id long, code long")
    assert text.code_lines(codes, 4).first()["line"] == "3 0 1 0 1"
    assert text.vector_lines(spark.createDataFrame([(1, [1.0, 2.5])], "id long, vec array<double>")).first()["line"] == " 1.0 2.5"


def test_pca_model_text():
    family = PCAHash(np.array([0.5, -1.0, 2.0]), np.arange(12.0).reshape(2, 2, 3))
    again = models.parse_pca(models.write_pca(family))
    assert np.allclose(again.mean, family.mean) and np.allclose(again.components, family.components)
    with pytest.raises(ValueError):
        models.parse_pca("1 2 2 0 0\n1 2\n3")


def test_rotated_model_file(tmp_path):
    rows = np.hstack([np.eye(3, 4), np.eye(3)]).astype("<f4")
    head = np.array([2, 1, 4, 3, 5], "<i4").tobytes() + np.zeros(2, "<f4").tobytes()
    (tmp_path / "m").write_bytes(head + rows.tobytes())
    family = models.read_rotated(str(tmp_path / "m"))
    assert np.allclose(family.directions, np.eye(3, 4))


def test_config():
    assert parse_config("# x\na = 1\nb=2=3\n", ("a",)) == {"a": "1", "b": "2=3"}
    with pytest.raises(KeyError):
        parse_config("a=1", ("z",))
