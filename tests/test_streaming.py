import numpy as np

from vecinity.operators.families import SimHash
from vecinity.operators.search import lsh_join
from vecinity.streaming.search import stream_search


def test_stream_gives_what_a_batch_gives(spark, tmp_path):
    x = np.random.default_rng(1).standard_normal((40, 6))
    items = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, vec array<double>")
    items.where("id < 10").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(items.schema).parquet(str(tmp_path / "in"))
    family = SimHash(3, 3, 6, 1)
    stream_search(stream, items, family, str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination(120)
    got = {(r["query_id"], r["item_id"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == {(r["query_id"], r["item_id"]) for r in lsh_join(items.where("id < 10"), items, family).collect()}
