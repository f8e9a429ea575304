"""Fixed-width binary vector files as a Spark data source: idfvecs, fvecs and idbvecs.

idfvecs: int32 id, int32 dim, dim x float32; fvecs: int32 dim, dim x float32, ids by position; idbvecs: int32 id, int32 dim, dim x uint8. All
little-endian. A file is cut at record borders into byte ranges, one partition each; a range becomes Arrow batches
without a Python loop over records. Paths may be addresses of any store that pyarrow knows (file:, hdfs:, s3:, gs:).
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from vecinity.operators.aggregates import sample_exact
from vecinity.plans.lineage import qualified

RANGE = 64 << 20
BATCH = 65536
FORMATS = {"idfvecs": (True, "<f4"), "fvecs": (False, "<f4"), "idbvecs": (True, "u1")}


def layout(kind: str, dim: int) -> np.dtype:
    """The numpy record of a format."""
    has_id, element = FORMATS[kind]
    return np.dtype(([("id", "<i4")] if has_id else []) + [("dim", "<i4"), ("vec", element, (dim,))])


def place(path: str):
    return fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (fs.LocalFileSystem(), path)


def files(path: str) -> list[tuple[str, int]]:
    """Data files at a path with their sizes, by name."""
    system, base = place(path)
    info = system.get_file_info(base)
    if info.type == fs.FileType.File:
        return [(base, info.size)]
    found = system.get_file_info(fs.FileSelector(base, recursive=True))
    return sorted((f.path, f.size) for f in found if f.type == fs.FileType.File and f.base_name[0] not in "._")


class Span(InputPartition):
    def __init__(self, path: str, start: int, end: int, first: int):
        super().__init__((path, start, end, first))


class VectorReader(DataSourceReader):
    def __init__(self, kind: str, path: str):
        self.kind, self.path = kind, path
        system, _ = place(path)
        self.found = [(p, n) for p, n in files(path) if n]
        self.dim = 0
        if self.found:
            at = 4 if FORMATS[kind][0] else 0
            with system.open_input_file(self.found[0][0]) as f:
                f.seek(at)
                self.dim = int(np.frombuffer(f.read(4), "<i4")[0])

    def partitions(self):
        out, first, width = [], 0, layout(self.kind, self.dim).itemsize
        for path, size in self.found:
            if size % width:
                raise ValueError(f"{path}: {size} bytes are not records of {width}")
            step = max(1, RANGE // width) * width
            for start in range(0, size, step):
                end = min(size, start + step)
                out.append(Span(path, start, end, first))
                first += (end - start) // width
        return out

    def read(self, partition):
        path, start, end, first = partition.value
        kind = layout(self.kind, self.dim)
        system, _ = place(self.path)
        with system.open_input_file(path) as f:
            f.seek(start)
            while start < end:
                rows = np.frombuffer(f.read(min(end - start, BATCH * kind.itemsize)), kind)
                start += len(rows) * kind.itemsize
                if (rows["dim"] != self.dim).any():
                    raise ValueError(f"{path}: vectors of different dimension")
                ids = rows["id"].astype(np.int64) if FORMATS[self.kind][0] else np.arange(first, first + len(rows))
                first += len(rows)
                flat = np.ascontiguousarray(rows["vec"]).reshape(-1)
                flat = pa.array(flat.astype(np.float32) if flat.dtype != np.uint8 else flat.astype(np.int16))
                vec = pa.ListArray.from_arrays(pa.array(np.arange(0, len(rows) * self.dim + 1, max(self.dim, 1), dtype=np.int32)[: len(rows) + 1]), flat)
                yield pa.RecordBatch.from_arrays([pa.array(ids), vec], ["id", "vec"])


class VectorSource(DataSource):
    """spark.read.format(one of FORMATS).load(path): id long, vec array."""

    kind = "idfvecs"

    @classmethod
    def name(cls):
        return cls.kind

    def schema(self):
        return "id long, vec array<smallint>" if self.kind == "idbvecs" else "id long, vec array<float>"

    def reader(self, schema):
        return VectorReader(self.kind, self.options["path"])


class FvecsSource(VectorSource):
    kind = "fvecs"


class IdbvecsSource(VectorSource):
    kind = "idbvecs"


def register(spark: SparkSession) -> None:
    """Makes the formats known to spark.read."""
    for source in (VectorSource, FvecsSource, IdbvecsSource):
        spark.dataSource.register(source)


def read_vectors(spark: SparkSession, path: str, kind: str = "idfvecs", dim: int | None = None) -> DataFrame:
    """Vectors of a file or folder; with dim, any other dimension is an error."""
    register(spark)
    df = spark.read.format(kind).load(qualified(spark, path))
    return df if dim is None else df.where(F.assert_true(F.size("vec") == dim).isNull())


def read_chunks(spark: SparkSession, path: str, per_node: int, kind: str = "idbvecs") -> DataFrame:
    """(node, id, vec): consecutive ids belong to one node."""
    return read_vectors(spark, path, kind).withColumn("node", F.floor(F.col("id") / per_node).cast("long"))


def clear(path: str, kind: str) -> None:
    """Deletes the files of an earlier run in a folder."""
    system, base = place(path)
    for f in system.get_file_info(fs.FileSelector(base, allow_not_found=True)):
        if f.base_name.endswith(f".{kind}") and f.base_name.startswith("part-"):
            system.delete_file(f.path)


def write_vectors(df: DataFrame, path: str, kind: str = "idfvecs") -> DataFrame:
    """(id, vec) as one file per task below path, written in the order of ids if df is sorted; returns (file, records). What the folder held before goes."""
    spark = df.sparkSession
    path = qualified(spark, path)
    clear(path, kind)

    def run(batches):
        from pyspark import TaskContext

        t, n, out = TaskContext.get(), 0, None
        system, base = place(path)
        system.create_dir(base, recursive=True)
        name, hidden = f"part-{t.partitionId():06d}.{kind}", f"_{t.partitionId():06d}-{t.taskAttemptId()}"
        for batch in batches:
            if not len(batch):
                continue
            vec = batch.column(1)
            flat = vec.flatten().to_numpy(zero_copy_only=False).reshape(len(batch), -1)
            rows = np.zeros(len(batch), layout(kind, flat.shape[1]))
            if FORMATS[kind][0]:
                rows["id"] = np.asarray(batch.column(0))
            rows["dim"], rows["vec"] = flat.shape[1], flat
            out = out or system.open_output_stream(f"{base}/{hidden}", compression=None)
            out.write(rows.tobytes())
            n += len(batch)
        if out:
            out.close()
            system.move(f"{base}/{hidden}", f"{base}/{name}")  # a lost attempt leaves a hidden file that readers skip
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([n], pa.int64())], ["file", "records"])

    rows = df.select(F.col("id").cast("long"), "vec").mapInArrow(run, "file string, records long").collect()  # a row per task
    return spark.createDataFrame([tuple(r) for r in rows], "file string, records long")


def convert(spark: SparkSession, path: str, to: str) -> DataFrame:
    """A fvecs file as idfvecs, ids by position; returns (file, records)."""
    return write_vectors(read_vectors(spark, path, "fvecs"), to)


def write_sample(items: DataFrame, n: int, path: str, seed: int = 0) -> DataFrame:
    """An exact sample of n items as idfvecs; returns (file, records)."""
    return write_vectors(sample_exact(items.select("id", "vec"), "id", n, seed), path)
