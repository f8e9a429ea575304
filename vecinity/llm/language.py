"""Language identification: multinomial naive Bayes over hashed character n-grams.

Features are the 1- to 3-grams of code points of the lower-cased text (letters with their marks; runs of anything else are one blank), hashed into
DIMENSIONS buckets. Training counts buckets per language over labelled rows and smooths them; the log-probability
matrix (languages x DIMENSIONS, a fixed size) is broadcast, and batches are scored in numpy from sparse counts.

The prediction is the language of the highest likelihood. Its score is a tempered posterior: likelihoods are means per n-gram, so that long texts are
not certain by their length alone, times a temperature fitted on training rows; beside the languages stands the class of other texts, whose
likelihood lies MARGIN nats per n-gram below the mean of training rows, so a text in another script or of random letters has a low score for all languages.

MAX_PER_LANGUAGE is the documented bound of the training sample: per language about that many documents, those with the
smallest hash of their id; all are taken while there are fewer. Temperature and level of other texts are fitted on about CALIBRATION of them. Every text is scored as a whole.

Defined results: a null text or one without letters is `und` with score 0; a null language is not learned from; with nothing
to learn from every text is `und`; ties go to the language that sorts first; repeated rows get equal results; further columns
pass through, except those that this operator makes.
"""

from __future__ import annotations

import functools
import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from vecinity.llm.common import chunks, fresh, mix, released, text_bytes

DIMENSIONS = 1 << 16
ORDERS = (1, 2, 3)
MAX_PER_LANGUAGE = 4000
CALIBRATION = 250
MARGIN = 3.5
#: Characters of text whose n-grams are made at once.
TOGETHER = 1 << 20
ALPHA = 0.5

SPACE, LIMIT = 0x20, 0x110000


@functools.cache
def letters() -> np.ndarray:
    """Which code points belong to words: letters and the marks that go on them."""
    return np.frombuffer(bytes(unicodedata.category(chr(c))[0] in "LM" for c in range(LIMIT)), np.bool_)


def buckets(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The bucket of every n-gram and the row it stands in."""
    low = [t.lower() for t in texts]
    codes = np.frombuffer("".join(low).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    row = np.repeat(np.arange(len(low), dtype=np.int32), [len(t) for t in low])
    codes[~letters()[codes.astype(np.int64)]] = SPACE
    first = np.ones(len(row), bool)
    first[1:] = row[1:] != row[:-1]
    keep = (codes != SPACE) | first
    keep[1:] |= codes[:-1] != SPACE
    codes, row = codes[keep], row[keep]
    out, rows = [], []
    for n in ORDERS:
        m = len(codes) - n + 1
        if m <= 0:
            continue
        key = np.zeros(m, np.uint64)
        for k in range(n):
            key = (key << np.uint64(21)) | codes[k : k + m]
        whole = (row[:m] == row[n - 1 :]) & ((codes[:m] != SPACE) | (n > 1))
        out.append((mix(key[whole] * np.uint64(4) + np.uint64(n)) & np.uint64(DIMENSIONS - 1)).astype(np.int64))
        rows.append(row[:m][whole])
    return (np.concatenate(out), np.concatenate(rows)) if out else (np.zeros(0, np.int64), np.zeros(0, np.int32))


def has_letters(texts: list) -> np.ndarray:
    return np.array([t is not None and (any(map(str.isalpha, t[:400])) or any(map(str.isalpha, t))) for t in texts], bool)


def together(texts: list[str]):
    """Ranges of about TOGETHER characters; a longer text stands alone."""
    at, size = 0, 0
    for k, t in enumerate(texts):
        if k > at and size + len(t) > TOGETHER:
            yield at, k
            at, size = k, 0
        size += len(t)
    if at < len(texts):
        yield at, len(texts)


def likelihoods(texts: list[str], table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Mean log probability per n-gram of each text in each language (table: languages x DIMENSIONS), and the number of n-grams."""
    logs, sizes = np.zeros((len(texts), len(table))), np.zeros(len(texts), np.int64)
    for i, j in together(texts):
        bucket, row = buckets(texts[i:j])
        sizes[i:j] = np.bincount(row, minlength=j - i)
        for k, own in enumerate(table):
            logs[i:j, k] = np.bincount(row, own[bucket], j - i)
    return logs / np.maximum(sizes, 1)[:, None], sizes


def posterior(means: np.ndarray, temperature: float, level: float) -> np.ndarray:
    """Shares of the languages and, last, of other texts."""
    x = temperature * np.append(means, np.full((len(means), 1), level), 1)
    x = np.exp(x - x.max(1, keepdims=True))
    return x / x.sum(1, keepdims=True)


def fit(labelled: DataFrame, text: str, lang: str, key: str, most: int = MAX_PER_LANGUAGE) -> tuple[list[str], np.ndarray, float, float]:
    """Languages, sorted, log probabilities (priors are left out: whole texts outweigh them), the temperature and the level of other texts."""
    rows = labelled.select(F.col(f"`{lang}`").cast("string").alias("lang"), F.col(f"`{text}`").alias("text"), F.xxhash64(F.col(f"`{key}`")).alias("h")).where("lang is not null and text is not null")
    sizes = rows.groupBy("lang").count().collect()  # one row per language
    if not sizes:
        return [], np.zeros((0, DIMENSIONS), np.float32), 1.0, 0.0

    def share(of):
        out = F.lit(None)
        for r in sizes:
            out = F.when(F.col("lang") == r["lang"], F.lit(of / r["count"])).otherwise(out)
        return F.pmod("h", F.lit(1 << 30)) < out * float(1 << 30)

    sample = rows.where(share(most)).select("lang", "text")

    @released
    def count(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            langs, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for name in set(langs):
                own = [t for t, x in zip(texts, langs) if x == name]
                for i, j in together(own):
                    sums[name] = sums.get(name, 0) + np.bincount(buckets(own[i:j])[0], minlength=DIMENSIONS)
        for name, counts in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array([name]), pa.array([counts.astype("<i8").tobytes()], pa.binary())], ["lang", "counts"])

    def add(key, table):
        total = sum(np.frombuffer(x, "<i8") for x in table.column("counts").to_pylist())
        return pa.table({"lang": [key[0].as_py()], "counts": pa.array([total.tobytes()], pa.binary())})

    # A row is one task's counts: 0.5 MB each, at most one per task and language, summed by language and slice of tasks first.
    partial = sample.mapInArrow(count, "lang string, counts binary")
    summed = partial.withColumn("slice", F.spark_partition_id() % 16).groupBy("lang", "slice").applyInArrow(lambda k, t: add(k, t), "lang string, counts binary")
    found: dict[str, np.ndarray] = {}
    for r in summed.collect():  # at most 16 rows a language
        found[r["lang"]] = found.get(r["lang"], 0) + np.frombuffer(r["counts"], "<i8")
    names = sorted(found)
    matrix = np.stack([np.log((found[n] + ALPHA) / (found[n].sum() + ALPHA * DIMENSIONS)) for n in names]).astype(np.float32)
    return names, matrix, *calibrated(rows.where(share(min(most, CALIBRATION))).select("lang", "text"), names, matrix)


def calibrated(sample: DataFrame, names: list[str], matrix: np.ndarray) -> tuple[float, float]:
    """The temperature under which the sample's languages are likeliest, and the level of other texts."""
    shared = sample.sparkSession.sparkContext.broadcast(matrix.astype(float))

    @released
    def run(batches):
        for batch in batches:
            means, sizes = likelihoods(batch.column(1).to_pylist(), shared.value)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([m.tobytes() for m in means], pa.binary()), pa.array(sizes)], ["lang", "means", "n"])

    rows = sample.mapInArrow(run, "lang string, means binary, n long").where("n > 0").collect()  # about CALIBRATION rows a language
    if not rows:
        return 1.0, -np.log(DIMENSIONS) - MARGIN
    means, of = np.stack([np.frombuffer(r["means"]) for r in rows]), np.array([names.index(r["lang"]) for r in rows])
    own = means[np.arange(len(of)), of]
    level = float(min(own[of == k].mean() for k in np.unique(of)) - MARGIN)
    grid = np.geomspace(0.5, 64, 60)
    return float(grid[np.argmax([np.log(np.maximum(posterior(means, t, level)[np.arange(len(of)), of], 1e-300)).sum() for t in grid])]), level


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray, float, float], text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns keep of docs (all by default), lang_pred string and score double."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")]
    kept = [F.col(f"`{c}`") for c in keep]
    # A text that is kept is sent to the workers once.
    at = keep.index(text) if text in keep else len(keep)
    source = docs.select(*kept, *([] if text in keep else [F.col(f"`{text}`").alias(*fresh([*keep, "lang_pred", "score"], "whole_text"))]))
    schema = StructType([*source.schema.fields[: len(keep)], StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    shared = docs.sparkSession.sparkContext.broadcast((model[0], model[1].astype(float), model[2:]))

    @released
    def run(batches):
        names, table, fitted = shared.value
        for batch in batches:
            column = batch.column(at)
            known, best, score = np.zeros(len(column), bool), np.zeros(len(column), np.int64), np.zeros(len(column))
            for i, j in chunks(text_bytes(column)[1], TOGETHER):
                texts = column.slice(i, j - i).to_pylist()
                known[i:j] = has_letters(texts) & bool(names)
                if known[i:j].any():
                    means, _ = likelihoods([t or "" for t in texts], table)
                    best[i:j] = means.argmax(1)
                    score[i:j] = posterior(means, *fitted)[np.arange(j - i), best[i:j]]
            preds = [names[b] if k else "und" for b, k in zip(best, known)]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(preds, pa.string()), pa.array(np.where(known, score, 0.0))], [*batch.schema.names[: len(keep)], "lang_pred", "score"])

    return source.mapInArrow(run, schema)


def held_out(key: Column, parts: int, part: int) -> Column:
    """Whether a row's crc32 of its id as text leaves the remainder part; a null id counts as the empty string."""
    return (F.crc32(F.coalesce(key.cast("string"), F.lit(""))) % parts == part).cast(BooleanType())
