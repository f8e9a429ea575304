"""Toxicity: logistic regression on hashed words and word stems, regularised by counterfactuals.

Features are the presence of words and of their first 4, 5 and 6 bytes, hashed into DIMENSIONS. Of these the most telling (by the z-score
of their rates among toxic and other rows, at least MIN_Z) are kept, at most FEATURES. The loss adds, for every sentence of
the sample that names a group, PENALTY times the squared change of its log-odds when the identity term is swapped for another one or for
a neutral word: weights that would make a group's mention toxic are driven out.

MAX_LABELLED is the documented bound of the training sample: about that many labelled rows, those whose ids have the smallest hashes; all while
there are fewer. Scoring reads every text as a whole.

Defined results: null and empty texts get the score of the bias alone; without labels of both kinds every score is the
smoothed rate of label 1; null labels and null ids aren't learned from; a label given twice counts twice; repeated rows get equal
scores; an empty table gives an empty table; further columns pass through, except score and predicted, which this operator makes.
"""

from __future__ import annotations

import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from vecinity.llm.common import ALNUM, LOWER, U, chunks, fresh, mix, text_bytes, words

DIMENSIONS = 1 << 18
STEMS = (4, 5, 6)
MAX_LABELLED = 12_000
FEATURES = 4096
MIN_Z = 4.0
RIDGE = 1e-4
PENALTY = 1.0
#: Identity terms: fixed values.
IDENTITIES = "women men girls boys woman man gay lesbian straight transgender muslim christian jewish hindu buddhist atheist muslims christians jews black white asian african american european mexican arab chinese indian immigrant immigrants refugee refugees disabled deaf blind old young".split()
NEUTRAL = "people"


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct feature numbers of each row, and the row of each."""
    hashes, first, last, at = words(data, offsets, ALNUM)
    row = np.repeat(np.arange(len(offsets) - 1), np.diff(at))
    size = last - first
    found, rows = [hashes], [row]
    low = LOWER[data]
    for k in STEMS:
        pick = np.flatnonzero(size > k)
        key = np.full(len(pick), k, U)
        for b in range(k):
            key = (key << U(8)) | low[first[pick] + b].astype(U)
        found.append(mix(key))
        rows.append(row[pick])
    code = np.unique((np.concatenate(rows).astype(U) << U(18)) | (np.concatenate(found) & U(DIMENSIONS - 1)))
    return (code & U(DIMENSIONS - 1)).astype(np.int64), (code >> U(18)).astype(np.int64)


def of_text(text: str) -> np.ndarray:
    return features(*text_bytes(pa.array([text], pa.string())))[0]


TERM = re.compile(rf"\b({'|'.join(sorted(IDENTITIES, key=len, reverse=True))})\b", re.I)


def swaps(text: str) -> list[tuple[np.ndarray, np.ndarray]]:
    """Features of all sentences that name a group and of the same with another term, dealt over all terms by a hash of the sentence."""
    out = []
    if TERM.search(text):
        for sentence in (s for s in re.split(r"[.!?\n]+", text) if TERM.search(s)):
            own = of_text(sentence)
            for other in (NEUTRAL, substitute(sentence)):
                out.append((own, of_text(TERM.sub(other, sentence))))
    return out


def substitute(sentence: str) -> str:
    """The term that takes the place of those of a sentence; not one that stands in it unless all do."""
    k = zlib.crc32(sentence.encode("utf-8", "surrogatepass"))
    named = {t.lower() for t in TERM.findall(sentence)}
    free = [t for t in IDENTITIES if t not in named] or IDENTITIES
    return free[k % len(free)]


class Model:
    def __init__(self, picked: np.ndarray, weights: np.ndarray, bias: float):
        self.slot = np.full(DIMENSIONS, len(picked), np.int64)
        self.slot[picked] = np.arange(len(picked))
        self.weights, self.bias = np.append(weights, 0.0), bias

    def score(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        code, row = features(data, offsets)
        x = self.bias + np.bincount(row, self.weights[self.slot[code]], len(offsets) - 1)
        return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


def learn(rows: list[np.ndarray], labels: np.ndarray, pairs: list[tuple[np.ndarray, np.ndarray]], rounds: int = 300) -> Model:
    """Fits the model; rows and pairs hold feature numbers."""
    y = labels.astype(float)
    n1, n0 = float(y.sum()), float(len(y) - y.sum())
    if not n1 or not n0:
        rate = (n1 + 0.5) / (n1 + n0 + 1)
        return Model(np.zeros(0, np.int64), np.zeros(0), float(np.log(rate / (1 - rate))))
    code = np.concatenate(rows)
    of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
    a = np.bincount(code, y[of], DIMENSIONS)
    b = np.bincount(code, 1 - y[of], DIMENSIONS)
    pa_, pb = (a + 0.5) / (n1 + 1), (b + 0.5) / (n0 + 1)
    z = np.abs(pa_ - pb) / np.sqrt(pa_ * (1 - pa_) / n1 + pb * (1 - pb) / n0 + 1e-12)
    z[a + b < 3] = 0
    picked = np.argsort(-z, kind="stable")[:FEATURES]
    picked = np.sort(picked[z[picked] >= MIN_Z])
    slot = np.full(DIMENSIONS, -1)
    slot[picked] = np.arange(len(picked))
    keep = slot[code] >= 0
    code, of, m = slot[code[keep]], of[keep], len(picked)
    # The change of log-odds by a swap is linear in the weights: sparse rows with +1 and -1.
    cols, sign, who = [], [], []
    for k, (own, other) in enumerate(pairs):
        for x, s in ((own, -1.0), (other, 1.0)):
            x = slot[x]
            x = x[x >= 0]
            cols.append(x)
            sign.append(np.full(len(x), s))
            who.append(np.full(len(x), k))
    cols, sign, who = (np.concatenate(x) if x else np.zeros(0, t) for x, t in ((cols, np.int64), (sign, float), (who, np.int64)))
    # Label 1 is rare: it weighs more by the fourth root of the ratio.
    weight = np.where(y > 0, max(1.0, (n0 / n1) ** 0.25), 1.0)
    weight /= weight.sum()
    w, bias = np.zeros(m), float(np.log(n1 / n0))
    first, second, t = np.zeros(m + 1), np.zeros(m + 1), 0
    for t in range(1, rounds + 1):
        x = bias + np.bincount(of, w[code], len(y))
        error = (1 / (1 + np.exp(-np.clip(x, -500, 500))) - y) * weight
        step = np.append(np.bincount(code, error[of], m) + RIDGE * w, error.sum())
        if len(cols):
            change = np.bincount(who, sign * w[cols], len(pairs))
            step[:m] += PENALTY * np.bincount(cols, sign * change[who], m) / len(pairs)
        first, second = 0.9 * first + 0.1 * step, 0.99 * second + 0.01 * step**2
        move = 0.1 * (first / (1 - 0.9**t)) / (np.sqrt(second / (1 - 0.99**t)) + 1e-8)
        w, bias = w - move[:m], bias - move[m]
    return Model(picked, w, float(bias))


def fit(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id", label: str = "toxic", most: int = MAX_LABELLED) -> Model:
    """Learns from the rows of labels (already without held-out ones) and their texts."""
    told = labels.select(F.col(f"`{key}`").alias("k"), F.col(f"`{label}`").cast("int").alias("y")).where("k is not null and y in (0, 1)")
    n = told.count()
    told = told.where(F.pmod(F.xxhash64("k", F.lit(8)), F.lit(1 << 30)) < F.lit(min(1.0, most / max(n, 1)) * (1 << 30)))
    # At most about MAX_LABELLED rows of two numbers: a broadcast of a proven size.
    sample = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t")).join(F.broadcast(told), "k").select("t", "y")

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(0))
            texts = batch.column(0).to_pylist()
            for i, j in chunks(offsets):
                code, row = features(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
                ends = np.searchsorted(row, np.arange(j - i + 1))
                x = [code[ends[r] : ends[r + 1]].astype("<u4").tobytes() for r in range(j - i)]
                p = [[f.astype("<u4").tobytes() for pair in swaps(texts[i + r] or "") for f in pair] for r in range(j - i)]
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.binary()), batch.column(1).slice(i, j - i), pa.array(p, pa.list_(pa.binary()))], ["x", "y", "p"])

    rows = sample.mapInArrow(run, "x binary, y int, p array<binary>").collect()
    rows.sort(key=lambda r: (r["x"], r["y"]))
    number = lambda x: np.frombuffer(x, "<u4").astype(np.int64)
    pairs = [(number(r["p"][k]), number(r["p"][k + 1])) for r in rows for k in range(0, len(r["p"]), 2)]
    return learn([number(r["x"]) for r in rows], np.array([r["y"] for r in rows]), pairs)


def score(docs: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """The columns keep of docs (all by default), score double and predicted int."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in ("score", "predicted")]
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias(*fresh([*keep, "score", "predicted"], "whole_text")))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(len(keep)))
            out = [shared.value.score(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]) for i, j in chunks(offsets)]
            out = np.concatenate(out) if out else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(out), pa.array((out >= 0.5).astype(np.int32))], [*keep, "score", "predicted"])

    return source.mapInArrow(run, StructType([*source.schema.fields[:-1], StructField("score", DoubleType()), StructField("predicted", IntegerType())]))
