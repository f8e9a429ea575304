"""Fingerprints by a randomised edit embedding: shared random walks over characters.

At step j a walk stands at a character c, and goes on to the next one if the random bit of (j, c) says so; all texts share the bits. The
sequence of characters seen embeds edit distance into Hamming distance: walks over texts that differ by an edit meet again soon
afterwards. A walk takes about two steps a character and goes over the whole text.

A fingerprint keeps a hash digit of what the walk sees at sampled steps. Steps have levels: of a level's steps about half belong to the
next. A text uses the level at which about 100 to 200 steps are left, so fingerprints are short for any length, and two of different
levels are compared on the steps of the coarser one. It is written as the level, a colon and the digits. `likeness` is the share of
equal digits, corrected for chance. `near_duplicates` bands fingerprints, and within a band bucket compares all texts by their whole walks,
all steps of them; pairs that are tied already through others are left out, which changes no class. Buckets above BLOCK texts or BLOCK_BYTES
are cut into blocks whose pairs are separate tasks. Texts that share no band are not compared.

Defined results: a null text is the empty text; the empty text's fingerprint is `0:`, like itself (1) and unlike all others (0); equal ids
stand in the order of a hash of their texts, null ids before all others; in a table of one row a document is its own next one; an empty table
gives an empty table; further columns are not read.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecinity.llm.common import U, mix, partitions, saved
from vecinity.operators.components import connected_components

SAMPLES = 100
#: Digits of different characters are equal in so many cases.
CHANCE = 0.125
#: Characters that walk together.
TOGETHER = 12_000_000
#: The same where all steps are kept.
TOGETHER_WHOLE = 1_000_000
STEPS = 4096
DIGITS = np.frombuffer(b"0123456789abcdef", np.uint8)


def bits(first: int, n: int) -> np.ndarray:
    """For steps from first on: by character class whether a walk goes on; class 64 is the end of a text and never does."""
    word = mix(np.arange(first + 1, first + n + 1, dtype=U) * U(0x9E3779B97F4A7C15))
    table = np.zeros((n, 65), np.int64)
    table[:, :64] = (word[:, None] >> np.arange(64, dtype=U)) & U(1)
    return table


def levels(first: int, n: int) -> np.ndarray:
    """The level of each step: the number of low zero bits of its hash."""
    h = mix(np.arange(first + 1, first + n + 1, dtype=U) * U(0xD1342543DE82EF95))
    low = h & (~h + U(1))
    return np.round(np.log2(np.maximum(low, U(1)).astype(float))).astype(np.int64)


def level_of(sizes: np.ndarray) -> np.ndarray:
    """The level that a text of each size uses."""
    return np.maximum(0, np.floor(np.log2(np.maximum(2 * sizes, 1) / SAMPLES))).astype(np.int64)


def fingerprints(texts: list[str], whole: bool = False) -> list[str]:
    """Fingerprint of each text; whole: at level 0, with the digits of all steps."""
    most = TOGETHER_WHOLE if whole else TOGETHER
    out: list[str] = [""] * len(texts)
    order = sorted(range(len(texts)), key=lambda i: -len(texts[i]))
    k = 0
    while k < len(order):
        group, size = [], 0
        while k < len(order) and (not group or size + len(texts[order[k]]) <= most):
            group.append(order[k])
            size += len(texts[order[k]]) + 1
            k += 1
        for i, f in zip(group, _walk([texts[i] for i in group], whole)):
            out[i] = f
    return out


def _walk(texts: list[str], whole: bool = False) -> list[str]:
    """Texts from long to short walk in step."""
    sizes = np.array([len(t) for t in texts])
    n = len(texts)
    codes = np.frombuffer("\0".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), "<u4")
    begin = np.cumsum(sizes + 1) - sizes - 1
    kind = ((codes.astype(np.uint32) * np.uint32(0x9E3779B1)) >> np.uint32(26)).astype(np.uint8)
    kind[begin + sizes] = 64
    own = np.zeros(n, np.int64) if whole else level_of(sizes)
    at, end = begin.copy(), begin + sizes
    alive = int((sizes > 0).sum())  # those that still walk: a prefix, if long ones walk longest; checked below
    seen: list[list] = [[] for _ in range(n)]
    step, live = 0, np.arange(alive)
    pos, stop, lev = at[live], end[live], own[live]
    records = []
    while len(live):
        table, depth = bits(step, STEPS), levels(step, STEPS)
        for j in range(STEPS):
            if j % 64 == 0 and j:
                on = pos < stop
                if not on.all():
                    live, pos, stop, lev = live[on], pos[on], stop[on], lev[on]
                    if not len(live):
                        break
            # Levels fall along the live texts, as lengths do: those at or below the step's level are the last ones.
            d = depth[j]
            m = len(lev) if d >= lev[0] else int(np.searchsorted(-lev, -d))
            if m < len(lev) or d >= lev[0]:
                a = 0 if d >= lev[0] else m
                records.append((live[a:].astype(np.int32), step + j, codes[pos[a:]], pos[a:] < stop[a:]))
            pos += table[j][kind[pos]]
        step += STEPS
        if len(live):
            on = pos < stop
            live, pos, stop, lev = live[on], pos[on], stop[on], lev[on]
    if not records:
        return [f"{v}:" for v in own]
    who = np.concatenate([r[0] for r in records])
    when = np.repeat(np.array([r[1] for r in records], U), [len(r[0]) for r in records])
    what = np.concatenate([r[2] for r in records]).astype(U)
    valid = np.concatenate([r[3] for r in records])
    who, when, what = who[valid], when[valid], what[valid]
    digit = DIGITS[(mix(what * U(0x9E3779B97F4A7C15) + mix(when + U(77))) & U(15)).astype(np.int64)]
    by = np.argsort(who, kind="stable")
    whole = digit[by].tobytes().decode()
    ends = np.searchsorted(who[by], np.arange(n + 1)).tolist()
    return [f"{own[i]}:{whole[ends[i] : ends[i + 1]]}" for i in range(n)]


class Steps:
    """Sampled steps of a level, grown on demand."""

    known: dict[int, tuple[np.ndarray, int]] = {}

    @classmethod
    def of(cls, level: int, n: int) -> np.ndarray:
        """Levels of the first n steps at or above a level."""
        found, upto = cls.known.get(level, (np.zeros(0, np.int64), 0))
        while len(found) < n:
            more = max(STEPS, upto)
            d = levels(upto, more)
            found, upto = np.concatenate([found, d[d >= level]]), upto + more
            cls.known[level] = (found, upto)
        return found[:n]


def at_level(fingerprint: str, level: int) -> np.ndarray:
    """The digits of a fingerprint on the steps of a level that is its own or coarser."""
    own, _, digits = fingerprint.partition(":")
    got = np.frombuffer(digits.encode(), np.uint8)
    return got if int(own) == level else got[Steps.of(int(own), len(got)) >= level]


def likeness(a: str, b: str) -> float:
    """0 to 1: share of equal digits corrected for chance."""
    if a == b:
        return 1.0
    level = max(int(a.partition(":")[0]), int(b.partition(":")[0]))
    x, y = at_level(a, level), at_level(b, level)
    m, n = min(len(x), len(y)), max(len(x), len(y))
    if not m:
        return 0.0
    equal = float((x[:m] == y[:m]).sum()) / n
    return max(0.0, min(1.0, (equal - CHANCE) / (1 - CHANCE)))


def edited(text: str, following: str) -> str:
    """text with its last quarter replaced by the first characters of the following text."""
    k = len(text) // 4
    return text[: len(text) - k] + following[:k]


NAMES = ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"]
KINDS = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64()]
RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
#: Kinds of rows that a range returns: results, its first row and its last one, which waits for the first row of another range.
DONE, FIRST, LAST = 0, 1, 2


def compared(ids: list, texts: list[str], following: list[int]) -> list[tuple]:
    """Result rows of the first len(ids) texts; following: the place of each one's next text."""
    edits = [edited(texts[k], texts[j]) for k, j in enumerate(following)]
    prints = fingerprints([*texts, *edits])
    out = []
    for k, j in enumerate(following):
        f, e = prints[k], prints[len(texts) + k]
        out.append((ids[k], len(texts[k]), hashlib.sha256(edits[k].encode("utf-8", "surrogatepass")).hexdigest(), f, e, likeness(f, e), likeness(f, prints[j])))
    return out


def compare_with_next(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next of every row.

    Rows are sorted by ranges of the key (and, for equal keys, of a hash of the text and of the place, so that no key makes a range too large). A range
    compares its rows with each other and returns its first and last row; last rows are compared with the first rows of the next ranges afterwards."""
    spark = docs.sparkSession
    parts = partitions(spark)
    source = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    order = ["doc_id", "h", "place"]
    dealt = source.withColumn("h", F.xxhash64("text")).withColumn("place", F.monotonically_increasing_id()).repartitionByRange(parts, *order).sortWithinPartitions(*order)

    def run(batches):
        from pyspark import TaskContext

        number = TaskContext.get().partitionId()
        held: list[tuple] = []  # (id, text); the last one waits for its next
        size, begun = 0, False

        def table(results, edges=()):
            rows = [(DONE, number, None, *r) for r in results] + [(kind, number, t, i, *[None] * 6) for kind, i, t in edges]
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 10, [pa.int32(), pa.int32(), pa.string(), *KINDS])], ["kind", "range", "text", *NAMES])

        def finish():
            return table(compared([i for i, _ in held[:-1]], [t for _, t in held], list(range(1, len(held)))))

        for batch in batches:
            for row in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if not begun:
                    begun = True
                    yield table((), [(FIRST, *row)])
                held.append(row)
                size += len(row[1])
                if size > TOGETHER // 2 and len(held) > 1:
                    yield finish()
                    del held[:-1]
                    size = len(held[0][1])
        if len(held) > 1:
            yield finish()
        if held:
            yield table((), [(LAST, *held[-1])])

    found = saved(dealt.select("doc_id", "text").mapInArrow(run, f"kind int, range int, text string, {RESULT}"), "fingerprints")
    edges = found.where(F.col("kind") != DONE).select("kind", "range", "doc_id", "text")
    ranges = sorted(r["range"] for r in edges.where(F.col("kind") == FIRST).select("range").collect())  # a number per range
    after = spark.createDataFrame(list(zip(ranges, [*ranges[1:], *ranges[:1]])), "range int, following int")
    firsts = edges.where(F.col("kind") == FIRST).select(F.col("range").alias("following"), F.col("text").alias("next"))
    pairs = edges.where(F.col("kind") == LAST).join(after, "range").join(firsts, "following").select("doc_id", "text", "next")

    def last(batches):
        for batch in batches:
            rows = [r for i, t, n in zip(*(c.to_pylist() for c in batch.columns)) for r in compared([i], [t, n], [1])]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows) if rows else [[]] * 7, KINDS)], NAMES)

    return found.where(F.col("kind") == DONE).select(*NAMES).unionAll(pairs.mapInArrow(last, RESULT))


BAND = 8


def bands(fingerprint: str) -> list[str]:
    """Band keys: runs of BAND sampled digits, at the fingerprint's level and the next coarser one."""
    level = int(fingerprint.partition(":")[0])
    out = []
    for at in (level, level + 1):
        digits = at_level(fingerprint, at).tobytes().decode()
        out += [f"{at}.{k // BAND}.{digits[k : k + BAND]}" for k in range(0, len(digits) - BAND + 1, BAND)] or [f"{at}.all.{digits}"]
    return out


#: Texts and bytes of walks in a block of a bucket.
BLOCK = 256
BLOCK_BYTES = 16 << 20


def sampled(whole: str, size: int) -> str:
    """The fingerprint of a text of that size from its whole walk."""
    level = int(level_of(np.array([size]))[0])
    return f"{level}:{at_level(whole, level).tobytes().decode()}"


def ties(walks: list[np.ndarray], side: list[int], least: float) -> list[tuple[int, int]]:
    """Pairs of places with likeness of at least `least`, as many as tie what all such pairs would; with two sides only pairs across."""
    root = list(range(len(walks)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    out, across = [], len(set(side)) > 1
    for i in range(len(walks)):
        for j in range(i):
            if across and side[i] == side[j]:
                continue
            a, b = find(i), find(j)
            if a == b:
                continue
            x, y = walks[i], walks[j]
            m, n = min(len(x), len(y)), max(len(x), len(y))
            if m and (np.count_nonzero(x[:m] == y[:m]) / n - CHANCE) / (1 - CHANCE) >= least:
                root[a] = b
                out.append((i, j))
    return out


def near_duplicates(docs: DataFrame, least: float = 0.8, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id and class_id: the smallest id among texts tied by likeness of whole walks of at least `least`."""
    parts = partitions(docs.sparkSession)

    def make(batches):
        for batch in batches:
            texts = batch.column(2).to_pylist()
            walks = fingerprints(texts, whole=True)
            keys = [bands(sampled(w, len(t))) for w, t in zip(walks, texts)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([w[2:].encode() for w in walks], pa.binary()), pa.array(keys, pa.list_(pa.string()))], ["doc_id", "same", "walk", "keys"])

    told = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text"))
    ids = told.select("doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("same"))
    # Equal texts are one class; only one of them walks.
    firsts = told.where("doc_id is not null").withColumn("same", F.sha2(F.col("text").cast("binary"), 256)).groupBy("same").agg(F.min("doc_id").alias("rep"), F.first("text").alias("text"))
    walked = saved(firsts.select(F.col("rep").alias("doc_id"), "same", "text").mapInArrow(make, "doc_id long, same string, walk binary, keys array<string>").withColumnRenamed("doc_id", "rep"), "walks")
    banded = walked.select("rep", "same", F.length("walk").alias("size"), F.explode("keys").alias("band"))
    # Of buckets with the same members one is enough.
    members = F.struct(F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("same")).alias("x"), F.sum(F.xxhash64(F.lit(1), "same").cast("decimal(38,0)")).alias("s"))
    buckets = banded.groupBy("band").agg(members.alias("members"), F.sum("size").alias("bytes")).where("members.n > 1").groupBy("members").agg(F.min("band").alias("band"), F.max("bytes").alias("bytes"))
    blocks = buckets.select("band", F.ceil(F.greatest(F.col("members.n") / BLOCK, F.col("bytes") / BLOCK_BYTES)).cast("int").alias("blocks"))
    own = F.pmod(F.xxhash64("same", F.lit(2)), F.col("blocks")).cast("int")
    placed = banded.join(blocks, "band").withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    tasks = saved(placed.select("same", "own", F.concat_ws("/", "band", F.least("own", "other").cast("string"), F.greatest("own", "other").cast("string")).alias("task")), "tasks")
    rows = tasks.join(walked.select("same", "rep", "walk"), "same").select("task", "rep", "own", "walk").repartition(parts, "task").sortWithinPartitions("task")

    def verify(batches):
        held, now = [], None

        def finish():
            found = ties([np.frombuffer(r[3], np.uint8) for r in held], [r[2] for r in held], least)
            pairs = [(held[i][1], held[j][1]) for i, j in found]
            return pa.RecordBatch.from_arrays([pa.array([r[k] for r in pairs], pa.int64()) for k in (0, 1)], ["src", "dst"])

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[0] != now:
                    if held:
                        yield finish()
                    held, now = [], row[0]
                held.append(row)
        if held:
            yield finish()

    labels = connected_components(rows.mapInArrow(verify, "src long, dst long"))
    of = walked.select("same", "rep").join(labels.select(F.col("id").alias("rep"), "label"), "rep", "left").select("same", F.coalesce("label", "rep").alias("class_id"))
    return ids.join(of, "same", "left").select("doc_id", F.when(F.col("doc_id").isNotNull(), F.col("class_id")).alias("class_id"))
