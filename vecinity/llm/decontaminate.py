"""Benchmark decontamination: a broadcast hash set of the benchmark's word windows against the words of every document.

Words are [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ after A-Z became a-z. A window is n consecutive words of an item; an item with
fewer words (but any) is one window of its own length. A document word inside any occurrence of a window is hit; every
hash hit is verified against the window's words. Windows are made in tasks; what is broadcast are numpy arrays (a hash, an item and a place in
the joined words of the items for each window) in blocks of at most MAX_BYTES, so what a task holds has a bound whatever the benchmark's
size. With more than one block the documents are read once per block, and the hit places of a document are united by a row key.

Defined results: a null text has no words; an item without words gives no window; equal windows of several items count for
each; a null item_id is left out of the item list; repeated rows are documents of their own; empty tables give empty or clean results; columns
pass through whatever their names, except those that this operator makes.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, BooleanType, LongType, StringType, StructField, StructType

from vecinity.llm.common import ALNUM, chunks, fresh, ngrams, saved, text_bytes, words

WINDOW = 10
MAX_BYTES = 48 << 20
PIECE = 100_000
NEW = [("n_words", LongType()), ("n_hit", LongType()), ("items", ArrayType(StringType())), ("contaminated", BooleanType())]


def prepared(benchmark: DataFrame, item: str, text: str, n: int) -> DataFrame:
    """(item, words, size, hashes, first, last) per item with words, or piece of one: its words joined by blanks, the words of a window, and of each window hash, first and last byte."""

    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            out = []
            for i, j in chunks(offsets):
                piece = data[offsets[i] : offsets[j]]
                hashes, first, last, at = words(piece, offsets[i : j + 1] - offsets[i], ALNUM)
                plain = piece.tobytes().lower()
                for row in range(j - i):
                    size = min(n, int(at[row + 1] - at[row]))
                    # Items with more windows than PIECE come in pieces that share size - 1 words.
                    for a in range(int(at[row]), int(at[row + 1]) - size + 1 if size else 0, PIECE):
                        b = min(int(at[row + 1]), a + PIECE + size - 1)
                        own = [plain[first[k] : last[k]] for k in range(a, b)]
                        ends = np.cumsum([len(w) + 1 for w in own])
                        starts = np.concatenate([[0], ends[:-1]])
                        out.append((batch.column(0)[i + row].as_py(), b" ".join(own), size, ngrams(hashes[a:b], size).tobytes(), starts[: b - a - size + 1].astype("<i8").tobytes(), (ends[size - 1 :] - 1).astype("<i8").tobytes()))
            kinds = (pa.string(), pa.binary(), pa.int32(), pa.binary(), pa.binary(), pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out) if out else [[]] * 6, kinds)], ["item", "words", "size", "hashes", "first", "last"])

    told = benchmark.where(F.col(f"`{text}`").isNotNull()).select(F.col(f"`{item}`").cast("string").alias("item"), F.col(f"`{text}`").alias("text"))
    return told.mapInArrow(run, "item string, words binary, size int, hashes binary, first binary, last binary")


class Windows:
    """A block of windows by length: sorted hashes, and the item and the words that stand behind each."""

    def __init__(self, rows: list):
        self.items = [r[0] for r in rows]
        base = np.concatenate([[0], np.cumsum([len(r[1]) for r in rows])]).astype(np.int64)
        self.words = b"".join(r[1] for r in rows)
        self.by_size = {}
        for size in sorted({r[2] for r in rows}):
            own = [k for k, r in enumerate(rows) if r[2] == size]
            hashes = np.concatenate([np.frombuffer(rows[k][3], np.uint64) for k in own])
            who = np.repeat(np.array(own, np.int32), [len(rows[k][3]) // 8 for k in own])
            first, last = (np.concatenate([np.frombuffer(rows[k][c], "<i8") + base[k] for k in own]) for c in (4, 5))
            order = np.argsort(hashes, kind="stable")
            self.by_size[size] = hashes[order], who[order], first[order], last[order]

    @property
    def nbytes(self) -> int:
        return len(self.words) + sum(x.nbytes for arrays in self.by_size.values() for x in arrays)

    def filters(self) -> dict:
        """A first filter of 2**20 bits a size: most windows of clean documents end there."""
        out = {}
        for size, (known, *_) in self.by_size.items():
            out[size] = np.zeros(1 << 20, bool)
            out[size][(known >> np.uint64(44)).astype(np.int64)] = True
        return out

    def spans(self, filters, hashes, at, data, first, last):
        """(row, first word, word after the last, items) of every verified occurrence."""
        for size, (known, who, begin, end) in self.by_size.items():
            grams = ngrams(hashes, size)
            maybe = np.flatnonzero(filters[size][(grams >> np.uint64(44)).astype(np.int64)])
            if not len(maybe):
                continue
            left, right = np.searchsorted(known, grams[maybe]), np.searchsorted(known, grams[maybe], "right")
            rows = np.searchsorted(at, maybe, "right") - 1
            fits = (left < right) & (maybe + size <= at[rows + 1])
            for k, row, x, y in zip(*(z[fits].tolist() for z in (maybe, rows, left, right))):
                plain = b" ".join(data[first[i] : last[i]].tobytes().lower() for i in range(k, k + size))
                items = {self.items[who[i]] for i in range(x, y) if self.words[begin[i] : end[i]] == plain}
                if items:
                    yield row, k, k + size, items


def scan(data, offsets, windows: Windows, filters):
    """Per row of the texts: words, and where any is hit the hit words as a boolean array and the items; and the byte spans of words."""
    for i, j in chunks(offsets):
        piece, own = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
        hashes, first, last, at = words(piece, own, ALNUM)
        found: dict[int, tuple[np.ndarray, set]] = {}
        for row, a, b, items in windows.spans(filters, hashes, at, piece, first, last):
            hit, of = found.setdefault(row, (np.zeros(int(at[row + 1] - at[row]), bool), set()))
            hit[a - at[row] : b - at[row]] = True
            of |= items
        for row in range(j - i):
            yield i + row, int(at[row + 1] - at[row]), found.get(row), first[at[row] : at[row + 1]] - own[row], last[at[row] : at[row + 1]] - own[row]


def blocks(benchmark: DataFrame, item: str, text: str, n: int, most: int) -> list:
    """The benchmark's windows in broadcasts of about `most` bytes; items come one partition at a time."""
    out, rows, size, spark = [], [], 0, benchmark.sparkSession
    for row in prepared(benchmark, item, text, n).toLocalIterator():
        weight = len(row["words"]) + len(row["hashes"]) * 28 // 8
        if rows and size + weight > most:
            out.append(spark.sparkContext.broadcast(Windows(rows)))
            rows, size = [], 0
        rows.append(tuple(row))
        size += weight
    return [*out, spark.sparkContext.broadcast(Windows(rows))] if rows or not out else out


def hits(docs: DataFrame, benchmark: DataFrame, n: int = WINDOW, text: str = "text", item: str = "item_id", item_text: str = "text", keep: list[str] | None = None, most: int = MAX_BYTES, clean: bool = False) -> DataFrame:
    """The columns keep of docs (all by default) and n_words, n_hit long, items array of string, contaminated boolean.

    clean: the text comes back without the bytes of hit spans (from a run's first hit word through its last)."""
    keep = [c for c in (docs.columns if keep is None else keep) if c not in dict(NEW)]
    parts = blocks(benchmark, item, item_text, n, most)
    whole, row, places, of = fresh([*docs.columns, *dict(NEW)], "whole_text", "row", "places", "of")
    source = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias(whole))
    schema = StructType([*source.schema.fields[:-1], *(StructField(name, kind) for name, kind in NEW)])
    if len(parts) == 1:
        return source.mapInArrow(_finisher(keep, text, clean, parts[0]), schema)
    # More windows than one broadcast may hold: hit places of each block, united by row. Only rows with hits are shuffled on this side.
    keyed = saved(source.withColumn(row, F.monotonically_increasing_id()), "decontaminate")
    found = None
    for part in parts:
        one = keyed.select(F.col(row).alias("row"), F.col(whole).alias("text")).mapInArrow(_places(part), "row long, places array<long>, of array<string>")
        found = one if found is None else found.unionAll(one)
    flat = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c))))
    united = found.groupBy(F.col("row").alias(row)).agg(flat("places").alias(places), flat("of").alias(of))
    joined = keyed.join(united, row, "left").select(*[F.col(f"`{c}`") for c in keep], whole, places, of)
    return joined.mapInArrow(_finisher(keep, text, clean), schema)


def _places(part):
    def run(batches):
        windows = part.value
        filters = windows.filters()
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            out = [(batch.column(0)[r].as_py(), np.flatnonzero(f[0]).tolist(), [x for x in f[1] if x is not None]) for r, _, f, _, _ in scan(data, offsets, windows, filters) if f]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out) if out else [[]] * 3, (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.string())))], ["row", "places", "of"])

    return run


def _finisher(keep: list[str], text: str, clean: bool, part=None):
    """Results of rows: from a block of windows, or from places found before, which stand in the last two columns."""

    def run(batches):
        windows = Windows([]) if part is None else part.value
        filters = windows.filters()
        for batch in batches:
            column = batch.column(len(keep))
            data, offsets = text_bytes(column)
            n_words, n_hit, items, texts = [], [], [], []
            for row, n, found, first, last in scan(data, offsets, windows, filters):
                if part is None and (places := batch.column(len(keep) + 1)[row].as_py()):
                    found = np.zeros(n, bool), set(batch.column(len(keep) + 2)[row].as_py())
                    found[0][places] = True
                n_words.append(n)
                n_hit.append(int(found[0].sum()) if found else 0)
                items.append(sorted(x for x in found[1] if x is not None) if found else [])
                if clean:
                    whole = data[offsets[row] : offsets[row + 1]]
                    texts.append(whole.tobytes().decode() if not found else _without(whole, found[0], first, last))
            columns = dict(zip(keep, batch.columns))
            if clean and text in columns:
                columns[text] = pa.array([None if null else x for null, x in zip(column.is_null().to_pylist(), texts)], pa.string())
            columns |= {"n_words": pa.array(n_words, pa.int64()), "n_hit": pa.array(n_hit, pa.int64()), "items": pa.array(items, pa.list_(pa.string())), "contaminated": pa.array([x > 0 for x in n_hit], pa.bool_())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    return run


def _without(whole: np.ndarray, hit: np.ndarray, first: np.ndarray, last: np.ndarray) -> str:
    stay = np.ones(len(whole), bool)
    edge = np.diff(np.concatenate([[0], hit.astype(np.int8), [0]]))
    for a, b in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)):
        stay[first[a] : last[b - 1]] = False
    return whole[stay].tobytes().decode()
