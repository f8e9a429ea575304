"""Bounded-space online packing of tokenised documents into fixed-length sequences.

Each task keeps a fixed number of open windows. A document's tokens are cut into pieces of at most `size`; a piece of that size is a sequence
of its own; any other goes into the open window that it fits best; when none has room the fullest window is emitted and a new one opened. Windows
still open at the end of a task are leftovers: a final pass merges their pieces, the largest first and again best-fit, in a
few tasks whose number follows the leftovers (MERGED windows each). Only piece descriptions (document, start, length) are
shuffled in that pass, never token ids, so it is small: at most OPEN windows a task.

Token ids are those that the tokenizers library gives for the file given, with add_special_tokens=False: nothing is added, and a special token's
string inside a text is that token, unless `special_as_text`. For byte-level BPE whose ranks are its ids a text is encoded by tiktoken with the same
ranks and the same pattern, which costs less than remembering the pieces between blanks; a text that holds the string of an added token is encoded by the library.

Defined results: a null text is the empty text: one piece, the end id alone; very long documents fill whole windows; repeated
rows are packed each for itself; an empty table gives no rows; further columns are not read. The id of a sequence is unique
over tasks and stays under 2**63.
"""

from __future__ import annotations

import json
import os
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

SIZE = 2048
OPEN = 64
END = 1
#: Leftover windows that one task of the final pass merges.
MERGED = 20_000


def byte_alphabet() -> dict[str, int]:
    """The characters that byte-level BPE files write for bytes: printable Latin-1 stands for itself, others from U+0100 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoder:
    """Token ids of texts, as numpy arrays."""

    def __init__(self, path: str, special_as_text: bool = False):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = special_as_text
        self.added = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        self.ranked = self._ranked(path)

    def _ranked(self, path: str):
        """The same vocabulary for tiktoken, if ids are ranks; checked against the tokenizers library."""
        import public_tokenizers
        import tiktoken

        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        letters = byte_alphabet()
        if model.get("type") != "BPE" or any(c not in letters for a in model["vocab"] if not a.startswith("<|") for c in a):
            return None
        ranks = {bytes(letters[c] for c in a): k for a, k in model["vocab"].items() if not a.startswith("<|")}
        got = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        probe = "It's 12 o'clock,\n\tnaïve Ünïcode—words  <|end of text|> é  x\r\n" + " thonble éelle über señor" * 3
        return got if got.encode_ordinary(probe) == self.whole.encode(probe, add_special_tokens=False).ids else None

    def encode(self, text: str) -> np.ndarray:
        if self.ranked is not None and not any(t in text for t in self.added):
            try:
                return self.ranked.encode_to_numpy(text)
            except BaseException:  # a text that is too odd for the quick way
                pass
        return np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32)


class Windows:
    """Best-fit over at most `most` open windows of `size` places."""

    def __init__(self, size: int, most: int):
        self.size, self.most = size, most
        self.rooms: list[list[list]] = [[] for _ in range(size + 1)]  # open windows by the room left
        self.bits, self.n = 0, 0  # which rooms have windows

    def add(self, piece, length: int):
        """Places a piece; the windows that are complete come back."""
        if length == self.size:
            return [[piece]]
        out = []
        rest = self.bits >> length
        if rest:
            room = length + (rest & -rest).bit_length() - 1
            window = self._take(room)
        else:
            if self.n >= self.most:
                out.append(self._take((self.bits & -self.bits).bit_length() - 1))
            room, window = self.size, []
        window.append(piece)
        if room == length:
            out.append(window)
        else:
            self.rooms[room - length].append(window)
            self.bits |= 1 << (room - length)
            self.n += 1
        return out

    def _take(self, room: int) -> list:
        window = self.rooms[room].pop()
        if not self.rooms[room]:
            self.bits &= ~(1 << room)
        self.n -= 1
        return window

    def rest(self):
        for windows in self.rooms:
            yield from windows
        self.__init__(self.size, self.most)


NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
SCHEMA = StructType([StructField(n, LongType()) for n in NAMES])


def pack(docs: DataFrame, tokenizer: str, size: int = SIZE, opened: int = OPEN, key: str = "doc_id", text: str = "text", end: int = END, special_as_text: bool = False) -> DataFrame:
    """One row per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset."""

    def first(batches):
        encoder, windows = Encoder(tokenizer, special_as_text), Windows(size, opened)
        from pyspark import TaskContext

        task, number = TaskContext.get().partitionId(), 0
        rows: list[tuple] = []

        def emit(window, left):
            nonlocal number
            offset = 0
            for piece in window:
                rows.append((*piece, (task << 36) | number, offset, left))
                offset += piece[2]
            number += 1

        def flush():
            out = pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*rows) if rows else [[]] * 8)], [*NAMES, "leftover"])
            rows.clear()
            return out

        for batch in batches:
            for doc, t in zip(batch.column(0).to_pylist(), batch.column(1)):
                ids = np.append(encoder.encode(t.as_py() or ""), np.uint32(end)).astype("<u4")
                total = len(ids)
                # Whole windows from the end of what doesn't fit one; the remainder is placed best-fit.
                for at in range(0, total, size):
                    part = ids[at : at + size]
                    for window in windows.add((doc, at, len(part), zlib.crc32(part.tobytes()), total), len(part)):
                        emit(window, 0)
                if len(rows) > 20_000:
                    yield flush()
        for window in windows.rest():
            emit(window, 1)
        yield flush()

    from vecinity.llm.common import saved

    placed = saved(docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")).mapInArrow(first, ", ".join(f"`{n}` long" for n in [*NAMES, "leftover"])), "packing")
    whole = placed.where("leftover = 0").select(*NAMES)
    left = placed.where("leftover = 1")
    windows = left.select("sequence_id").distinct().count()
    tasks = max(1, -(-windows // MERGED))
    room = 1 << 62

    def second(batches):
        """The pieces of this task's leftover windows, largest first, best-fit into windows of which all stay open."""
        from pyspark import TaskContext

        task, number = TaskContext.get().partitionId(), 0
        found = sorted((row for batch in batches for row in zip(*(batch.column(k).to_pylist() for k in range(7)))), key=lambda r: (-r[2], r[5], r[6]))
        bins = Windows(size, 1 << 30)
        done = []
        for row in found:
            done += bins.add(row, row[2])
        rows = []
        for window in [*done, *bins.rest()]:
            offset, name = 0, room | (task << 36) | number
            for r in window:
                rows.append((*r[:5], name, offset))
                offset += r[2]
            number += 1
        yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*rows) if rows else [[]] * 7)], NAMES)

    merged = left.select(*NAMES).repartition(tasks, F.xxhash64("sequence_id") % tasks).mapInArrow(second, SCHEMA)
    return whole.unionAll(merged)
