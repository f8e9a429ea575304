"""A trigram backoff automaton over the whole corpus, scored block by block.

Tokens are the words [^\\x20\\x09-\\x0D]+ of a text after A-Z became a-z, and one end. The model is smoothed by a Dirichlet prior of the
next lower order: P(w|h) = (c(hw) + K P(w|h')) / (c(h) + K) with h' the context h without its first word, K = PRIOR of the order, and
P(w) = (c(w) + 1) / (N + V + 1), which keeps one share for unknown words. It needs nothing but counts of n-grams: c(h) is the count of h itself.

As an automaton: a state per seen context of one or two words and a root; an arc per seen n-gram, to the state of the longest seen context that
ends with its word; a failure arc of weight K / (c(h) + K) from each state to that of h'. The root has an arc for every word. A token is read by
following failure arcs until an arc fits. A block's tokens are read in lanes of LANE tokens in step, each lane carrying its state; a lane begins two
tokens early at the root, which leads to the state that a walk from the start of the text has there.

The model grows with the corpus and is never gathered anywhere. Rows are dealt into blocks of about BLOCK_BYTES, which pass through a task one at a
time. A block asks for its distinct n-grams with its own training counts, one request for each part of the key space; a part adds the counts of
all blocks and answers each block with the totals of what it asked for; the block then builds the automaton that its texts can reach. Keys are hashes and
parts are ranges of them, so a frequent n-gram is one key of each block and no part is larger than others. Words have 60 bits; n-grams have as many bits
as make a collision of one rarer than 2**-16, in steps of a byte by the size of the corpus. Requests hold sorted keys as low bytes and the unary gaps of
the rest (some 26 bits a key); counts are a byte each, 64 bits where they don't fit.

Defined results: a null or empty text has one token, the end; with no training rows every word is unknown; a null id hashes as
the empty string and scores like any other; repeated rows are counted and scored each; an empty table gives an empty table. The table is read
twice and must come in the same order of rows both times (as files do); if it doesn't, a block that differs fails.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecinity.llm.common import PLACES, SPACED, U, chunks, mix, partitions, text_bytes, words

#: Weight of the lower order's distribution, in tokens, for contexts of one and two words.
PRIOR = (500.0, 20.0)
BLOCK_BYTES = 6 << 20
LANE = 256
#: Parts of the key space that a task adds up one after the other.
PARTS_A_TASK = 4
END = mix(np.array([0x656E64], U))[0]
START = mix(np.array([0x7374617274], U))[0]
#: Low bytes of a word key, and bits of a key beyond its low bytes.
WORD_LOW, HIGH = 5, 20


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all tokens, ends included, and the first token of each text (one more entry than texts)."""
    out, at, base = [], [np.zeros(1, np.int64)], 0
    for i, j in chunks(offsets):
        hashes, _, _, first = words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], SPACED)
        out.append(np.insert(hashes, first[1:], END))
        at.append(base + first[1:] + np.arange(1, j - i + 1))
        base = int(at[-1][-1])
    return (np.concatenate(out) if out else np.zeros(0, U)), np.concatenate(at)


def low_bytes(size: int) -> int:
    """Low bytes of n-gram keys for a corpus of so many bytes: at most one in 2**16 n-grams meets another."""
    return min(5, max(2, -(-(max(size // 2, 1).bit_length() + 16 - HIGH) // 8)))


class Grams:
    """The n-gram keys at each token of a block of texts."""

    def __init__(self, text: pa.Array, low: int):
        self.seen, self.at = tokens(*text_bytes(text))
        n = len(self.seen)
        self.begins = np.zeros(n, bool)
        self.begins[self.at[:-1]] = True
        before = np.empty(n, U)
        before[1:] = self.seen[:-1]
        before[self.begins] = START
        second = np.empty(n, U)
        second[1:] = before[:-1]
        cut = U(64 - 8 * low - HIGH)
        pairs = before * U(PLACES[0]) + self.seen * U(PLACES[1])
        #: Words (and one start), pairs with the word before, and triples, which first tokens have none of.
        self.keys = [np.append(self.seen, START) >> U(64 - 8 * WORD_LOW - HIGH), mix(pairs) >> cut, mix(second * U(PLACES[2]) + pairs) >> cut]
        self.widths = [WORD_LOW, low, low]


def edges(width: int, parts: int) -> np.ndarray:
    """The first key of each part, and one past the last key."""
    bits = 8 * width + HIGH
    return np.array([(p << bits) // parts for p in range(parts + 1)], U)


def pack_keys(keys: np.ndarray, width: int, first: int) -> bytes:
    """Ascending distinct keys from first on."""
    if not len(keys):
        return b""
    high = ((keys >> U(8 * width)) - U(int(first) >> 8 * width)).astype(np.int64) + np.arange(len(keys))
    marks = np.zeros(int(high[-1]) + 1, np.uint8)
    marks[high] = 1
    low = keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :width]
    return len(keys).to_bytes(4, "little") + np.packbits(marks).tobytes() + np.ascontiguousarray(low).tobytes()


def unpack_keys(blob: bytes, width: int, first: int) -> np.ndarray:
    if not blob:
        return np.zeros(0, U)
    n = int.from_bytes(blob[:4], "little")
    tail = len(blob) - n * width
    high = np.flatnonzero(np.unpackbits(np.frombuffer(blob, np.uint8, tail - 4, 4)))[:n] - np.arange(n)
    low = np.zeros((n, 8), np.uint8)
    low[:, :width] = np.frombuffer(blob, np.uint8, n * width, tail).reshape(n, width)
    return (high.astype(U) + U(int(first) >> 8 * width) << U(8 * width)) | low.view("<u8").reshape(-1)


def pack_counts(counts: np.ndarray) -> bytes:
    """A byte a count; 255 stands for one of the 64-bit numbers that follow."""
    large = counts >= 255
    return zlib.compress(np.where(large, 255, counts).astype(np.uint8).tobytes() + counts[large].astype("<u8").tobytes(), 1)


def unpack_counts(blob: bytes, n: int) -> np.ndarray:
    raw = zlib.decompress(blob)
    out = np.frombuffer(raw, np.uint8, n).astype(np.int64)
    out[out == 255] = np.frombuffer(raw, "<u8", -1, n).astype(np.int64) if len(raw) > n else 0
    return out


REQUEST = [("part", pa.int32()), ("block", pa.int32()), ("words", pa.binary()), ("pairs", pa.binary()), ("triples", pa.binary()), ("counts", pa.binary())]
ANSWER = [("block", pa.int32()), ("part", pa.int32()), ("totals", pa.binary()), ("n", pa.int64()), ("v", pa.int64())]


def ddl(schema) -> str:
    return ", ".join(f"{n} {({pa.int32(): 'int', pa.int64(): 'long', pa.binary(): 'binary'})[t]}" for n, t in schema)


def batch_of(rows, schema):
    cols = list(zip(*rows)) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, schema)], [n for n, _ in schema])


def requests(text: pa.Array, train: np.ndarray, block: int, parts: int, low: int):
    """Per part: the distinct keys of a block in its range, and their training counts."""
    grams = Grams(text, low)
    weight = np.repeat(train.astype(U), np.diff(grams.at))
    blobs, counts = [], []
    for k, (keys, width) in enumerate(zip(grams.keys, grams.widths)):
        flag = np.append(weight, U(0)) if k == 0 else weight
        marked = (keys << U(1)) | flag
        ranked = np.sort(marked[~grams.begins] if k == 2 else marked)
        own = ranked >> U(1)
        first = np.flatnonzero(np.concatenate([np.ones(min(len(own), 1), bool), own[1:] != own[:-1]]))
        own, times = own[first], np.add.reduceat((ranked & U(1)).astype(np.int64), first) if len(first) else np.zeros(0, np.int64)
        if k == 0:
            times[np.searchsorted(own, START >> U(64 - 8 * WORD_LOW - HIGH))] = int(train.sum())
        bounds = edges(width, parts)
        cuts = np.searchsorted(own, bounds)
        blobs.append([pack_keys(own[cuts[p] : cuts[p + 1]], width, bounds[p]) for p in range(parts)])
        counts.append([times[cuts[p] : cuts[p + 1]] for p in range(parts)])
    for p in range(parts):
        yield (p, block, blobs[0][p], blobs[1][p], blobs[2][p], pack_counts(np.concatenate([c[p] for c in counts])))


def totals(rows: list[tuple], parts: int, low: int):
    """What a part answers to the requests that it got."""
    part = rows[0][0]
    widths = (WORD_LOW, low, low)
    sizes = [[int.from_bytes(r[2 + k][:4], "little") for k in range(3)] for r in rows]
    told = [np.split(unpack_counts(r[5], sum(s)), np.cumsum(s)[:-1]) for r, s in zip(rows, sizes)]
    n = v = 0
    found = []
    for k, width in enumerate(widths):
        first = edges(width, parts)[part]
        keys = [unpack_keys(r[2 + k], width, first) for r in rows]
        flat = np.concatenate(keys)
        order = np.argsort(flat)
        flat = flat[order]
        head = np.flatnonzero(np.concatenate([np.ones(min(len(flat), 1), bool), flat[1:] != flat[:-1]]))
        counts = np.concatenate([t[k] for t in told])[order]
        sums = np.add.reduceat(counts, head) if len(head) else np.zeros(0, np.int64)
        known = flat[head]
        del flat, order, counts
        if k == 0:
            words_ = known != START >> U(64 - 8 * WORD_LOW - HIGH)
            n, v = int(sums[words_].sum()), int((sums[words_] > 0).sum())
        found.append([sums[np.searchsorted(known, x)] for x in keys])
    for k, r in enumerate(rows):
        yield (r[1], part, pack_counts(np.concatenate([f[k] for f in found])), n, v)


class Automaton:
    """The part of the model that a block reaches; weights in log10. State 0 is the root, 1 + w stands for the context w, and those of pairs follow."""

    def __init__(self, w: np.ndarray, begins: np.ndarray, start: int, pair: np.ndarray, counts: tuple, triples: np.ndarray, n: int, v: int, prior: tuple):
        """w, pair: word and pair class of each token; counts: those of words, pairs and triples; triples: a token at which each triple stands."""
        ones, twos, threes = counts
        self.size, m = len(ones), len(twos)
        before = np.empty(len(w), np.int64)
        before[1:] = w[:-1]
        before[begins] = start
        at = np.empty(m, np.int64)
        at[pair] = np.arange(len(w))
        root = (ones + 1.0) / (n + v + 1.0)
        context = ones[before[at]]
        two = np.where(context > 0, (twos + prior[0] * root[w[at]]) / (context + prior[0]), root[w[at]])
        above = pair[triples - 1]
        three = (threes + prior[1] * two[pair[triples]]) / (twos[above] + prior[1])
        seen, joint = np.flatnonzero(twos > 0), np.flatnonzero((threes > 0) & (twos[above] > 0))
        keys = np.concatenate([(1 + before[at[seen]]) * self.size + w[at[seen]], (1 + self.size + above[joint]) * self.size + w[triples[joint]]])
        order = np.argsort(keys)
        self.keys = keys[order]
        self.weight = np.log10(np.concatenate([two[seen], three[joint]]))[order]
        self.to = (1 + self.size + np.concatenate([seen, pair[triples[joint]]]))[order]
        self.root, self.root_to = np.log10(root), np.where(ones > 0, 1 + np.arange(self.size), 0)
        self.failure = np.concatenate([np.zeros(1, np.int64), np.zeros(self.size, np.int64), 1 + w[at]])
        self.failure_weight = np.log10(np.concatenate([np.ones(1), prior[0] / (ones + prior[0]), prior[1] / (twos + prior[1])]))
        self.start = 1 + start if ones[start] > 0 else 0

    def step(self, state: np.ndarray, word: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Weight of reading one word from each state, failure arcs included, and the states after it."""
        total, after, now = np.zeros(len(word)), np.empty(len(word), np.int64), state.copy()
        left = np.arange(len(word))
        while len(left):
            top = now[left] == 0
            done = left[top]
            total[done] += self.root[word[done]]
            after[done] = self.root_to[word[done]]
            left = left[~top]
            if not len(left):
                break
            key = now[left] * self.size + word[left]
            at = np.minimum(np.searchsorted(self.keys, key), max(len(self.keys) - 1, 0))
            fits = self.keys[at] == key if len(self.keys) else np.zeros(len(left), bool)
            done = left[fits]
            total[done] += self.weight[at[fits]]
            after[done] = self.to[at[fits]]
            left = left[~fits]
            total[left] += self.failure_weight[now[left]]
            now[left] = self.failure[now[left]]
        return total, after

    def traverse(self, w: np.ndarray, begins: np.ndarray) -> np.ndarray:
        """Weight of each token, from left to right."""
        n = len(w)
        first = np.arange(0, n, LANE)
        out, state = np.zeros(len(first) * LANE), np.zeros(len(first), np.int64)
        for j in range(-2, min(LANE, n)):
            at = np.clip(first + j, 0, n - 1)
            state[begins[at]] = self.start
            weight, state = self.step(state, w[at])
            if j >= 0:
                out[first + j] = weight
        return out[:n]


def classes(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The ascending distinct keys, and the place of each key among them."""
    order = np.argsort(keys)
    ranked = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = ranked[1:] != ranked[:-1]
    where = np.empty(len(keys), np.int64)
    where[order] = np.cumsum(new) - 1
    return ranked[new], where


def scored(text: pa.Array, answers: list[tuple], parts: int, low: int, prior: tuple = PRIOR):
    """Of each text of a block: tokens, known ones, training tokens, base and model score."""
    grams = Grams(text, low)
    (own, where), (pairs, pair) = classes(grams.keys[0]), classes(grams.keys[1])
    later = np.flatnonzero(~grams.begins)
    triples, which = classes(grams.keys[2][later])
    where_at = np.empty(len(triples), np.int64)
    where_at[which] = later
    found = [[], [], []]
    keys = (own, pairs, triples)
    cuts = [np.searchsorted(x, edges(width, parts)) for x, width in zip(keys, grams.widths)]
    if sorted(a[1] for a in answers) != list(range(parts)):
        raise RuntimeError("a block without answers of all parts")
    for _, p, blob, _, _ in sorted(answers, key=lambda a: a[1]):
        sizes = [int(c[p + 1] - c[p]) for c in cuts]
        for k, got in enumerate(np.split(unpack_counts(blob, sum(sizes)), np.cumsum(sizes)[:-1])):
            found[k].append(got)
    counts = tuple(np.concatenate(f) for f in found)
    if any(len(c) != len(x) for c, x in zip(counts, keys)):
        raise RuntimeError("the rows of a block have changed between two readings")
    n, v = sum(a[3] for a in answers), sum(a[4] for a in answers)
    w, start = where[:-1], int(where[-1])
    model = Automaton(w, grams.begins, start, pair, counts, where_at, n, v, prior)
    steps = model.traverse(w, grams.begins)
    adds = lambda x: np.add.reduceat(x, grams.at[:-1])
    return np.diff(grams.at), adds((counts[0][w] > 0).astype(np.int64)), n, adds(model.root[w]), adds(steps)


def score(docs: DataFrame, train: str, key: str = "doc_id", text: str = "text", block_bytes: int = BLOCK_BYTES, prior: tuple = PRIOR) -> DataFrame:
    """doc_id, trained boolean, n_tokens, n_known, train_tokens long, base_score, score double per row; train: SQL condition of training rows."""
    spark = docs.sparkSession
    tasks = partitions(spark)
    parts = tasks * PARTS_A_TASK
    source = docs.select(F.col(f"`{key}`").alias("doc_id"), F.col(f"`{text}`").alias("text"), F.coalesce(F.expr(train), F.lit(False)).alias("train"))
    size = source.agg(F.sum(F.octet_length("text") + 2).alias("bytes")).first()["bytes"] or 0
    low = low_bytes(size)
    blocks = max(1, -(-size // block_bytes), min(tasks, -(-size // (1 << 20))))
    # By place, so that equal rows go to different blocks. Both uses below share this exchange.
    dealt = source.withColumn("block", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(blocks)).cast("int")).repartition(tasks, "block")

    def ask(batches):
        now, held = None, []

        def finish():
            return batch_of(list(requests(pa.concat_arrays([h[0] for h in held]), np.concatenate([h[1] for h in held]), now, parts, low)), REQUEST)

        for batch in batches:
            block = batch.column(3).to_numpy()
            ends = np.flatnonzero(np.append(np.diff(block), 1)) + 1
            at = 0
            for end in ends.tolist() if len(block) else []:
                if block[at] != now and held:
                    yield finish()
                    held = []
                now = int(block[at])
                held.append((batch.column(1).slice(at, end - at), np.array(batch.column(2).slice(at, end - at)).astype(bool)))
                at = end
        if held:
            yield finish()

    def answer(batches):
        by: dict[int, list] = {}
        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                by.setdefault(row[0], []).append(row)
        for part in list(by):
            rows = []
            for row in totals(by.pop(part), parts, low):
                rows.append(row)
                if len(rows) == 64:
                    yield batch_of(rows, ANSWER)
                    rows = []
            if rows:
                yield batch_of(rows, ANSWER)

    asked = dealt.sortWithinPartitions("block").mapInArrow(ask, ddl(REQUEST))
    answers = asked.repartitionById(tasks, F.col("part") % tasks).mapInArrow(answer, ddl(ANSWER))

    def finish(texts: pa.Table, got: pa.Table) -> pa.Table:
        rows = list(zip(*(got.column(n).to_pylist() for n, _ in ANSWER)))
        n_tokens, known, total, base, steps = scored(texts.column("text").combine_chunks(), rows, parts, low, prior)
        return pa.table({"doc_id": texts.column("doc_id"), "trained": texts.column("train"), "n_tokens": n_tokens, "n_known": known, "train_tokens": np.full(len(base), total), "base_score": base, "score": steps})

    id_kind = source.schema["doc_id"].dataType.simpleString()
    return dealt.groupBy("block").cogroup(answers.groupBy("block")).applyInArrow(finish, f"doc_id {id_kind}, trained boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
