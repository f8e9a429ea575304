"""Exact Jaccard self-join on word shingles with a prefix tree, and the components that its links form.

Two documents link when 100 * |A n B| >= threshold * |A u B| for their sets of distinct shingles (hashed to 64 bits).

1. Count filter. A document can only link if it shares threshold percent of its own shingles with others. Every task sends a
   shingle once: shingles that two of its own documents share are counted at once and sent without owner, so a passage
   in a third of all documents costs one entry a task. Documents below the bound stay alone, exactly and finally.
2. Equal sets become classes (partial aggregation on a 128-bit digest), so copies are never paired.
3. Shingles of the remaining classes are counted; (count, hash) is the global order. Links must share one of the first
   n - ceil(t n) + 1 shingles in ascending order; classes that share such a shingle and whose sizes are within the ratio
   belong to one cluster (again pre-aggregated per task to size intervals).
4. A cluster is joined in one task by a prefix tree over its globally ordered sets: a probe walks down the tree level by
   level, a path's overlap is computed once for all sets below it, and a subtree ends when the overlap so far and what can
   still follow, bounded by the remaining lengths, miss the required overlap.
5. A cluster above BLOCK shingles is cut into blocks by size class and hash. First blocks are joined inside, then the smallest sets of the components that
   this gives, again inside blocks: in a family of near copies that ties nearly all. What may still link are sets that share a prefix shingle with a set of
   another component; only those remain, their clusters are made anew, and of these all pairs of blocks whose size classes can link are joined in
   tasks of their own. So no link between components is lost, and a family of near copies is not paired block by block.
6. Components of the found links, by star contraction.

Defined results: null and empty texts have 0 shingles, link with nothing and are their own component; a text with fewer words
than a shingle is one shingle; rows with the same id are one document for the components; a null id gets a null component;
repeated rows come back as often as they are there; an empty table gives an empty table; further columns are not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecinity.llm.common import PLACES, SPACED, U, chunks, mix, ngrams, partitions, released, saved, text_bytes, words
from vecinity.operators.components import connected_components

N = 5
THRESHOLD = 80
#: Bytes of text whose shingles a task gathers before it sends them.
FLUSH = 24 << 20
#: Bytes of text whose shingles are made at once, and of shingles that a batch sends.
PIECE = 4 << 20
#: Shingles of a cluster that one task joins at once.
BLOCK = 1_500_000


def shingle_sets(data: np.ndarray, offsets: np.ndarray, n: int = N) -> tuple[np.ndarray, np.ndarray]:
    """The distinct shingles of each text, sorted, one text after the other; and their number."""
    out, sizes = [], []
    for i, j in chunks(offsets):
        hashes, _, _, at = words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], SPACED)
        count = np.diff(at)
        grams = ngrams(hashes, n)
        rows = np.repeat(np.arange(j - i), np.maximum(count - n + 1, 0))
        start = np.cumsum(np.maximum(count - n + 1, 0)) - np.maximum(count - n + 1, 0)
        grams = grams[np.repeat(at[:-1] - start, np.maximum(count - n + 1, 0)) + np.arange(len(rows))] if len(rows) else np.zeros(0, U)
        short = np.flatnonzero((count > 0) & (count < n))
        if len(short):
            rows = np.concatenate([rows, short])
            whole = []
            for r in short:
                own = hashes[at[r] : at[r + 1]]
                whole.append(int(mix(np.array([sum(int(h) * p for h, p in zip(own, PLACES)) + len(own) & (1 << 64) - 1], U))[0]))
            grams = np.concatenate([grams, np.array(whole, U)])
            order = np.argsort(rows, kind="stable")
            rows, grams = rows[order], grams[order]
        ends = np.searchsorted(rows, np.arange(j - i + 1))
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()):
            grams[a:b].sort()
        new = np.ones(len(grams), bool)
        new[1:] = (grams[1:] != grams[:-1]) | (rows[1:] != rows[:-1])
        out.append(grams[new])
        sizes.append(np.bincount(rows[new], minlength=j - i))
    return (np.concatenate(out), np.concatenate(sizes).astype(np.int64)) if out else (np.zeros(0, U), np.zeros(0, np.int64))


def digests(tokens: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits of each set; the empty set has zeros."""
    ends = np.concatenate([[0], np.cumsum(sizes)])
    sums = np.concatenate([np.zeros(1, U), np.cumsum(mix(tokens))])
    other = np.concatenate([np.zeros(1, U), np.cumsum(mix(tokens ^ U(0xA0761D6478BD642F)))])
    return sums[ends[1:]] - sums[ends[:-1]], other[ends[1:]] - other[ends[:-1]]


def repeated(keys: np.ndarray) -> np.ndarray:
    """Whether each key stands in keys more than once."""
    order = np.argsort(keys, kind="stable")
    ranked = keys[order]
    same = np.zeros(len(keys), bool)
    if len(keys) > 1:
        equal = ranked[1:] == ranked[:-1]
        same[1:] |= equal
        same[:-1] |= equal
    out = np.zeros(len(keys), bool)
    out[order] = same
    return out


SENT = "kind int, part int, owners binary, counts binary, tokens binary"


def _sent(kind, part, owners, counts, tokens):
    return kind, part, owners.astype("<i8").tobytes(), counts.astype("<u4").tobytes(), tokens.tobytes()


def _batch(rows: list, schema: list[tuple[str, pa.DataType]]) -> pa.RecordBatch:
    cols = list(zip(*rows)) if rows else [[]] * len(schema)
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, schema)], [n for n, _ in schema])


_SENT = [("kind", pa.int32()), ("part", pa.int32()), ("owners", pa.binary()), ("counts", pa.binary()), ("tokens", pa.binary())]


def counted(docs: DataFrame, n: int, parts: int) -> DataFrame:
    """Step 1: (key, doc_id, rows, n_shingles, shared) of each document; shared counts shingles that others have as well."""

    @released
    def send(batches):
        held, size = [], 0
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            ids = np.array(batch.column(0).fill_null(0).to_numpy(zero_copy_only=False), np.int64)
            null = np.array(batch.column(0).is_null())
            for i, j in chunks(offsets, PIECE):
                tokens, sizes = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], n)
                a, b = digests(tokens, sizes)
                keys = mix(mix(ids[i:j].astype(U) * U(2) + null[i:j].astype(U)) + a + b * U(3)).astype(np.int64)
                held.append((ids[i:j], null[i:j], keys, sizes, tokens, ((tokens >> U(32)) % U(parts)).astype(np.uint16 if parts <= 1 << 16 else np.int64)))
                size += int(offsets[j] - offsets[i])
                if size >= FLUSH:
                    yield from flush(held)
                    size = 0
        if held:
            yield from flush(held)

    def flush(held):
        ids, null, keys, sizes, tokens, part = (np.concatenate([h[k] for h in held]) for k in range(6))
        held.clear()
        row = np.repeat(np.arange(len(ids), dtype=np.int32), sizes)
        ends = np.concatenate([[0], np.cumsum(np.bincount(part, minlength=parts))]).tolist()
        order = np.argsort(part, kind="stable")
        shared = np.zeros(len(tokens), bool)
        rows, weight = [], 0
        # Equal shingles have one part, so each part is settled by itself.
        for p in range(parts):
            at = order[ends[p] : ends[p + 1]]
            if not len(at):
                continue
            own, owner = tokens[at], row[at]
            several = repeated(own)
            shared[at] = several
            if several.any():
                rows.append(_sent(2, p, np.zeros(0), np.zeros(0), (np.unique(own[several]) & U(0xFFFFFFFF)).astype("<u4")))
            own, owner = (own[~several] & U(0xFFFFFFFF)).astype("<u4"), owner[~several]
            if len(own):
                first = np.flatnonzero(np.diff(owner, prepend=-1))
                rows.append(_sent(0, p, keys[owner[first]], np.diff(np.append(first, len(own))), own))
            weight += 4 * len(at)
            if weight >= PIECE:
                yield _batch(rows, _SENT)
                rows, weight = [], 0
        local = np.bincount(row[shared], minlength=len(ids))
        # Documents themselves: id, set size and what is shared inside this task.
        rows += [(1, int(keys[g[0]] % parts) if len(g) else 0, np.stack([keys[g], ids[g], null[g].astype(np.int64), sizes[g], local[g]]).astype("<i8").tobytes(), b"", b"") for g in np.array_split(np.arange(len(ids)), max(1, len(ids) // 20000))]
        yield _batch(rows, _SENT)

    def packed(kind, keys, columns):
        """One row per home partition of the keys."""
        home = (keys.astype(U) % U(parts)).astype(np.int64)
        order = np.argsort(home, kind="stable")
        ends = np.searchsorted(home[order], np.arange(parts + 1))
        return [(kind, p, columns[:, order[ends[p] : ends[p + 1]]].astype("<i8").tobytes()) for p in range(parts) if ends[p] < ends[p + 1]]

    home_schema = [("kind", pa.int32()), ("part", pa.int32()), ("rows", pa.binary())]

    @released
    def receive(batches):
        by: dict[int, list] = {}
        documents, shared = [], []
        for batch in batches:
            for kind, part, owners, counts, tokens in zip(*(c.to_pylist() for c in batch.columns)):
                if kind == 1:
                    documents.append(np.frombuffer(owners, "<i8").reshape(5, -1))
                else:
                    by.setdefault(part, []).append((owners, counts, tokens))
        for part in list(by):
            rows = by.pop(part)
            tokens = np.concatenate([np.frombuffer(t, "<u4") for _, _, t in rows])
            keys = np.concatenate([np.repeat(np.frombuffer(o, "<i8"), np.frombuffer(c, "<u4")) if o else np.zeros(len(t) // 4, np.int64) for o, c, t in rows])
            owned = np.concatenate([np.full(len(t) // 4, bool(o)) for o, _, t in rows])
            rows.clear()
            seen = []
            for k in range(4):  # equal tokens lie in one quarter
                at = np.flatnonzero(tokens >> np.uint32(30) == k).astype(U)
                joint = np.sort((tokens[at].astype(U) << U(32)) | at)
                same = np.zeros(len(joint), bool)
                equal = (joint[1:] >> U(32)) == (joint[:-1] >> U(32))
                same[1:] |= equal
                same[:-1] |= equal
                places = (joint[same] & U(0xFFFFFFFF)).astype(np.int64)
                seen.append(keys[places[owned[places]]])
            shared.append(np.stack(np.unique(np.concatenate(seen), return_counts=True)))
        for kind, found in ((1, documents), (0, shared)):
            if found:
                found = np.concatenate(found, 1)
                yield _batch(packed(kind, found[0], found), home_schema)

    @released
    def add(batches):
        documents, shared = [np.zeros((5, 0), np.int64)], [np.zeros((2, 0), np.int64)]
        for batch in batches:
            for kind, _, rows in zip(*(c.to_pylist() for c in batch.columns)):
                (documents if kind else shared).append(np.frombuffer(rows, "<i8").reshape(5 if kind else 2, -1))
        keys, ids, null, sizes, local = np.concatenate(documents, 1)
        known, first, at, rows = np.unique(keys, return_index=True, return_inverse=True, return_counts=True)
        total = np.bincount(at, local, len(known))
        keys, times = np.concatenate(shared, 1)
        total += np.bincount(np.searchsorted(known, keys), times, len(known))
        yield pa.RecordBatch.from_arrays([pa.array(known), pa.array(ids[first], mask=null[first].astype(bool)), pa.array(rows), pa.array(sizes[first]), pa.array(total.astype(np.int64))], ["key", "doc_id", "rows", "n_shingles", "shared"])

    sent = docs.mapInArrow(send, SENT)
    back = sent.repartitionById(parts, F.col("part")).mapInArrow(receive, "kind int, part int, rows binary")
    return back.repartitionById(parts, F.col("part")).mapInArrow(add, "key long, doc_id long, rows long, n_shingles long, shared long")


def sets(docs: DataFrame, n: int) -> DataFrame:
    """(doc_id, n, a, b, tokens): set size, digest and sorted shingles of each document that has any."""

    @released
    def run(batches):
        for batch in batches:
            data, offsets = text_bytes(batch.column(1))
            for i, j in chunks(offsets, PIECE):
                tokens, sizes = shingle_sets(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], n)
                a, b = digests(tokens, sizes)
                ends = np.concatenate([[0], np.cumsum(sizes)])
                blobs = [tokens[x:y].astype("<u8").tobytes() for x, y in zip(ends[:-1].tolist(), ends[1:].tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array(sizes), pa.array(a.astype(np.int64)), pa.array(b.astype(np.int64)), pa.array(blobs, pa.binary())], ["doc_id", "n", "a", "b", "tokens"])

    return docs.mapInArrow(run, "doc_id long, n long, a long, b long, tokens binary").where("n > 0")


def needed(n: int, threshold: int) -> int:
    """The least overlap that a set of n needs with any other: ceil(t n)."""
    return -(-threshold * n // 100)


def ordered(classes: DataFrame, threshold: int, parts: int) -> DataFrame:
    """Step 3: (rep, n, m, counts, tokens): shingles that other classes share, by ascending (count, hash); m of them are in the prefix."""

    @released
    def send(batches):
        for batch in batches:
            reps, sizes = np.array(batch.column(0), np.int64), np.array(batch.column(1), np.int64)
            blobs = [np.frombuffer(x, "<u8") for x in batch.column(2).to_pylist()]
            owner = np.repeat(np.arange(len(reps)), [len(x) for x in blobs])
            tokens = np.concatenate(blobs) if blobs else np.zeros(0, U)
            part = (tokens >> U(32)) % U(parts)
            order = np.argsort(part, kind="stable")
            ends = np.searchsorted(part[order], np.arange(parts + 1))
            rows = []
            for p in range(parts):
                own = order[ends[p] : ends[p + 1]]
                if len(own):
                    first = np.flatnonzero(np.diff(owner[own], prepend=-1))
                    who = owner[own][first]
                    rows.append(_sent(0, p, np.stack([reps[who], sizes[who]]), np.diff(np.append(first, len(own))), tokens[own].astype("<u8")))
            yield _batch(rows, _SENT)

    @released
    def receive(batches):
        rows = [r for batch in batches for r in zip(*(c.to_pylist() for c in batch.columns))]
        if not rows:
            return
        tokens = np.concatenate([np.frombuffer(r[4], "<u8") for r in rows])
        owner, size = (np.concatenate([np.repeat(np.frombuffer(r[2], "<i8").reshape(2, -1)[k], np.frombuffer(r[3], "<u4")) for r in rows]) for k in (0, 1))
        rows.clear()
        order = np.argsort(tokens, kind="stable")
        tokens, owner, size = tokens[order], owner[order], size[order]
        first = np.flatnonzero(np.concatenate([[True], tokens[1:] != tokens[:-1]]))
        df = np.diff(np.append(first, len(tokens)))
        df = np.repeat(df, df)
        keep = np.flatnonzero(df > 1)
        home = (mix(owner[keep].astype(U)) % U(parts)).astype(np.int64)
        order = np.argsort(home, kind="stable")
        keep, ends = keep[order], np.searchsorted(home[order], np.arange(parts + 1))
        for p in range(parts):
            k = keep[ends[p] : ends[p + 1]]
            if len(k):
                yield _batch([(p, np.stack([owner[k], size[k], df[k], tokens[k].astype(np.int64)]).astype("<i8").tobytes())], [("part", pa.int32()), ("rows", pa.binary())])

    @released
    def arrange(batches):
        found = [np.frombuffer(x, "<i8").reshape(4, -1) for batch in batches for x in batch.column(1).to_pylist()]
        if not found:
            return
        owner, size, df, tokens = np.concatenate(found, 1)
        found.clear()
        tokens = tokens.astype(U)
        order = np.lexsort((tokens, df, owner))
        owner, size, df, tokens = owner[order], size[order], df[order].astype("<u8"), tokens[order].astype("<u8")
        ends = np.flatnonzero(np.concatenate([[True], owner[1:] != owner[:-1], [True]])).tolist()
        rows = []
        for x, y in zip(ends[:-1], ends[1:]):
            n, m = int(size[x]), y - x
            prefix = m - needed(n, threshold) + 1  # shingles of one class only come before these
            if prefix > 0:
                rows.append((int(owner[x]), n, prefix, df[x:y].tobytes(), tokens[x:y].tobytes()))
            if len(rows) == 2000:
                yield _batch(rows, _ORDERED)
                rows = []
        yield _batch(rows, _ORDERED)

    slices = classes.select("rep", "n", "tokens").mapInArrow(send, SENT).repartitionById(parts, F.col("part")).mapInArrow(receive, "part int, rows binary")
    return slices.repartitionById(parts, F.col("part")).mapInArrow(arrange, "rep long, n long, m long, counts binary, tokens binary")


_ORDERED = [("rep", pa.int64()), ("n", pa.int64()), ("m", pa.int64()), ("counts", pa.binary()), ("tokens", pa.binary())]


def runs(tokens: np.ndarray, low: np.ndarray, high: np.ndarray, reps: np.ndarray, threshold: int):
    """Size intervals of equal tokens, merged where sizes are within the ratio: the merged runs, and edges that tie merged entries."""
    order = np.lexsort((low, tokens))
    tokens, low, high, reps = tokens[order], low[order], high[order], reps[order]
    if not len(tokens):
        return (tokens, low, high, reps), (reps, reps)
    first = np.ones(len(tokens), bool)
    first[1:] = tokens[1:] != tokens[:-1]
    # The largest size so far within the token: offsets by token make one running maximum do.
    span = int(high.max()) + 1
    group = np.cumsum(first) - 1
    top = np.maximum.accumulate(high + group * span) - group * span
    cut = first.copy()
    cut[1:] |= 100 * top[:-1] < threshold * low[1:]
    begin = np.flatnonzero(cut)
    ends = np.append(begin[1:], len(tokens)) - 1
    leader = np.repeat(reps[begin], np.diff(np.append(begin, len(tokens))))
    tied = leader != reps
    return (tokens[begin], low[begin], top[ends], reps[begin]), (leader[tied], reps[tied])


def cluster_edges(sets_: DataFrame, threshold: int, parts: int) -> DataFrame:
    """(src, dst) whose components hold all classes that may link."""

    def unique(a, b):
        pair = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], 1), axis=0)
        return pa.RecordBatch.from_arrays([pa.array(np.full(len(pair), -1, np.int32)), pa.nulls(len(pair), pa.binary()), pa.array(pair[:, 0]), pa.array(pair[:, 1])], ["part", "tokens", "src", "dst"])

    def send(batches):
        held = [[], [], []]
        size = 0

        def flush():
            tokens, sizes, reps = (np.concatenate(x) for x in held)
            (t, low, high, lead), (a, b) = runs(tokens, sizes, sizes, reps, threshold)
            yield unique(a, b)
            part = ((t >> U(20)) % U(parts)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            ends = np.searchsorted(part[order], np.arange(parts + 1))
            rows = [(p, np.stack([t[o].astype(np.int64), low[o], high[o], lead[o]]).astype("<i8").tobytes(), None, None) for p in range(parts) if len(o := order[ends[p] : ends[p + 1]])]
            yield _batch(rows, [("part", pa.int32()), ("tokens", pa.binary()), ("src", pa.int64()), ("dst", pa.int64())])

        for batch in batches:
            for rep, n, m, blob in zip(*(batch.column(k).to_pylist() for k in (0, 1, 2, 3))):
                held[0].append(np.frombuffer(blob, "<u8", m))
                held[1].append(np.full(m, n))
                held[2].append(np.full(m, rep))
                size += m
            if size > 2_000_000:
                yield from flush()
                held, size = [[], [], []], 0
        if size:
            yield from flush()

    def receive(batches):
        rows, ties = [], []
        for batch in batches:
            for part, blob, src, dst in zip(*(c.to_pylist() for c in batch.columns)):
                if blob is None:
                    ties.append((src, dst))
                else:
                    rows.append(np.frombuffer(blob, "<i8").reshape(4, -1))
        if ties:
            yield pa.RecordBatch.from_arrays([pa.array([t[k] for t in ties], pa.int64()) for k in (0, 1)], ["src", "dst"])
        if rows:
            tokens, low, high, reps = np.concatenate(rows, 1)
            _, (a, b) = runs(tokens, low, high, reps, threshold)
            yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["src", "dst"])

    sent = sets_.select("rep", "n", "m", "tokens").mapInArrow(send, "part int, tokens binary, src long, dst long")
    spread = F.when(F.col("part") < 0, F.pmod(F.xxhash64("src", "dst"), F.lit(parts)).cast("int")).otherwise(F.col("part"))
    return sent.repartitionById(parts, spread).mapInArrow(receive, "src long, dst long").distinct()


class Tree:
    """A prefix tree over ordered sets of local token numbers; a node holds a run of tokens that all sets below it share."""

    def __init__(self, sequences: list[np.ndarray], sizes: np.ndarray):
        m = len(sequences)
        self.order = sorted(range(m), key=lambda i: sequences[i].astype(">u4").tobytes())
        # Node 0 is the root. A node's run is tokens up to `depth` of the sequence `of`, from its parent's depth on.
        depth, of, parent, born, end, stack = [0], [0], [-1], [0], [0] * m, [0]
        before = np.zeros(0, np.int64)
        for place, i in enumerate(self.order):
            s = sequences[i]
            k = min(len(s), len(before))
            differ = np.flatnonzero(s[:k] != before[:k])
            k = int(differ[0]) if len(differ) else k
            last = -1
            while depth[stack[-1]] > k:
                last = stack.pop()
            if depth[stack[-1]] < k:  # the shared path ends inside a run: cut it
                depth.append(k)
                of.append(of[last])
                parent.append(stack[-1])
                born.append(born[last])
                parent[last] = len(depth) - 1
                stack.append(len(depth) - 1)
            if len(s) > k:
                depth.append(len(s))
                of.append(i)
                parent.append(stack[-1])
                born.append(place)
                stack.append(len(depth) - 1)
            end[i] = stack[-1]
            before = s
        n = len(depth)
        # Bounds of what lies at or below a node: the longest set stored and the smallest size.
        longest, least, self.sets_at = [0] * n, [1 << 60] * n, {}
        for i in self.order:
            longest[end[i]] = max(longest[end[i]], len(sequences[i]))
            least[end[i]] = min(least[end[i]], int(sizes[i]))
            self.sets_at.setdefault(end[i], []).append(i)
        for v in sorted(range(1, n), key=lambda v: -depth[v]):
            p = parent[v]
            longest[p], least[p] = max(longest[p], longest[v]), min(least[p], least[v])
        self.depth, self.born, self.longest, self.least, self.parent = (np.array(x, np.int64) for x in (depth, born, longest, least, parent))
        self.here = np.zeros(n, bool)
        self.here[list(self.sets_at)] = True
        self.flat = np.concatenate([*sequences, np.zeros(1, np.int64)])
        base = np.concatenate([[0], np.cumsum([len(s) for s in sequences])])[:-1][np.array(of)] if m else np.zeros(n, np.int64)
        self.begin, self.stop = base + np.where(self.parent >= 0, self.depth[self.parent], 0), base + self.depth
        self.kids = np.argsort(self.parent, kind="stable")
        cuts = np.searchsorted(self.parent[self.kids], np.arange(n + 1))
        self.first, self.count = cuts[:-1], np.diff(cuts)

    def children(self, nodes: np.ndarray, overlap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        count = self.count[nodes]
        at = np.repeat(self.first[nodes] - np.cumsum(count) + count, count) + np.arange(int(count.sum()))
        return self.kids[at], np.repeat(overlap, count)

    def probe(self, own: np.ndarray, n: int, member: np.ndarray, threshold: int, before: int | None = None):
        """(set, overlap) of every set that may link with the ordered set own of size n; member marks own's tokens.

        The walk goes down from the root by generations of nodes. With `before`, only subtrees that begin before that place of the order
        are walked."""
        nodes, overlap = np.zeros(1, np.int64), np.zeros(1, np.int64)
        if self.here[0]:
            for i in self.sets_at[0]:
                yield i, 0
        while True:
            nodes, overlap = self.children(nodes, overlap)
            if before is not None:
                early = self.born[nodes] <= before
                nodes, overlap = nodes[early], overlap[early]
            if not len(nodes):
                return
            # What can still be shared when the run begins, and again when it ends.
            rest = len(own) - np.searchsorted(own, self.flat[self.begin[nodes]])
            bound = overlap + np.minimum(rest, self.longest[nodes] - self.depth[self.parent[nodes]])
            alive = (100 + threshold) * bound >= threshold * (n + self.least[nodes])
            nodes, overlap = nodes[alive], overlap[alive]
            if not len(nodes):
                return
            begin, size = self.begin[nodes], self.stop[nodes] - self.begin[nodes]
            ends = np.cumsum(size)
            shared = member[self.flat[np.repeat(begin - ends + size, size) + np.arange(int(ends[-1]))]]
            overlap = overlap + np.add.reduceat(shared, ends - size)
            rest = len(own) - np.searchsorted(own, self.flat[self.stop[nodes] - 1], "right")
            bound = overlap + np.minimum(rest, self.longest[nodes] - self.depth[nodes])
            alive = (100 + threshold) * bound >= threshold * (n + self.least[nodes])
            nodes, overlap = nodes[alive], overlap[alive]
            for k in np.flatnonzero(self.here[nodes]).tolist():
                for i in self.sets_at[int(nodes[k])]:
                    yield i, int(overlap[k])


def join_group(reps: np.ndarray, sizes: np.ndarray, blobs: list[np.ndarray], counts: list[np.ndarray], sides: np.ndarray, threshold: int, every: bool) -> list[tuple[int, int]]:
    """Links inside a group; with two sides only those between them. Unless `every`, links that tie nothing new are left out."""
    tokens, df = np.concatenate(blobs), np.concatenate(counts)
    # The tree takes the global order from its frequent end, where sets share the longest paths.
    order = np.lexsort((tokens, -df.astype(np.int64)))
    new = np.ones(len(order), bool)
    new[1:] = tokens[order[1:]] != tokens[order[:-1]]
    known = int(new.sum())
    at = np.empty(len(order), np.int64)
    at[order] = np.cumsum(new) - 1
    cuts = np.cumsum([len(b) for b in blobs])[:-1]
    sequences = [np.sort(x) for x in np.split(at, cuts)]
    across = bool(sides.any()) and not bool(sides.all())
    stored = np.flatnonzero(sides == 0) if across else np.arange(len(reps))
    probes = np.flatnonzero(sides == 1) if across else np.arange(len(reps))
    tree = Tree([sequences[i] for i in stored], sizes[stored])
    root = list(range(len(reps)))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    member = np.zeros(known, np.int64)
    links = []
    place = np.empty(len(stored), np.int64)
    place[tree.order] = np.arange(len(stored))
    for x in probes.tolist():
        own = sequences[x]
        member[own] = 1
        for k, overlap in tree.probe(own, int(sizes[x]), member, threshold, None if across else int(place[x])):
            y = int(stored[k])
            if (across or place[k] < place[x]) and (100 + threshold) * overlap >= threshold * (int(sizes[x]) + int(sizes[y])):
                a, b = find(x), find(y)
                if every or a != b:
                    links.append((int(reps[x]), int(reps[y])))
                root[a] = b
        member[own] = 0
    return links


def oversized(sets_: DataFrame, clusters: DataFrame, threshold: int, block: int) -> DataFrame | None:
    """The labels of clusters above `block` shingles (all shingles over `block` at most); None if there are none."""
    weight = F.col("m") - 1 + F.expr(f"({threshold} * n + 99) div 100")  # m came from it
    rows = sets_.select(F.col("rep").alias("id"), weight.alias("own")).join(clusters, "id")
    found = saved(rows.groupBy("label").agg(F.sum("own").alias("all")).where(F.col("all") > block).select("label"), "jaccard-oversized")
    return found if found.take(1) else None


def clustered_links(sets_: DataFrame, clusters: DataFrame, big: DataFrame | None, threshold: int, block: int, parts: int, every: bool, across: bool = True) -> DataFrame:
    """Steps 4 and 5: (src, dst) of classes that link; of the large clusters `big` also across blocks, or only inside them."""
    step = float(np.log(100 / threshold))
    rows = sets_.join(clusters.withColumnRenamed("id", "rep"), "rep").withColumn("class", F.floor(F.log(F.col("n").cast("double")) / step + 1e-9).cast("int"))
    if big is None:
        rows = rows.select("*", *[F.lit(0).alias(c) for c in ("blocks", "above", "under", "b")])
    else:
        weight = (F.length("tokens") / 8).cast("long")
        sizes = saved(rows.join(big, "label", "left_semi").groupBy("label", "class").agg(F.sum(weight).alias("own")).withColumn("blocks", F.ceil(F.col("own") / block).cast("int")).select("label", "class", "blocks"), "jaccard-sizes")
        near = sizes.select("label", (F.col("class") - 1).alias("class"), F.col("blocks").alias("above"))
        below = sizes.select("label", (F.col("class") + 1).alias("class"), F.col("blocks").alias("under"))
        plan = saved(sizes.join(near, ["label", "class"], "left").join(below, ["label", "class"], "left"), "jaccard-plan")
        rows = rows.join(plan, ["label", "class"], "left").fillna(0, ["blocks", "above", "under"])
        rows = rows.withColumn("b", F.when(F.col("blocks") > 0, F.pmod(F.xxhash64("rep"), F.col("blocks"))).otherwise(F.lit(0)).cast("int"))

    def places(n, fn):
        return F.when(n > 0, F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0))), fn)).otherwise(F.array().cast("array<struct<ca:int,ba:int,cb:int,bb:int,side:int>>"))

    kind = "struct<ca:int,ba:int,cb:int,bb:int,side:int>"
    me, cls = F.col("b"), F.col("class")
    # Inside a size class every pair of blocks (a block with itself on one side), and every block against those of the next class.
    alone = F.array(F.struct(F.lit(-1).alias("ca"), F.lit(0).alias("ba"), F.lit(-1).alias("cb"), F.lit(0).alias("bb"), F.lit(0).alias("side")).cast(kind))
    within = F.array(F.struct(cls.alias("ca"), me.alias("ba"), cls.alias("cb"), me.alias("bb"), F.lit(0).alias("side")).cast(kind))
    inside = places(F.col("blocks"), lambda j: F.struct(cls.alias("ca"), F.least(me, j).alias("ba"), cls.alias("cb"), F.greatest(me, j).alias("bb"), F.when(me > j, F.lit(1)).otherwise(F.lit(0)).alias("side")).cast(kind))
    upward = places(F.col("above"), lambda j: F.struct(cls.alias("ca"), me.alias("ba"), (cls + 1).alias("cb"), j.alias("bb"), F.lit(0).alias("side")).cast(kind))
    downward = places(F.col("under"), lambda j: F.struct((cls - 1).alias("ca"), j.alias("ba"), cls.alias("cb"), me.alias("bb"), F.lit(1).alias("side")).cast(kind))
    spread = rows.withColumn("place", F.explode(F.when(F.col("blocks") == 0, alone).otherwise(F.concat(inside, upward, downward) if across else within)))
    keyed = spread.select("label", F.col("place.ca").alias("ca"), F.col("place.ba").alias("ba"), F.col("place.cb").alias("cb"), F.col("place.bb").alias("bb"), F.col("place.side").alias("side"), "rep", "n", "counts", "tokens")
    keys = ["label", "ca", "ba", "cb", "bb"]

    @released
    def join(batches):
        now, held = None, []
        links: list = []

        def close():
            if len(held) > 1:
                reps, sizes_, sides = (np.array([h[k] for h in held], np.int64) for k in (1, 2, 0))
                links.extend(join_group(reps, sizes_, [np.frombuffer(h[4], "<u8") for h in held], [np.frombuffer(h[3], "<u8") for h in held], sides, threshold, every))
            held.clear()

        def out():
            got = pa.RecordBatch.from_arrays([pa.array([x[k] for x in links], pa.int64()) for k in (0, 1)], ["src", "dst"])
            links.clear()
            return got

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns)):
                if row[:5] != now:
                    close()
                    now = row[:5]
                held.append(row[5:])
            if links:
                yield out()
        close()
        yield out()

    return keyed.repartition(parts, *keys).sortWithinPartitions(*keys).mapInArrow(join, "src long, dst long")


def large(sets_: DataFrame, clusters: DataFrame, big: DataFrame) -> DataFrame:
    """The sets of the clusters `big`."""
    return saved(sets_.join(clusters.join(big, "label", "left_semi").select(F.col("id").alias("rep")), "rep", "left_semi"), "jaccard-large")


def unsettled(sets_: DataFrame, links: DataFrame) -> DataFrame:
    """The sets that share a prefix shingle with a set of another component of links."""

    def prefixes(batches):
        for batch in batches:
            found = [np.frombuffer(t, "<u8", m) for m, t in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            sizes = [len(f) for f in found]
            tokens = np.concatenate(found).astype(np.int64) if found else np.zeros(0, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.asarray(batch.column(k), np.int64), sizes)) for k in (0, 1)] + [pa.array(tokens)], ["rep", "component", "token"])

    of = connected_components(links).select(F.col("id").alias("rep"), F.col("label").alias("component"))
    tagged = sets_.join(of, "rep", "left").withColumn("component", F.coalesce("component", "rep"))
    told = saved(tagged.select("rep", "component", "m", "tokens").mapInArrow(prefixes, "rep long, component long, token long"), "jaccard-prefixes")
    mixed = told.groupBy("token").agg(F.min("component").alias("a"), F.max("component").alias("b")).where("a <> b").select("token")
    return sets_.join(told.join(mixed, "token").select("rep").distinct(), "rep", "left_semi")


def large_links(sets_: DataFrame, links: DataFrame, threshold: int, block: int, parts: int) -> DataFrame:
    """Step 5 after the blocks of large clusters were joined inside: links that tie what these have not tied."""
    first = links
    of = connected_components(first).select(F.col("id").alias("rep"), F.col("label").alias("component"))
    leaders = saved(sets_.join(of.where("rep <> component"), "rep", "left_anti"), "jaccard-leaders")
    groups = connected_components(cluster_edges(leaders, threshold, parts))
    second = saved(clustered_links(leaders, groups, oversized(leaders, groups, threshold, block), threshold, block, parts, False, across=False), "jaccard-links")
    rest = saved(unsettled(sets_, first.unionAll(second)), "jaccard-rest")
    groups = connected_components(cluster_edges(rest, threshold, parts))
    return second.unionAll(saved(clustered_links(rest, groups, oversized(rest, groups, threshold, block), threshold, block, parts, False), "jaccard-links"))


def similar(docs: DataFrame, n: int = N, threshold: int = THRESHOLD, key: str = "doc_id", text: str = "text", block: int = BLOCK, every: bool = False) -> dict[str, DataFrame]:
    """documents (doc_id, rows, n_shingles, component_id); classes (doc_id, rep); links (src, dst) between classes.

    links is a spanning selection, or with `every` each pair of different linked classes."""
    spark = docs.sparkSession
    parts = partitions(spark)
    source = docs.select(F.col(f"`{key}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text"))
    all_ = saved(counted(source, n, parts), "jaccard-counts")
    able = all_.where(F.col("shared") * 100 >= F.col("n_shingles") * F.col("rows") * threshold).where("n_shingles > 0 and doc_id is not null").select("doc_id").distinct()
    found = saved(sets(source.join(able, "doc_id", "left_semi"), n), "jaccard-sets")
    classes = found.groupBy("a", "b").agg(F.min("doc_id").alias("rep"), F.first("n").alias("n"), F.first("tokens").alias("tokens"))
    sets_ = saved(ordered(classes, threshold, parts), "jaccard-ordered")
    clusters = connected_components(cluster_edges(sets_, threshold, parts))
    big = oversized(sets_, clusters, threshold, block)
    links = saved(clustered_links(sets_, clusters, big, threshold, block, parts, every, across=every), "jaccard-links")
    if big is not None and not every:
        links = links.unionAll(large_links(large(sets_, clusters, big), links, threshold, block, parts))
    # Written first: joined as a table, Spark can split the rows of a hot class.
    reps = saved(found.groupBy("a", "b").agg(F.min("doc_id").alias("rep")), "jaccard-reps")
    members = found.select("doc_id", "a", "b").join(reps, ["a", "b"]).select("doc_id", "rep").distinct()
    members = saved(members, "jaccard-members")
    several = members.groupBy("doc_id").agg(F.min("rep").alias("src"), F.max("rep").alias("last"), F.collect_set("rep").alias("all")).where("src <> last").select("src", F.explode("all").alias("dst"))
    labels = connected_components(links.unionAll(several))
    of = members.join(labels.select(F.col("id").alias("rep"), "label"), "rep", "left").groupBy("doc_id").agg(F.min(F.coalesce("label", "rep")).alias("component_id"))
    documents = all_.join(of, "doc_id", "left").select("doc_id", "rows", F.coalesce("n_shingles", F.lit(0)).alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))
    return {"documents": documents, "classes": members, "links": links}


def components(docs: DataFrame, **options) -> DataFrame:
    """One row per document: doc_id, n_shingles, component_id."""
    return similar(docs, **options)["documents"].withColumn("__again", F.explode(F.sequence(F.lit(1), F.col("rows").cast("int")))).select("doc_id", "n_shingles", "component_id")
