"""Ways to probe more than the home bucket: ordered by quantisation distance, by Hamming distance, or along accepted items."""

from __future__ import annotations

import heapq
from abc import ABC, abstractmethod

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecinity.functions.vectors import matrix
from vecinity.operators.families import HashFamily
from vecinity.operators.search import bucket_pairs, build_index, top_k, verify
from vecinity.plans.lineage import saved


def cheapest_masks(cost: np.ndarray, probes: int) -> list[tuple[float, int]]:
    """The `probes` sets of flipped bits with the smallest summed cost, (cost, mask) ascending; bit 0 of cost is the most significant.

    Up to 14 bits all masks are summed; beyond, sets grow from sorted costs by appending or swapping their last member."""
    m = len(cost)
    if m <= 14:
        masks = np.arange(1 << m)
        sums = ((masks[:, None] >> np.arange(m - 1, -1, -1)) & 1) @ cost
        best = np.lexsort((masks, np.round(sums, 12)))[:probes]
        return [(float(sums[k]), int(masks[k])) for k in best]
    order = np.argsort(cost, kind="stable")
    weight = [1 << (m - 1 - int(b)) for b in order]
    c = cost[order]
    out, heap = [(0.0, 0)], [(float(c[0]), weight[0], 0)]
    while heap and len(out) < probes:
        total, mask, last = heapq.heappop(heap)
        out.append((total, mask))
        if last + 1 < m:
            heapq.heappush(heap, (total + float(c[last + 1]), mask | weight[last + 1], last + 1))
            heapq.heappush(heap, (total - float(c[last]) + float(c[last + 1]), mask ^ weight[last] | weight[last + 1], last + 1))
    return out


def qd_probes(queries: DataFrame, family: HashFamily, probes: int = 20) -> DataFrame:
    """(query_id, table, probe_no, sig, qd): buckets of each table in ascending quantisation distance, the home bucket first."""
    bits = family.bits if hasattr(family, "bits") else family.rows

    def run(batches):
        for batch in batches:
            rows = []
            if len(batch):
                x = matrix(batch.column(1))
                p = np.abs(family.project(x)).reshape(len(x), family.tables, bits)
                home = family.codes(x)[:, :, 0]
                for k, q in enumerate(batch.column(0).to_pylist()):
                    for t in range(family.tables):
                        rows += [(q, t, n, [int(home[k, t]) ^ mask], qd) for n, (qd, mask) in enumerate(cheapest_masks(p[k, t], probes))]
            cols = list(zip(*rows)) if rows else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int32(), pa.list_(pa.int64()), pa.float64()))], ["query_id", "table", "probe_no", "sig", "qd"])

    return family._usable(queries).mapInArrow(run, "query_id long, table int, probe_no int, sig array<long>, qd double")


def qd_search(queries: DataFrame, items: DataFrame, family: HashFamily, probes: int = 20, k: int = 20, index: DataFrame | None = None) -> DataFrame:
    """The k nearest among the items of the first `probes` buckets of each table."""
    index = build_index(items, family) if index is None else index
    found = qd_probes(queries, family, probes).select("query_id", "table", "sig").join(index.withColumnRenamed("id", "item_id"), ["table", "sig"]).select("query_id", "item_id").distinct()
    return top_k(verify(found, queries, items, family.metric), k)


def hamming_search(queries: DataFrame, items: DataFrame, family: HashFamily, k: int = 20) -> DataFrame:
    """The k items with the smallest Hamming distance of codes per query (dist), over all items.

    The query codes are taken in blocks of bounded size, like the vectors of a scan."""
    from vecinity.operators.search import query_blocks

    found = None
    for ids, x in query_blocks(queries):
        shared = items.sparkSession.sparkContext.broadcast((ids, family.codes(x)[:, 0, 0]))

        def run(batches, shared=shared):
            ids, q = shared.value
            for batch in batches:
                if not len(batch):
                    continue
                own, codes = np.asarray(batch.column(0)), family.codes(matrix(batch.column(1)))[:, 0, 0]
                d = np.bitwise_count(q[:, None] ^ codes[None, :]).astype(np.int64)
                keys = d * (len(own) + 1) + np.argsort(np.argsort(own, kind="stable"))[None, :]
                at = np.argpartition(keys, min(k, keys.shape[1]) - 1, axis=1)[:, :k]
                a, b = np.repeat(np.arange(len(ids)), at.shape[1]), at.reshape(-1)
                yield pa.RecordBatch.from_arrays([pa.array(ids[a]), pa.array(own[b]), pa.array(d[a, b])], ["query_id", "item_id", "dist"])

        one = family._usable(items).mapInArrow(run, "query_id long, item_id long, dist long")
        found = one if found is None else found.unionAll(one)
    if found is None:
        return top_k(items.sparkSession.createDataFrame([], "query_id long, item_id long, dist long"), k)
    return top_k(found, k)


class ProbeStrategy(ABC):
    """What a search over rounds asks for next, and when a query has enough."""

    @abstractmethod
    def probes(self, number: int, waiting: DataFrame, answers: DataFrame | None) -> DataFrame | None:
        """(query_id, table, sig) that the waiting queries (id, vec) probe in round `number`, from the answers so far; None ends the search."""

    def finished(self, answers: DataFrame) -> DataFrame | None:
        """(query_id) of queries that ask no more; none by default."""
        return None


class QDProbes(ProbeStrategy):
    """So many buckets a round in ascending quantisation distance, until a query has enough answers."""

    def __init__(self, family: HashFamily, each: int, rounds: int, enough: int | None = None):
        self.family, self.each, self.rounds, self.enough = family, each, rounds, enough

    def probes(self, number, waiting, answers):
        if number >= self.rounds:
            return None
        found = qd_probes(waiting, self.family, self.each * (number + 1)).where(F.col("probe_no") >= self.each * number)
        return found.select("query_id", "table", "sig")

    def finished(self, answers):
        return None if self.enough is None else answers.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= self.enough).select("query_id")


def rounds_search(queries: DataFrame, items: DataFrame, family: HashFamily, strategy: ProbeStrategy, radius: float | None = None, metric=None) -> DataFrame:
    """(query_id, item_id, dist, round): answers of a strategy's probes, each item once per query. Finished queries are skipped, each for itself."""
    index = saved(build_index(items, family), "rounds-index")
    waiting, result, number = queries.select("id", "vec"), None, 0
    while (probes := strategy.probes(number, waiting, result)) is not None:
        found = probes.join(index.withColumnRenamed("id", "item_id"), ["table", "sig"]).select("query_id", "item_id").distinct()
        if result is not None:
            found = found.join(result.select("query_id", "item_id"), ["query_id", "item_id"], "left_anti")
        new = saved(verify(found, queries, items, metric or family.metric, radius).withColumn("round", F.lit(number)), "rounds-answers")
        result = new if result is None else result.unionAll(new)
        if (done := strategy.finished(result)) is not None:
            waiting = queries.select("id", "vec").join(saved(done.withColumnRenamed("query_id", "id"), "rounds-done"), "id", "left_anti")
        number += 1
    if result is None:
        return items.sparkSession.createDataFrame([], "query_id long, item_id long, dist double, round int")
    return result


def expand_search(queries: DataFrame, items: DataFrame, family: HashFamily, radius: float = 0.9, max_iter: int = 5) -> DataFrame:
    """(query_id, item_id, dist, round): items within the radius, found from the query's buckets and then from those of accepted items.

    Runs at most max_iter - 1 rounds or until a round finds nothing. The first round compares in tasks; it leaves the pairs within the radius, told whether
    they shared a bucket. Of those that did not, a round accepts what shares a bucket with an item accepted for the query in the round before: candidates
    beyond the radius, whose number grows with the square of the buckets, are never made into rows. Rounds are written, so lineage stays short."""
    near = saved(bucket_pairs(queries, items, family, radius), "expand-near")
    new = result = near.where("met").select("query_id", "item_id", "dist", F.lit(0).alias("round"))
    waiting = near.where("not met").select("query_id", "item_id", "dist")
    codes = family.signatures(items).groupBy("id").agg(F.collect_list(F.struct("table", "sig")).alias("codes")).select(F.col("id").alias("item_id"), "codes")
    for n in range(1, max(1, max_iter - 1)):
        if not waiting.take(1) or not new.take(1):
            break
        asking = new.join(waiting.select("query_id").distinct(), "query_id", "left_semi").select("query_id", "item_id")
        probes = asking.join(codes, "item_id").select("query_id", F.explode("codes").alias("code")).distinct()
        asked = waiting.join(codes, "item_id").select("query_id", "item_id", F.explode("codes").alias("code"))
        found = asked.join(probes, ["query_id", "code"]).select("query_id", "item_id").distinct()
        round_ = saved(waiting.join(found.withColumn("found", F.lit(True)), ["query_id", "item_id"], "left"), "expand-round")
        new = round_.where("found").select("query_id", "item_id", "dist", F.lit(n).alias("round"))
        waiting = round_.where("found is null").select("query_id", "item_id", "dist")
        result = result.unionAll(new)
    return result
