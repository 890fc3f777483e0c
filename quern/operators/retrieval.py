"""Ranking: BM25, exact dense search, rank fusion, rerank blends and evaluation."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quern.functions.text import words
from quern.operators.sharded import prefix_sum
from quern.session import shuffle_partitions

#: BM25 parameters.
K1, B = 1.5, 0.75
#: Constant of reciprocal rank fusion.
RRF = 60
#: Query vectors that are compared with a tile of the index at once, and vectors of a tile.
BLOCK, TILE = 256, 4096
#: Queries of one block of a lexical search, and documents that are scored with it at once.
QUERIES, SCORED = 512, 512


def top(df: DataFrame, group: str, score: str, tie: str, k: int) -> DataFrame:
    """The k best of each group with their rank, by descending score, then ``tie``.

    Spark prunes each partition to its k best rows before the shuffle.
    """
    rank = F.row_number().over(Window.partitionBy(group).orderBy(F.desc(score), F.asc(tie)))
    return df.withColumn("rank", rank).where(F.col("rank") <= k)


def look_up(asked: DataFrame, index: DataFrame, keys: list[str], order: list[str], k: int) -> DataFrame:
    """(query_id, id, rank, level): up to k index rows at the keys a query names, by the longest run of keys that has any.

    ``asked``: query_id and ``keys``; ``index``: id, ``keys`` and ``order`` (greatest
    first, then the greatest id). The k best of each key are chosen before the join:
    a key with a third of all rows sends k rows to each query and no more. A NULL or
    empty first key finds nothing; a NULL later key is left out of the match.
    """
    best = None
    for n in range(len(keys), 0, -1):
        rank = F.row_number().over(Window.partitionBy(*keys[:n]).orderBy(*[F.desc_nulls_last(c) for c in order], F.desc("id")))
        some = index.where(" AND ".join(f"{c} <> ''" for c in keys[:n])).withColumn("rank", rank).where(F.col("rank") <= k)
        some = some.select("id", "rank", *[F.col(c).alias(f"i_{c}") for c in keys[:n]])
        on = F.lit(True)
        for c in keys[:n]:
            on = on & (F.col(c) == F.col(f"i_{c}"))
        left = asked if best is None else asked.join(best.select("query_id").distinct(), "query_id", "left_anti")
        found = left.join(some, on).select("query_id", "id", "rank", F.lit(n).alias("level"))
        best = found if best is None else best.unionByName(found)
    return best


def _asked(queries: DataFrame) -> list[tuple[list, list[str], np.ndarray]]:
    """Blocks of at most QUERIES queries: (query ids, their terms, terms x queries with 1 where a query has the term).

    ``queries``: query_id, terms. Only one block at a time is held, and sent to the tasks.
    """
    rows = queries.select("query_id", F.sort_array(F.array_distinct("terms")).alias("terms")).orderBy("query_id")
    block = []
    for r in rows.toLocalIterator():
        block.append(r)
        if len(block) == QUERIES:
            yield _block(block)
            block = []
    if block:
        yield _block(block)


def _block(rows: list) -> tuple[list, list[str], np.ndarray]:
    terms = sorted({t for r in rows for t in r.terms or []})
    number = {t: i for i, t in enumerate(terms)}
    has = np.zeros((len(terms), len(rows)), np.float32)
    for q, r in enumerate(rows):
        has[[number[t] for t in r.terms or []], q] = 1
    return [r.query_id for r in rows], terms, has


def _term_counts(batch: pa.RecordBatch, terms: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(document, term, count, length of each document) of the asked terms in a batch of (doc_id, w)."""
    words = batch.column("w")
    lengths = np.diff(words.offsets.to_numpy())
    at = pc.index_in(words.flatten(), value_set=terms).fill_null(-1).to_numpy()
    doc = np.repeat(np.arange(len(lengths)), lengths)[at >= 0]
    pairs = np.sort(doc * len(terms) + at[at >= 0])
    first = np.flatnonzero(np.concatenate([[True], pairs[1:] != pairs[:-1]])) if len(pairs) else np.empty(0, np.int64)
    n = np.diff(np.concatenate([first, [len(pairs)]]))
    return pairs[first] // max(len(terms), 1), pairs[first] % max(len(terms), 1), n, lengths


def _scored(docs: DataFrame, queries: DataFrame, k: int, weigh, learn=None) -> DataFrame:
    """(query_id, doc_id, score, rank): documents scored where they lie, the k best of each task merged.

    ``docs``: doc_id, w (words). ``learn(terms)`` gives what ``weigh(known, document,
    term, count, lengths)`` needs to weigh the occurrences of asked terms; a score is
    the sum of the weights of a query's terms. A task sends k rows for each query,
    however many documents hold its terms. Queries come in blocks of QUERIES, each
    with one pass over the documents.
    """
    found = None
    for ids, terms, has in _asked(queries):
        known = learn(terms) if learn else has
        sent = docs.sparkSession.sparkContext.broadcast((ids, pa.array(terms, pa.string()), has, known))

        def run(batches: Iterator[pa.RecordBatch], sent=sent) -> Iterator[pa.RecordBatch]:
            ids, terms, has, known = sent.value
            best = np.full((len(ids), 0), 0.0), np.full((len(ids), 0), 0, np.int64)
            for whole in batches:
                for start in range(0, len(whole), SCORED):
                    b = whole.slice(start, SCORED)
                    doc, term, n, lengths = _term_counts(b, terms)
                    weights = np.zeros((len(b), len(terms)))
                    weights[doc, term] = weigh(known, doc, term, n, lengths)
                    score = np.round((weights @ has).T, 6)
                    # documents without any term of a query are none of its results
                    touched = (weights > 0).astype(np.float32) @ has > 0
                    score[~touched.T] = -np.inf
                    scores = np.concatenate([best[0], score], axis=1)
                    keys = np.concatenate([best[1], np.broadcast_to(b.column("doc_id").to_numpy(), score.shape)], axis=1)
                    order = np.lexsort((keys, -scores), axis=1)[:, :k]
                    best = np.take_along_axis(scores, order, 1), np.take_along_axis(keys, order, 1)
            q, place = np.nonzero(best[0] > -np.inf)
            yield pa.RecordBatch.from_arrays([pa.array([ids[i] for i in q], pa.int64()), pa.array(best[1][q, place]), pa.array(best[0][q, place])], names=["query_id", "doc_id", "score"])

        part = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "w").mapInArrow(run, "query_id long, doc_id long, score double")
        found = part if found is None else found.unionByName(part)
    if found is None:
        found = docs.select(F.lit(0).cast("long").alias("query_id"), F.col("doc_id").cast("long").alias("doc_id"), F.lit(0.0).alias("score")).limit(0)
    return top(found, "query_id", "score", "doc_id", k)


def bm25(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, doc_id, score, rank): the k best documents of each query, scores rounded to 6 places.

    ``docs``: doc_id (unique), text; ``queries``: query_id, text; query terms count
    once. One pass counts the documents that hold an asked term, and all words; one
    pass scores every document in its task, see ``_scored``. NULL and empty texts have
    no terms.
    """
    tokenized = docs.where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", words(F.col("text")).alias("w"))

    def learn(terms: list[str]) -> tuple[np.ndarray, float]:
        sent = docs.sparkSession.sparkContext.broadcast(pa.array(terms, pa.string()))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, n_docs, n_words = np.zeros(len(terms), np.int64), 0, 0
            for b in batches:
                _, term, _, lengths = _term_counts(b, sent.value)
                held += np.bincount(term, minlength=len(terms))
                n_docs += len(lengths)
                n_words += int(lengths.sum())
            numbers = np.arange(-2, len(terms))
            yield pa.RecordBatch.from_arrays([pa.array(numbers), pa.array(np.concatenate([[n_docs, n_words], held]))], names=["term", "n"])

        # as many rows as asked terms, whatever the corpus
        got = {r.term: r.n for r in tokenized.mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect()}
        n_docs, mean = got.get(-2, 0), got.get(-1, 0) / max(got.get(-2, 0), 1)
        df = np.array([got.get(i, 0) for i in range(len(terms))], float)
        return np.log(1 + (n_docs - df + 0.5) / (df + 0.5)), mean or 1.0

    def weigh(known, doc, term, n, lengths):
        idf, mean = known
        return idf[term] * n / (n + K1 * (1 - B + B * lengths[doc] / mean))

    return _scored(tokenized, queries.select("query_id", words(F.col("text")).alias("terms")), k, weigh, learn)


def overlap(docs: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, doc_id, score, rank): the k documents that hold most of a query's terms, by their share.

    ``docs``: doc_id (unique), w; ``queries``: query_id, terms; both lists of terms,
    each counted once. Scored like ``bm25``.
    """

    def weigh(known, doc, term, n, lengths):
        return np.ones(len(doc))

    counted = _scored(docs, queries, k, weigh)
    sizes = queries.select("query_id", F.size(F.array_distinct("terms")).alias("n"))
    # equal numbers of terms are equal shares, so the order stays
    return counted.join(sizes, "query_id").select("query_id", "doc_id", F.round(F.col("score") / F.col("n"), 6).alias("score"), "rank")


def _cut(rows: DataFrame, name: str) -> tuple[DataFrame, int]:
    """(rows with their cut in ``name``, number of cuts): by hash, about TILE rows each, fewer where that keeps all tasks busy."""
    n, tasks = rows.count(), shuffle_partitions(rows.sparkSession)
    cuts = max(1, -(-n // min(TILE, max(BLOCK, -(-n // tasks)))))
    return rows.withColumn(name, F.pmod(F.xxhash64(*rows.columns), F.lit(cuts)).cast("int")), cuts


def dense(index: DataFrame, queries: DataFrame, k: int = 10) -> DataFrame:
    """(query_id, vec_id, score, rank): exact cosine search, scores rounded to 6 places.

    ``index``: vec_id, embedding; ``queries``: query_id, embedding. Both are cut by hash
    into tiles of about TILE rows; every tile of queries meets every tile of the index
    in a task of its own, by a join on both numbers, and keeps the k best of each query.
    No vector passes through the driver; a vector is shuffled once for each tile of the
    other side. A query does not find itself. NULL and zero vectors are left out.
    """
    asked = queries.where("embedding IS NOT NULL AND query_id IS NOT NULL").select(F.col("query_id").cast("long"), "embedding").distinct()
    rows = index.where("embedding IS NOT NULL AND vec_id IS NOT NULL").select(F.col("vec_id").cast("long"), "embedding").distinct()
    (asked, n_blocks), (rows, n_parts) = _cut(asked, "block"), _cut(rows, "part")
    asked = asked.withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(n_parts - 1))))
    rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(n_blocks - 1))))

    def unit(t: pa.Table, key: str) -> tuple[np.ndarray, np.ndarray]:
        x = np.array(t.column("embedding").to_pylist(), np.float64)
        norms = np.linalg.norm(x, axis=1)
        return t.column(key).to_numpy()[norms > 0], x[norms > 0] / norms[norms > 0, None]

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        out = []
        if left.num_rows and right.num_rows:
            (ids, q), (keys, x) = unit(left, "query_id"), unit(right, "vec_id")
            for start in range(0, len(ids) if len(keys) else 0, BLOCK):
                own = ids[start : start + BLOCK]
                score = np.round(q[start : start + BLOCK] @ x.T, 6)
                score[own[:, None] == keys[None, :]] = -9
                least = -np.partition(-score, min(k, len(keys)) - 1, axis=1)[:, min(k, len(keys)) - 1]
                r, c = np.nonzero((score >= least[:, None]) & (score > -9))
                order = np.lexsort((keys[c], -score[r, c], r))
                r, c = r[order], c[order]
                kept = np.arange(len(r)) - np.searchsorted(r, r) < k
                out.append((own[r[kept]], keys[c[kept]], score[r[kept], c[kept]]))
        columns = [np.concatenate(x) for x in zip(*out, strict=True)] or [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), columns, strict=True)))

    found = asked.groupBy("block", "part").cogroup(rows.groupBy("block", "part")).applyInArrow(run, "query_id long, vec_id long, score double")
    return top(found.distinct(), "query_id", "score", "vec_id", k)


def fuse(channels: DataFrame, weights: dict[str, float]) -> DataFrame:
    """(query_id, id, score, best_rank, rank): weighted reciprocal rank fusion.

    ``channels``: query_id, channel, id, score. In a channel an id counts once, at
    its best score, and is ranked after that; channels of weight 0 or without one
    add nothing. Ties: best rank, then id.
    """
    weight = F.create_map(*[F.lit(x) for kv in weights.items() for x in kv])
    once = channels.groupBy("query_id", "channel", "id").agg(F.max("score").alias("score")).withColumn("w", F.try_element_at(weight, F.col("channel"))).where("w > 0")
    ranked = once.withColumn("r", F.row_number().over(Window.partitionBy("query_id", "channel").orderBy(F.desc("score"), "id")))
    fused = ranked.groupBy("query_id", "id").agg(F.round(F.sum(F.col("w") / (RRF + F.col("r"))), 9).alias("score"), F.min("r").alias("best_rank"))
    return fused.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "best_rank", "id")))


def linear_rerank(df: DataFrame, query: str, relevance: str, others: list[tuple[str, float]], weight: float, tie: str) -> DataFrame:
    """Adds ``blend`` and ``new_rank``: weight * relevance / greatest relevance of the query, plus weighted others."""
    most = F.max(relevance).over(Window.partitionBy(query))
    blend = weight * F.coalesce(F.try_divide(F.col(relevance), most), F.lit(0.0))
    for name, w in others:
        blend = blend + w * F.coalesce(F.col(name).cast("double"), F.lit(0.0))
    scored = df.withColumn("blend", F.round(blend, 6))
    return scored.withColumn("new_rank", F.row_number().over(Window.partitionBy(query).orderBy(F.desc("blend"), tie)))


def ir_metrics(ranked: DataFrame, relevant: DataFrame, k: int) -> DataFrame:
    """(query_id, recall, precision, mrr, ndcg) at k of every query with a relevant id.

    ``ranked``: query_id, id, rank; ``relevant``: query_id, id. Precision divides by
    k; a query without a hit has zeros; repeated ids count once, at their best rank.
    """
    wanted = relevant.select("query_id", "id").distinct()
    totals = wanted.groupBy("query_id").agg(F.count(F.lit(1)).alias("n_relevant"))
    best = ranked.where(F.col("rank") <= k).groupBy("query_id", "id").agg(F.min("rank").alias("rank"))
    hits = best.join(wanted, ["query_id", "id"]).groupBy("query_id").agg(F.count(F.lit(1)).alias("hits"), F.min("rank").alias("first"), F.sum(1 / F.log2(F.col("rank") + 1)).alias("dcg"))
    ideal = F.aggregate(F.sequence(F.lit(1), F.least(F.col("n_relevant"), F.lit(k)).cast("int")), F.lit(0.0), lambda a, i: a + 1 / F.log2(i + 1))
    joined = totals.join(hits, "query_id", "left")
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return joined.select("query_id", zero(F.col("hits") / F.col("n_relevant")).alias("recall"), zero(F.col("hits") / k).alias("precision"), zero(1 / F.col("first")).alias("mrr"), zero(F.col("dcg") / ideal).alias("ndcg"))


def nearest_rank(df: DataFrame, group: str, value: str, percentiles: dict[str, float]) -> DataFrame:
    """(group, one column per percentile): the value at place ceil(p n) of a group's sorted values.

    Equal values are counted before anything is sorted, and a group of any size is
    cut into shards, so no task holds a group. NULL values do not count.
    """
    counted = df.where(F.col(value).isNotNull()).groupBy(group, value).agg(F.count(F.lit(1)).alias("__n"))
    placed = prefix_sum(counted, [group], [value], "__n", "__before")
    totals = counted.groupBy(group).agg(F.sum("__n").alias("__all")).withColumnRenamed(group, "__g")
    at = placed.join(totals, F.col(group).eqNullSafe(F.col("__g")))
    holds = lambda p: (F.col("__before") < F.ceil(p * F.col("__all"))) & (F.ceil(p * F.col("__all")) <= F.col("__before") + F.col("__n"))
    return at.groupBy(group).agg(*[F.max(F.when(holds(p), F.col(value))).alias(name) for name, p in percentiles.items()])


def _mixed(x: np.ndarray) -> np.ndarray:
    """Well-mixed 64-bit numbers of 64-bit numbers (the finalizer of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def bootstrap(values: DataFrame, key: str, value: str, samples: int, seed: int) -> DataFrame:
    """(n, mean, low, high): mean with its 95 % interval from ``samples`` Poisson resamples.

    Weights of a row in the resamples are drawn from a hash of its key, so that the
    result depends neither on the partitioning nor on the order. Every task sums its
    rows, a block at a time, into one pair of arrays; the rows are never gathered.
    """
    # chances of a Poisson weight of at most 0, 1, 2, ... with mean 1
    steps = np.cumsum([np.exp(-1) / math.factorial(i) for i in range(12)])
    salt = _mixed(np.arange(samples, dtype=np.uint64) + np.full(samples, seed, np.uint64) * np.uint64(0x9E3779B97F4A7C15))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, weight = np.zeros(samples), np.zeros(samples)
        for b in batches:
            keys, v = b.column(0).to_numpy().view(np.uint64), b.column(1).to_numpy()
            for start in range(0, len(keys), 256):
                chance = (_mixed(keys[start : start + 256, None] ^ salt[None, :]) >> np.uint64(11)) * 2.0**-53
                w = np.searchsorted(steps, chance, "right").astype(float)
                total += v[start : start + 256] @ w
                weight += w.sum(0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(samples)), pa.array(total), pa.array(weight)], names=["i", "s", "w"])

    rows = values.where(F.col(key).isNotNull() & F.col(value).isNotNull()).select(F.xxhash64(key).alias("h"), F.col(value).cast("double").alias("v"))
    means = rows.mapInArrow(run, "i long, s double, w double").groupBy("i").agg(F.sum("s").alias("s"), F.sum("w").alias("w")).where("w > 0").select((F.col("s") / F.col("w")).alias("m"))
    # as many rows as samples, whatever the data
    at = lambda p: F.expr(f"percentile_disc({p}) WITHIN GROUP (ORDER BY m)")
    interval = means.agg(at(0.025).alias("low"), at(0.975).alias("high")).first()
    ends = [F.round(F.lit(v).cast("double"), 6).alias(k) for k, v in (("low", interval.low), ("high", interval.high))]
    return rows.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("v"), 6).alias("mean")).select("n", "mean", *ends)
