"""Exact top-k inner-product search: exhaustive term-at-a-time accumulation over blocks.

Vectors are sparse rows of integer weights: component x becomes floor(scale * x), zeros are no postings.  Rows are
packed into blocks; each block of queries meets each block of candidates once.  Inside a pair of blocks every term
(dimension) scatters query weight x posting weight into a dense score array, a partition selects each query's best
candidates of the block, and a bounded merge keeps the best of all blocks.

Defined results: a vector that is null, or holds a null or a non-finite component, takes no part; an empty vector
scores 0 with all; vectors of different lengths share their leading dimensions; rows with the same id count as the
query's own, and equal (id, vector) rows count once, before anything is ranked; an id with several vectors takes part
with each of them, as a candidate and as a query, whose results are ranked together; ties go to the smaller id; an
empty table gives an empty result; extra columns are ignored; a very long vector counts whole.  Weights of any size are exact (a
block with large ones holds them as doubles, which whole numbers beyond 2^53 that come from doubles are), and a query
whose scores in a block might leave 64 bits is scored with Python's integers; only a result that does fails.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ebbflow.llm.common import cut

#: Vectors of a candidate block and of a query block: what one task holds, whatever the table.
CANDIDATE_BLOCK = 4096
QUERY_BLOCK = 512
#: What larger scores count as: they fail if they are among the results, and lose to none that does not.
WIDEST = 10**38 - 1
BLOCK = "ids binary, width int, kind string, weights binary"


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """id, weights (whole numbers, as doubles) of the vectors that take part."""
    v = F.col(f"`{vector_col}`")
    whole = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    rows = vectors.select(F.col(f"`{id_col}`").cast("long").alias("id"), v.alias("v")).filter(F.col("id").isNotNull() & F.col("v").isNotNull() & whole.eqNullSafe(True))
    scaled = F.transform("v", lambda x: x.cast("double") * scale)
    return rows.select("id", F.transform(scaled, lambda y: F.when(F.abs(y) < float(1 << 53), F.floor(y).cast("double")).otherwise(y)).alias("weights"))


def _pack(size: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """Blocks of `size` vectors, over the borders of batches."""

    def block(part: pa.Table) -> pa.RecordBatch:
        rows = part["weights"].to_pylist()
        width = max(map(len, rows))
        dense = np.zeros((width, len(rows)))
        for i, row in enumerate(rows):
            dense[: len(row), i] = row
        largest = float(np.abs(dense).max()) if width else 0.0
        kind = "<i4" if largest < 1 << 31 else "<i8" if largest < 1 << 62 else "<f8"
        ids = np.asarray(part["id"].to_numpy(), "<i8")
        return pa.RecordBatch.from_arrays([pa.array([ids.tobytes()], pa.binary()), pa.array([width], pa.int32()), pa.array([kind]), pa.array([dense.astype(kind).tobytes()], pa.binary())], names=["ids", "width", "kind", "weights"])

    def pack(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            held.append(batch)
            if sum(map(len, held)) < size:
                continue
            whole = pa.Table.from_batches(held)
            full = len(whole) // size * size
            for at in range(0, full, size):
                yield block(whole.slice(at, size))
            held = whole.slice(full).to_batches()
        if rest := sum(map(len, held)):
            yield block(pa.Table.from_batches(held).slice(0, rest))

    return pack


def _weights(data: bytes, kind: str, width: int, n: int) -> np.ndarray:
    """A block's weights (terms x vectors)."""
    return np.frombuffer(data, kind).reshape(width, n)


def _largest(weights: np.ndarray) -> list[int]:
    """The largest absolute weight of each term."""
    return [max(int(high), -int(low)) for high, low in zip(weights.max(axis=1), weights.min(axis=1), strict=True)] if weights.size else []


def score_block(query: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Scores (queries x candidates) by term: each term's postings are scattered, times the query weight, into dense arrays."""
    scores = np.zeros((query.shape[1], candidates.shape[1]), np.int64)
    for t in range(min(len(query), len(candidates))):
        users, postings = np.flatnonzero(query[t]), np.flatnonzero(candidates[t])
        weights = candidates[t, postings].astype(np.int64)
        if len(postings) == candidates.shape[1]:
            for q in users:
                scores[q] += int(query[t, q]) * weights
        else:
            for q in users:
                scores[q, postings] += int(query[t, q]) * weights
    return scores


def exact_scores(query: np.ndarray, candidates: np.ndarray) -> np.ndarray:
    """Scores of one query by Python's integers, term by term."""
    scores = np.zeros(candidates.shape[1], object)
    for t in range(min(len(query), len(candidates))):
        postings = np.flatnonzero(candidates[t])
        if query[t] and len(postings):
            scores[postings] += int(query[t]) * np.array([int(w) for w in candidates[t, postings]], object)
    return scores


def best(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k highest scores, ties to the smaller id, in no order."""
    if len(scores) <= k:
        return np.arange(len(scores))
    cut = np.partition(scores, len(scores) - k)[len(scores) - k]
    above = np.flatnonzero(scores > cut)
    level = np.flatnonzero(scores == cut)
    return np.concatenate((above, level[np.argsort(ids[level], kind="stable")[: k - len(above)]]))


def _search(k: int) -> Callable[[Iterable[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def search(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                q_ids, ids = np.frombuffer(row["q_ids"], "<i8"), np.frombuffer(row["ids"], "<i8")
                query, cands = _weights(row["q_weights"], row["q_kind"], row["q_width"], len(q_ids)), _weights(row["weights"], row["kind"], row["width"], len(ids))
                large = _largest(cands)
                fits = sum(a * b for a, b in zip(_largest(query), large, strict=False)) < 1 << 63
                out_q, out_v, out_s = [], [], []
                for a in range(0, len(q_ids), 64):
                    some = query[:, a : a + 64]
                    exact = [] if fits else [i for i in range(some.shape[1]) if sum(abs(int(x)) * b for x, b in zip(some[:, i], large, strict=False)) >= 1 << 63]
                    scores = score_block(np.delete(some, exact, axis=1), cands) if len(exact) < some.shape[1] else []
                    lines = iter(scores)
                    for i in range(some.shape[1]):
                        line = exact_scores(some[:, i], cands) if i in exact else next(lines)
                        own = q_ids[a + i]
                        others = ids != own
                        at = np.flatnonzero(others)[best(line[others], ids[others], k)] if not others.all() else best(line, ids, k)
                        out_q.append(np.full(len(at), own))
                        out_v.append(ids[at])
                        out_s.append([int(x) for x in line[at]])
                cols = [np.concatenate(x).astype(np.int64) if x else np.zeros(0, np.int64) for x in (out_q, out_v)]
                # a score beyond 64 bits may still give way to better ones of other blocks: texts of decimal(38)'s limits and beyond
                found = pa.array([str(min(max(s, -WIDEST), WIDEST)) for line in out_s for s in line], pa.string())
                yield pa.RecordBatch.from_arrays([pa.array(cols[0]), pa.array(cols[1]), found], names=["query_id", "vec_id", "score"])

    return search


def search(vectors: DataFrame, is_query: str, k: int = 5, scale: int = 256, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank (from 1), vec_id, score of the k best candidates of every query; is_query is SQL over `id`."""
    # equal rows go before blocks keep their k best; written, so that a lost task packs the same blocks again
    rows = cut(quantised(vectors, id_col, vector_col, scale).distinct())
    candidates = rows.mapInArrow(_pack(CANDIDATE_BLOCK), BLOCK)
    queries = rows.filter(is_query).mapInArrow(_pack(QUERY_BLOCK), BLOCK)
    pairs = block_pairs(queries, candidates)
    hits = pairs.mapInArrow(_search(k), "query_id long, vec_id long, score string").withColumn("score", F.col("score").cast("decimal(38,0)"))
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    top = hits.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
    beyond = F.abs(F.col("score")) > (1 << 63) - 1
    score = F.when(beyond, F.raise_error(F.lit("components are too large: a score does not fit in 64 bits"))).otherwise(F.col("score").cast("long"))
    return top.select("query_id", "rank", "vec_id", score.alias("score"))


def block_pairs(queries: DataFrame, candidates: DataFrame, query_share: float = 0.02) -> DataFrame:
    """Every query block beside every candidate block, once, dealt over a grid of cells.

    Query blocks have a row of the grid and are sent to all its cells; candidate blocks have a column and are sent to
    all its cells.  The grid has twice as many cells as there are shuffle partitions; its shape keeps what both sides
    send least when queries are `query_share` of all rows.  Rows are whole blocks, thousands of vectors each.
    """
    cells = 2 * int(candidates.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    down = max(1, round((cells * query_share) ** 0.5))
    across = -(-cells // down)
    deal = lambda n: F.pmod(F.xxhash64("ids"), F.lit(n))
    q = queries.select(F.col("ids").alias("q_ids"), F.col("width").alias("q_width"), F.col("kind").alias("q_kind"), F.col("weights").alias("q_weights"), (deal(down) * across).alias("row"), F.explode(F.sequence(F.lit(0), F.lit(across - 1))).alias("column"))
    c = candidates.select("ids", "width", "kind", "weights", deal(across).alias("column"), F.explode(F.sequence(F.lit(0), F.lit(down - 1))).alias("row"))
    q = q.select("q_ids", "q_width", "q_kind", "q_weights", (F.col("row") + F.col("column")).alias("cell"))
    c = c.select("ids", "width", "kind", "weights", (F.col("row") * across + F.col("column")).alias("cell"))
    return c.join(q.hint("shuffle_hash"), "cell").drop("cell")
