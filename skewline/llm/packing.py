"""Filling fixed-capacity containers with items (problem 6)."""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from skewline.session import written

#: The pattern that splits text before the merges of the rank file (a fixed value).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces packed by one task.
PER_SHARD = 20_000
#: A token's linear cost, and the length at which a document's quadratic cost equals its linear one.
QUADRATIC_AT = 2048.0
#: Shares of the tokens that are tried to be placed by cost alone, and how many more containers than by best fit are borne for it.
SHARES, SLACK = (1.0, 0.8, 0.6, 0.4, 0.2), 0.0025


def _encoding(ranks_path: str):
    import tiktoken

    with open(ranks_path, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, doc_id: str, text: str, ranks_path: str) -> DataFrame:
    """(``doc_id``, ``n_tokens``) of every document with an id; a null text has none. Whole texts, counted where they lie.

    ranks_path: rank file of a public byte-level tokenizer, readable by all executors; it isn't part of the library.
    """
    rows = documents.select(F.col(f"`{doc_id}`").cast("bigint").alias("_doc"), F.col(f"`{text}`").alias("_text")).where("_doc is not null")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoding = _encoding(ranks_path)
        for b in batches:
            sizes = [len(encoding.encode_ordinary(t)) if t else 0 for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(sizes, pa.int32())], names=["_doc", "_tokens"])

    return rows.mapInArrow(count, "_doc bigint, _tokens int").select(F.col("_doc").alias(doc_id), F.col("_tokens").alias("n_tokens"))


def attention_cost(tokens: np.ndarray) -> np.ndarray:
    """Linear plus quadratic cost of attention within a piece."""
    t = tokens.astype(float)
    return t + t * t / QUADRATIC_AT


def assigned(sizes: np.ndarray, capacity: int, share: float = 1.0) -> np.ndarray:
    """Container number (from 0) of each piece, in descending order: the first ``share`` of all tokens go to the cheapest container with
    room, the rest to the one with the least room that does.

    As many containers as the tokens fill are open from the start; a piece that fits none opens another. Of equal ones the lowest
    number is taken, so the result depends on the sizes alone. Containers too full for the current piece wait until
    pieces are small enough, so each is looked at once per piece it gets.
    """
    order = np.argsort(-sizes, kind="stable")
    used = max(1, -(-int(sizes.sum()) // capacity))
    room, cost = [capacity] * used, [0.0] * used
    price = attention_cost(sizes).tolist()
    out = np.zeros(len(sizes), np.int64)
    by_cost = [(0.0, k) for k in range(used)]
    by_room: list[list[int]] = [[] for _ in range(capacity + 1)]
    some = np.zeros(capacity + 1, bool)
    left, rest, smallest = int(sizes.sum()), (1 - share) * float(sizes.sum()), capacity

    def wait(k: int) -> None:
        heapq.heappush(by_room[room[k]], k)
        some[room[k]] = True

    def tightest(n: int) -> int:
        r = n + int(np.argmax(some[n:]))
        if not some[r]:
            return -1
        k = heapq.heappop(by_room[r])
        some[r] = bool(by_room[r])
        return k

    def cheapest(n: int) -> int:
        while by_cost:
            c, k = heapq.heappop(by_cost)
            if room[k] >= n:
                return k
            wait(k)
        return -1

    for i in order.tolist():
        n = int(sizes[i])
        if left > rest:
            # containers whose room is enough for a piece as small as this one
            for r in np.flatnonzero(some[n : smallest + 1]) + n:
                for k in by_room[r]:
                    heapq.heappush(by_cost, (cost[k], k))
                by_room[r], some[r] = [], False
            smallest = n
            k = cheapest(n)
        else:
            for _, k in by_cost:
                wait(k)
            by_cost = []
            k = tightest(n)
        if k < 0:
            k = used
            used += 1
            room.append(capacity)
            cost.append(0.0)
        room[k] -= n
        cost[k] += price[i]
        out[i] = k
        if left > rest and room[k] >= n:
            heapq.heappush(by_cost, (cost[k], k))
        else:
            wait(k)
        left -= n
    return out


def pack(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """Container number of each piece: by cost as far as that takes at most SLACK more containers than best fit does.

    Levelled by cost alone, containers keep a little room each that no piece fits. So the cheapest container with room is taken for the largest
    pieces, of the greatest of SHARES that keeps to the bound; smaller ones then fill up what is left.
    """
    if not len(sizes):
        return np.zeros(0, np.int64)
    best = assigned(sizes, capacity, 0.0)
    for share in SHARES:
        out = assigned(sizes, capacity, share)
        if len(np.unique(out)) <= len(np.unique(best)) * (1 + SLACK):
            return out
    return best


def packed(counts: DataFrame, budgets: DataFrame, doc_id: str = "doc_id", per_shard: int = PER_SHARD) -> DataFrame:
    """Assignment of every document to containers of each budget's capacity.

    counts: (``doc_id``, ``n_tokens``); budgets: (``budget_id``, ``capacity_tokens``). Result: ``budget_id``,
    ``container_id`` (unique within a budget: shard and number), ``doc_id``, ``piece_no``, ``start_token``, ``n_tokens``.
    A document larger than the capacity is split into pieces of the capacity and a rest; no other is. Full pieces are
    containers of their own. Documents without tokens (null or empty texts) get no container.

    Method: cost-balanced packing, see ``pack`` and ``assigned``. Scale: only ids and sizes are shuffled, by budget and a hash of the
    document; each task packs about ``per_shard`` documents, so a container mixes documents of one shard and each
    shard leaves at most a few part-filled containers. The result is the same whenever it is run.
    """
    sized = counts.select(F.col(f"`{doc_id}`").alias("_doc"), F.col("n_tokens").cast("bigint").alias("_tokens")).where("_doc is not null and _tokens > 0")
    sized = written(sized, "token-counts")
    shards = max(1, -(-sized.count() // per_shard))
    capacities = budgets.select("budget_id", F.col("capacity_tokens").cast("bigint").alias("_capacity")).where("_capacity > 0").dropDuplicates(["budget_id"])
    cells = F.transform(
        F.sequence(F.lit(0), ((F.col("_tokens") - 1) / F.col("_capacity")).cast("int")),
        lambda k: F.struct(
            k.alias("piece_no"),
            (k * F.col("_capacity")).alias("start_token"),
            F.least(F.col("_capacity"), F.col("_tokens") - k * F.col("_capacity")).alias("n_tokens"),
        ),
    )
    # the budgets are a fixed, stated list of capacities: each is applied to all documents
    listed = [(r["budget_id"], r["_capacity"]) for r in capacities.orderBy("budget_id").toLocalIterator()]
    each = F.array(*[F.struct(F.lit(b).alias("budget_id"), F.lit(c).cast("bigint").alias("_capacity")) for b, c in listed])
    if not listed:
        each = F.array().cast("array<struct<budget_id:int,_capacity:bigint>>")
    pieces = (
        sized.select("_doc", "_tokens", F.pmod(F.xxhash64("_doc"), F.lit(shards)).cast("int").alias("_shard"), F.inline(each))
        .select("budget_id", "_capacity", "_shard", "_doc", F.inline(cells))
    )
    whole = pieces.where("n_tokens = _capacity")
    rest = pieces.where("n_tokens < _capacity")

    def assign(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["_doc", "piece_no"], kind="stable")
        number = pack(frame["n_tokens"].to_numpy(), int(frame["_capacity"].iloc[0]))
        return frame.assign(container_id=[f"{s}-{k}" for s, k in zip(frame["_shard"], number, strict=True)])[
            ["budget_id", "container_id", "_doc", "piece_no", "start_token", "n_tokens"]
        ]

    filled = rest.groupBy("budget_id", "_shard").applyInPandas(
        assign, "budget_id int, container_id string, _doc bigint, piece_no int, start_token bigint, n_tokens bigint"
    )
    alone = whole.select("budget_id", F.concat_ws("-", F.lit("d"), "_doc", "piece_no").alias("container_id"), "_doc", "piece_no", "start_token", "n_tokens")
    return filled.unionByName(alone).withColumnRenamed("_doc", doc_id)


def packing_summary(assignment: DataFrame, budgets: DataFrame) -> DataFrame:
    """Per budget: containers, pieces, tokens and the share of the containers' capacity that is filled."""
    totals = assignment.groupBy("budget_id").agg(
        F.count_distinct("container_id").alias("n_containers"), F.count(F.lit(1)).alias("n_pieces"), F.sum("n_tokens").alias("n_tokens")
    )
    return totals.join(F.broadcast(budgets.select("budget_id", "capacity_tokens").dropDuplicates(["budget_id"])), "budget_id").withColumn(
        "filled", F.col("n_tokens") / (F.col("n_containers") * F.col("capacity_tokens"))
    )
