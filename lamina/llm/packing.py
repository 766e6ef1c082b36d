"""Texts into containers of a fixed number of tokens.

Texts are measured by a public tokenizer in one pass over the data; packing sees their sizes alone. What is larger than a
container is cut into full containers and a rest, which is packed like any other text. Items are spread evenly over
shards by a hash; in each, sum-of-squares packing takes them one by one: an array counts the open containers of each fill
level, and an item goes where the sum of the squared counts becomes smallest. What stays open at the end, about a
thousand containers whatever the shard's size, is emptied and packed once more, largest item into the fullest container
that holds it.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lamina.session import spread, written

CAPACITY = 4096
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: Fixed value: the splitting pattern that belongs to the vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Items of one shard on average. A shard is one task; it holds two numbers per item.
SHARD_ITEMS = 100_000
#: Containers that are less full at the end of a shard are packed again.
FULL_ENOUGH = 0.98


def tokenizer(vocabulary: str = VOCABULARY):
    import tiktoken

    with open(vocabulary, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("lamina", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


def token_counts(documents: DataFrame, doc_id: str, text: str, vocabulary: str = VOCABULARY) -> DataFrame:
    """(``doc_id``, ``n_tokens``, ``h``, a hash of the row) of whole texts; null and empty texts have no tokens."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import regex

        encoding, pattern = tokenizer(vocabulary), regex.compile(PATTERN)

        def size(x: str | None) -> int:
            if not x:
                return 0
            try:
                return len(encoding.encode_ordinary(x))
            except BaseException as e:  # the tokenizer's own matcher gives up on very long runs of blanks, and says so by no Exception
                if isinstance(e, (KeyboardInterrupt, SystemExit)):
                    raise
                # The same cut by another matcher, so that the count stays the tokenizer's.
                return sum(len(encoding._encode_single_piece(m.group())) for m in pattern.finditer(x))

        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([size(x) for x in batch.column(1).to_pylist()], pa.int64()), batch.column(2)], names=["doc_id", "n_tokens", "h"])

    rows = spread(documents.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))).select("doc_id", "text", F.xxhash64("doc_id", "text").alias("h"))
    return rows.mapInArrow(run, f"doc_id {rows.schema['doc_id'].dataType.simpleString()}, n_tokens bigint, h bigint")


def pack(sizes: np.ndarray, capacity: int = CAPACITY) -> np.ndarray:
    """The container of each item, none of which is larger than the capacity. Sum-of-squares online packing, then once more what
    stayed open."""
    container = np.zeros(len(sizes), np.int64)
    count = np.zeros(capacity + 1, np.int64)  # open containers by fill level
    opened: list[list[int]] = [[] for _ in range(capacity + 1)]
    made = 0
    never = np.int64(1) << 60
    for k, s in enumerate(sizes.tolist()):
        if s == 0:
            continue
        room = capacity - s
        best, level = 2 * int(count[s]) + 1 if s < capacity else 0, 0
        if room:
            here = count[1 : room + 1]
            cost = np.where(here > 0, 2 * (count[1 + s : room + 1 + s] - here) + 2, never)
            if here[-1] > 0:
                cost[-1] = 1 - 2 * here[-1]  # it becomes full and is open no more
            at = int(cost.argmin())
            if cost[at] <= best:
                level = at + 1
        if level:
            which = opened[level].pop()
            count[level] -= 1
        else:
            which, made = made, made + 1
        if level + s < capacity:
            opened[level + s].append(which)
            count[level + s] += 1
        container[k] = which
    loose = {c for level in range(1, int(FULL_ENOUGH * capacity)) for c in opened[level]}
    if loose:
        first = container.copy()
        free = sorted(loose, reverse=True)
        again = np.flatnonzero(np.isin(container, list(loose)) & (sizes > 0))
        again = again[np.lexsort((again, -sizes[again]))]
        # Fullest container that holds the item, largest items first, over the same levels.
        count[:] = 0
        opened = [[] for _ in range(capacity + 1)]
        for k in again.tolist():
            s = int(sizes[k])
            fits = np.flatnonzero(count[1 : capacity - s + 1])
            if len(fits):
                level = int(fits[-1]) + 1
                which = opened[level].pop()
                count[level] -= 1
            elif free:
                which, level = free.pop(), 0
            else:
                container = first  # best fit would need more containers than are loose
                break
            opened[level + s].append(which)
            count[level + s] += 1
            container[k] = which
    return np.unique(container, return_inverse=True)[1].astype(np.int64) if len(container) else container


def packed(documents: DataFrame, doc_id: str = "doc_id", text: str = "text", capacity: int = CAPACITY, vocabulary: str = VOCABULARY) -> DataFrame:
    """One row per piece: ``doc_id``, ``piece``, ``container_id``, ``slot`` (its place among the container's pieces), ``start`` (its first token in the
    container), ``from_token`` (its first token in the text), ``n_tokens``.

    A text that fits is one piece. A larger one is cut at multiples of the capacity; its full pieces have containers of their
    own. Shards are dealt by a hash of id and text. Defined results: null and empty texts take no room and stand in the shard's first
    container; ids that occur twice are packed each, as pieces of their own; an empty table gives an empty result. The same data give the same containers.
    """
    counts = written(token_counts(documents, doc_id, text, vocabulary), "token-counts")
    shards = max(1, -(-counts.count() // SHARD_ITEMS))
    rows = counts.withColumn("shard", F.pmod(F.xxhash64("h", F.lit(7)), F.lit(shards)).cast("bigint"))
    kind = counts.schema["doc_id"].dataType.simpleString()

    def run(key: tuple, shard: pd.DataFrame) -> pd.DataFrame:
        shard = shard.sort_values(["h", "doc_id", "n_tokens"], kind="stable", ignore_index=True)
        n = shard["n_tokens"].to_numpy()
        full, rest = n // capacity, n % capacity
        pieces = full + ((rest > 0) | (n == 0))
        row = np.repeat(np.arange(len(n)), pieces)
        piece = np.arange(len(row)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        size = np.where(piece < full[row], capacity, rest[row])
        whole = size == capacity
        where = np.zeros(len(row), np.int64)
        where[~whole] = pack(size[~whole], capacity)
        made = int(where[~whole].max()) + 1 if (~whole).any() else 0
        where[whole] = made + np.arange(int(whole.sum()))
        order = np.lexsort((np.arange(len(row)), size == 0, where))
        first = np.r_[True, where[order][1:] != where[order][:-1]]
        begin = np.maximum.accumulate(np.where(first, np.arange(len(order)), 0))
        before = np.cumsum(size[order]) - size[order]
        out = pd.DataFrame({"doc_id": shard["doc_id"].to_numpy()[row[order]], "piece": piece[order], "container_id": (int(key[0]) << 32) + where[order], "slot": np.arange(len(order)) - begin, "start": before - before[begin], "from_token": piece[order] * capacity, "n_tokens": size[order]})
        return out

    rows = rows.repartition(shards, "shard")  # a number that is given isn't coalesced
    return rows.groupBy("shard").applyInPandas(run, f"doc_id {kind}, piece bigint, container_id bigint, slot bigint, start bigint, from_token bigint, n_tokens bigint").withColumnRenamed("doc_id", doc_id)


def checked(documents: DataFrame, doc_id: str = "doc_id", capacity: int = CAPACITY, **how) -> DataFrame:
    """What must hold of a packing, one row per ``doc_id``: ``whole`` (one piece, unless larger than a container), ``fits`` (its containers hold
    at most the capacity), ``in_place`` (slots, starts and pieces follow each other without gaps)."""
    rows = packed(documents, doc_id, capacity=capacity, **how)
    slots, pieces = Window.partitionBy("container_id").orderBy("slot"), Window.partitionBy(doc_id).orderBy("piece")
    before = lambda w: F.coalesce(F.sum("n_tokens").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    seen = rows.withColumns({"total": F.sum("n_tokens").over(Window.partitionBy("container_id")), "s": F.row_number().over(slots) - 1, "a": before(slots), "p": F.row_number().over(pieces) - 1, "b": before(pieces)})
    place = (F.col("slot") == F.col("s")) & (F.col("start") == F.col("a")) & (F.col("piece") == F.col("p")) & (F.col("from_token") == F.col("b"))
    return seen.groupBy(doc_id).agg(((F.count(F.lit(1)) == 1) | (F.sum("n_tokens") > capacity)).alias("whole"), (F.max("total") <= capacity).alias("fits"), F.min(place).alias("in_place"))
