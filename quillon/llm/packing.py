"""Filling containers of several sizes with texts (problem 6)."""

from __future__ import annotations

from bisect import bisect_left, insort
from itertools import combinations

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Documents packed together in one task; what is left open per task is at most a few containers.
BLOCK = 16_384

#: Tokens at which attention costs as much as all else: a token's cost grows with the length of its sequence.
ATTENTION = 24_576
#: Containers of so many sizes are tried in all combinations, more of them only from each size upwards and downwards.
COMBINED = 4

PLACED = "block long, bin long, capacity long, doc_id long, piece long, start long, tokens long"


def pack_block(sizes: list[int], capacities: list[int], cost=None) -> tuple[list[int], list[int]]:
    """Variable-capacity best-fit of items in descending size: the bin of each item, the capacity of each bin.

    An item goes into the open bin that it fills most closely. Where none holds it, a bin of the size is opened
    whose cost per token is least if the items still to come fill it as far as they can; of equal ones the
    largest. At last each bin is downsized to the smallest capacity that holds its contents. ``cost`` gives the
    cost of a capacity and is the capacity itself if not given. No item may exceed the largest capacity.
    """
    cost = cost or (lambda c: float(c))
    allowed = sorted(set(capacities))
    order = sorted(range(len(sizes)), key=lambda i: -sizes[i])
    left = sum(sizes)
    place, used, room = [0] * len(sizes), [], []  # room: (free, bin) of open bins, ascending
    for i in order:
        size = sizes[i]
        at = bisect_left(room, (size, -1))
        if at < len(room):
            free, bin_ = room.pop(at)
        else:
            fits = [c for c in allowed if c >= size]
            if not fits:
                raise ValueError(f"an item of {size} exceeds the largest capacity")
            free = min(fits, key=lambda c: (cost(c) / min(c, max(left, 1)), -c))
            bin_ = len(used)
            used.append(0)
        place[i] = bin_
        used[bin_] += size
        left -= size
        if free > size:
            insort(room, (free - size, bin_))
    return place, [next(c for c in allowed if c >= u) for u in used]


def attention_cost(capacity: int) -> float:
    """The cost of a whole container: linear in its room, padding included, and quadratic by attention."""
    return capacity * (1 + capacity / ATTENTION)


def pack_jointly(sizes: list[int], capacities: list[int], cost=attention_cost) -> tuple[list[int], list[int]]:
    """``pack_block`` with the choice of container sizes whose containers cost least in all.

    Small containers are cheaper per token if filled, large ones leave less room unused; which of them pay depends
    on the items. So every combination of sizes that holds the largest item is packed and the cheapest kept (of
    equal ones that of fewer sizes). A container is downsized to any permitted size, chosen or not.
    """
    allowed, largest = sorted(set(capacities)), max(sizes, default=1)
    if len(allowed) <= COMBINED:
        choices = [c for n in range(1, len(allowed) + 1) for c in combinations(allowed, n)]
    else:
        choices = [(c,) for c in allowed] + [c for i in range(1, len(allowed)) for c in (tuple(allowed[:i + 1]), tuple(allowed[i - 1:]))]
    best = None
    for chosen in choices:
        if chosen[-1] < largest:
            continue
        place, caps = pack_block(sizes, list(chosen), cost)
        used = [0] * len(caps)
        for b, n in zip(place, sizes):
            used[b] += n
        caps = [next(c for c in allowed if c >= u) for u in used]
        total = sum(map(cost, caps))
        if best is None or total < best[0]:
            best = (total, place, caps)
    if best is None:
        raise ValueError(f"an item of {largest} exceeds the largest capacity")
    return best[1], best[2]


def pack(sized: DataFrame, capacities: list[int], block: int = BLOCK, cost=attention_cost) -> DataFrame:
    """Where each document goes: ``block, bin, capacity, doc_id, piece, start, tokens``.

    ``sized`` has unique ``doc_id`` and ``tokens``. Only a document larger than the largest capacity is split:
    into full containers and a rest that is packed like an item. ``start`` counts tokens within the bin.
    Documents without tokens (null or empty texts) or without id take no place. Documents are dealt to blocks
    by a hash of their id, so that any number of them, of any sizes, is packed in parallel; bins never span
    blocks. Each block chooses its mix of sizes jointly (``pack_jointly``). The number of blocks follows that of
    the documents, so a table that has grown is packed anew as a whole; to keep placements, pack what has come
    since on its own. Repeated ids count as one document of the largest of their sizes.
    """
    if not capacities or min(capacities) < 1:
        raise ValueError("capacities must be positive")
    largest = max(capacities)
    items = sized.where((F.col("tokens") > 0) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("tokens").alias("tokens"))
    blocks = max(1, -(-sized.count() // block))
    dealt = items.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)))

    def run(key: tuple, docs: pd.DataFrame) -> pd.DataFrame:
        docs = docs.sort_values("doc_id")
        ids, pieces, sizes = [], [], []
        for doc, n in zip(docs.doc_id.tolist(), docs.tokens.tolist()):
            for p in range(-(-n // largest)):
                ids.append(doc)
                pieces.append(p)
                sizes.append(min(largest, n - p * largest))
        place, caps = pack_jointly(sizes, capacities, cost)
        at, starts = [0] * len(caps), []
        for b, n in zip(place, sizes):
            starts.append(at[b])
            at[b] += n
        return pd.DataFrame({"block": key[0], "bin": place, "capacity": [caps[b] for b in place], "doc_id": ids, "piece": pieces, "start": starts, "tokens": sizes})

    return dealt.groupBy("block").applyInPandas(run, PLACED)


def named_capacities(pack_capacities: DataFrame, upto: str | None = None) -> dict[int, str]:
    """Sizes and names of the permitted containers, at most ``LIMIT`` of them; ``upto`` leaves out larger ones.
    Containers of equal size are one, which bears all their names."""
    limit = 1000
    rows = pack_capacities.where("capacity_tokens > 0 AND container_name IS NOT NULL").limit(limit + 1).collect()
    if len(rows) > limit:
        raise ValueError(f"more than {limit} container sizes")
    most = next((r.capacity_tokens for r in rows if r.container_name == upto), None)
    if upto is not None and most is None:
        raise ValueError(f"no container {upto!r}")
    names: dict[int, list[str]] = {}
    for r in rows:
        if most is None or r.capacity_tokens <= most:
            names.setdefault(r.capacity_tokens, []).append(r.container_name)
    return {c: ", ".join(sorted(set(n))) for c, n in names.items()}


def fill_report(placed: DataFrame, names: dict[int, str]) -> DataFrame:
    """Per container size: bins, pieces and tokens in them, room, and the share of it that is filled."""
    bins = placed.groupBy("block", "bin", "capacity").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("pieces"))
    name = F.create_map(*(x for c, n in names.items() for x in (F.lit(c), F.lit(n))))
    return (
        bins.groupBy("capacity")
        .agg(F.count("*").alias("bins"), F.sum("pieces").alias("pieces"), F.sum("tokens").alias("tokens"), F.sum("capacity").alias("room"))
        .select(name[F.col("capacity").cast("int")].alias("container_name"), "*", (F.col("tokens") / F.col("room")).alias("filled"))
    )


def check_placement(placed: DataFrame, sized: DataFrame, capacities: list[int]) -> DataFrame:
    """One row of what must hold: documents placed, bins too full, bins larger than their contents need, documents whose
    tokens are not all placed once, and documents split though a container would hold them."""
    largest, sizes = max(capacities), sorted(set(capacities))
    bins = placed.groupBy("block", "bin").agg(F.sum("tokens").alias("held"), F.max("capacity").alias("capacity"))
    need = F.coalesce(*(F.when(F.col("held") <= c, c) for c in sizes), F.lit(largest + 1))
    by_bin = bins.agg(F.count_if(F.col("held") > F.col("capacity")).alias("overfull"), F.count_if(need != F.col("capacity")).alias("oversized"))
    docs = placed.groupBy("doc_id").agg(F.sum("tokens").alias("placed"), F.count("*").alias("pieces"))
    want = sized.where((F.col("tokens") > 0) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max("tokens").alias("tokens"))
    by_doc = want.join(docs, "doc_id", "full").agg(
        F.count("placed").alias("documents"), F.count_if(~F.col("placed").eqNullSafe(F.col("tokens"))).alias("lost"), F.count_if((F.col("pieces") > 1) & (F.col("tokens") <= largest)).alias("needless_splits")
    )
    return by_doc.join(by_bin)  # one row each
