"""Filling containers of fixed capacity with texts, by bin completion.

Items are dealt by hash into groups; in each group a branch-and-bound fills one container after the
other around the largest item left: undominated fillings in order of their waste, pruned where the
waste so far cannot beat the incumbent, which is best-fit decreasing at first. Which sums the items
left can make is one bit set, so that the search never enters a filling that it cannot finish.
Containers that keep space are opened again, and their items go through further rounds in new groups,
until a round makes no container less.
"""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut

#: Items of a group; part of its space that a container may keep without being opened again.
GROUP, OPEN = 1000, 0.01
#: Fillings that the search of a group looks at after its first descent; None searches until the packing is proven best.
RETRIES = 100


def best_fit(sizes: list[int], capacity: int) -> list[list[int]]:
    """Best-fit decreasing: indices of the items of each container."""
    bins: list[list[int]] = []
    space: list[tuple[int, int]] = []
    for i in sorted(range(len(sizes)), key=lambda i: -sizes[i]):
        at = bisect_left(space, (sizes[i], -1))
        if at < len(space):
            free, b = space.pop(at)
        else:
            free, b = capacity, len(bins)
            bins.append([])
        bins[b].append(i)
        insort(space, (free - sizes[i], b))
    return bins


def _sums(sizes: list[int], counts: dict[int, int], most: int) -> list[int]:
    """Of each number of the smallest sizes the sums up to ``most`` that they can make, as bits."""
    mask, out = (1 << (most + 1)) - 1, [1]
    for s in sizes:
        if s > most:
            break
        reach, left, step = out[-1], min(counts[s], most // s), 1
        while left > 0:  # powers of two make every multiple
            take = min(step, left)
            reach |= (reach << (s * take)) & mask
            left, step = left - take, step * 2
        out.append(reach)
    return out


def _made(sums: list[int], sizes: list[int], counts: dict[int, int], k: int, total: int) -> Iterator[tuple[int, ...]]:
    """All choices from the ``k`` smallest sizes that make ``total``, those with the largest items first; there are no dead ends."""
    if total == 0:
        yield ()
        return
    while k > 0:
        k -= 1
        s = sizes[k]
        for m in range(min(counts[s], total // s), 0, -1):
            if sums[k] >> (total - m * s) & 1:
                for rest in _made(sums, sizes, counts, k, total - m * s):
                    yield (s,) * m + rest
        if not sums[k] >> total & 1:
            return


def dominated(filling: tuple[int, ...], free: int, sizes: list[int], counts: dict[int, int]) -> bool:
    """Another item that is left could take the place of some of these, or of none, fill no less, and still fit."""
    one, many = 0, 0  # sums of one of the items, and of several, as bits
    for s in filling:
        many |= (one | many) << s
        one |= 1 << s
    own = Counter(filling)
    for x in sizes:
        if counts[x] > own[x]:
            low = max(0, x - free)
            if many >> low & ((1 << (x - low + 1)) - 1) or (one | 1) >> low & ((1 << (x - low)) - 1):
                return True
    return False


def _looked_at(free: int, sizes: list[int], counts: dict[int, int]) -> Iterator[tuple[int, tuple[int, ...] | None]]:
    """All fillings of ``free`` by waste; None stands for a dominated one, so that whoever asks can count it."""
    sums = _sums(sizes, counts, free)
    left = sums[-1]
    while left:
        total = left.bit_length() - 1
        for n, f in enumerate(_made(sums, sizes, counts, len(sums) - 1, total)):
            # The first of the fullest is never dominated: what takes the place of several items is larger than each of them.
            first = n == 0 and left == sums[-1]
            yield free - total, f if first or not dominated(f, free - total, sizes, counts) else None
        left ^= 1 << total


def fillings(free: int, sizes: list[int], counts: dict[int, int]) -> Iterator[tuple[int, tuple[int, ...]]]:
    """The undominated fillings (waste, sizes) of ``free`` from the distinct ``sizes`` in ascending order, least waste first."""
    return ((w, f) for w, f in _looked_at(free, sizes, counts) if f is not None)


def pack(sizes: list[int], capacity: int, retries: int | None = RETRIES) -> list[list[int]]:
    """Indices of the items of each container; every item fits by itself. Whatever ends the search, a full packing comes back."""
    best = best_fit(sizes, capacity)
    total = sum(sizes)
    least = max(-(-total // capacity), sum(s * 2 > capacity for s in sizes))
    if len(best) <= least:
        return best
    counts: dict[int, int] = {}
    for s in sizes:
        counts[s] = counts.get(s, 0) + 1
    distinct = sorted(counts)

    def take(items: tuple[int, ...], sign: int) -> None:
        for s in items:
            counts[s] -= sign
            if counts[s] == 0:
                distinct.pop(bisect_left(distinct, s))
            elif sign < 0 and counts[s] == 1:
                insort(distinct, s)

    def options() -> Iterator[tuple[int, tuple[int, ...] | None]]:
        """Each filling around the largest item; what is taken meanwhile is given back before the next one is asked for."""
        top = distinct[-1]
        take((top,), 1)
        own, left = list(distinct), dict(counts)
        take((top,), -1)
        return ((w, None if f is None else (top, *f)) for w, f in _looked_at(capacity - top, own, left))

    best_sizes, filled, wasted = None, [], 0
    stack, tried, first = [options()], 0, True
    while stack and (retries is None or tried <= retries):
        nxt = next(stack[-1], None)
        tried += not first
        allowed = (len(best) - 1) * capacity - total  # waste of a packing with one container less
        if nxt is None or wasted + nxt[0] > allowed:  # fillings come by waste: none of the later ones is better
            first = False
            stack.pop()
            if filled:
                waste, items = filled.pop()
                take(items, -1)
                wasted -= waste
            continue
        waste, items = nxt
        if items is None:
            continue
        take(items, 1)
        filled.append(nxt)
        wasted += waste
        if distinct:
            stack.append(options())
            continue
        first = False
        best_sizes = [f for _, f in filled]
        best = [[] for _ in best_sizes]
        if len(best) <= least:
            break
        filled.pop()
        take(items, -1)
        wasted -= waste
    if best_sizes is None:
        return best
    by_size: dict[int, list[int]] = {}
    for i in sorted(range(len(sizes)), reverse=True):
        by_size.setdefault(sizes[i], []).append(i)
    return [[by_size[s].pop() for s in f] for f in best_sizes]


_OUT = "spec string, capacity bigint, container string, id bigint, part int, n_tokens bigint, free bigint"


def _fill(turn: int, retries: int | None):
    def fill(key: tuple, items: pd.DataFrame) -> pd.DataFrame:
        items = items.sort_values(["n_tokens", "id", "part"], ascending=[False, True, True], kind="stable").reset_index(drop=True)
        capacity, sizes = int(items["capacity"].iat[0]), items["n_tokens"].astype(int).tolist()
        out = []
        for k, members in enumerate(pack(sizes, capacity, retries)):
            free = capacity - sum(sizes[i] for i in members)
            out += [(i, f"{turn}-{key[1]}-{k}", free) for i in members]
        at = pd.DataFrame(out, columns=["i", "container", "free"]).set_index("i").sort_index()
        return items.assign(container=at["container"], free=at["free"])[[c.split()[0] for c in _OUT.split(", ")]]

    return fill


def _specs(specs: DataFrame) -> list[tuple[str, int]]:
    return sorted((r.spec, int(r.c)) for r in specs.where("spec IS NOT NULL AND capacity_tokens > 0").groupBy("spec").agg(F.max("capacity_tokens").alias("c")).collect())


def fill_containers(sizes: DataFrame, specs: DataFrame, *, group: int = GROUP, retries: int | None = RETRIES, keep: float = OPEN) -> DataFrame:
    """``(spec, capacity, container, id, part, n_tokens, free)``: each piece of each text, its container and the space left there.

    ``sizes`` is (``id``, ``n_tokens``), ``specs`` (``spec``, ``capacity_tokens``), a short list. A text larger than the container is cut
    into full pieces, which fill containers of their own, and a rest; all others stay whole. ``group``
    items are searched together, ``retries`` fillings are looked at anew in a group, and containers that keep
    more than the part ``keep`` of their space are opened again; with ``retries`` None and all items in
    one group the packing is the best there is. Defined cases: texts without tokens and null ids are in
    no container; rows that repeat an id are one text, the largest; null or non-positive capacities are
    no spec; empty tables give no rows.
    """
    kinds = _specs(specs)
    spark = sizes.sparkSession
    if not kinds:
        return spark.createDataFrame([], _OUT)
    texts = sizes.where("id IS NOT NULL AND n_tokens > 0").groupBy("id").agg(F.max("n_tokens").cast("bigint").alias("n_tokens"))
    each = F.explode(F.array(*[F.struct(F.lit(s).alias("spec"), F.lit(c).cast("bigint").alias("capacity")) for s, c in kinds]))
    split = cut(texts).select("id", "n_tokens", each.alias("s")).select("id", F.col("n_tokens").alias("whole"), "s.*")
    last = F.floor((F.col("whole") - 1) / F.col("capacity")).cast("int")  # index of the last piece
    pieces = split.select("spec", "capacity", "id", "whole", F.explode(F.sequence(F.lit(0), last)).alias("part"), last.alias("last"))
    sized = pieces.select("spec", "capacity", "id", "part", F.when(F.col("part") < F.col("last"), F.col("capacity")).otherwise(F.col("whole") - F.col("last") * F.col("capacity")).alias("n_tokens"))
    full = sized.where("n_tokens = capacity").select("spec", "capacity", F.concat_ws("-", F.lit("0"), "id", "part").alias("container"), "id", "part", "n_tokens", F.lit(0).cast("bigint").alias("free"))
    open_, closed = cut(sized.where("n_tokens < capacity")), full
    n = {r.spec: r["count"] for r in open_.groupBy("spec").count().collect()}
    turn, boxes = 0, None
    while True:
        turn += 1
        groups = F.lit(1)
        for s, _ in kinds:
            groups = F.when(F.col("spec") == s, max(1, -(-n.get(s, 0) // group))).otherwise(groups)
        dealt = open_.withColumn("deal", F.pmod(F.xxhash64("id", "part", F.lit(turn)), groups.cast("bigint")))
        filled = cut(dealt.groupBy("spec", "deal").applyInPandas(_fill(turn, retries), _OUT))
        kept = F.col("free") <= F.col("capacity") * keep
        left = {r.spec: (r.n, r.boxes) for r in filled.where(~kept).groupBy("spec").agg(F.count("*").alias("n"), F.countDistinct("container").alias("boxes")).collect()}
        now = sum(b for _, b in left.values())
        # One group of each spec has seen all that was open, or opening again no longer helps.
        if max(n.values(), default=0) <= group or not left or (boxes is not None and now >= boxes):
            return closed.unionByName(filled)
        closed, boxes, n = closed.unionByName(filled.where(kept)), now, {s: c for s, (c, _) in left.items()}
        open_ = filled.where(~kept).select("spec", "capacity", "id", "part", "n_tokens")


def fill_report(filled: DataFrame) -> DataFrame:
    """Containers, contents and space left by spec, with the number of containers that no packing can beat."""
    boxes = filled.groupBy("spec", "capacity", "container").agg(F.count("*").alias("n"), F.sum("n_tokens").alias("used"), F.max("free").alias("free"))
    total = boxes.groupBy("spec", "capacity").agg(F.count("*").alias("n_containers"), F.sum("n").alias("n_pieces"), F.sum("used").alias("n_tokens"), F.sum("free").alias("free_tokens"))
    return total.withColumn("least_containers", F.ceil(F.col("n_tokens") / F.col("capacity")).cast("bigint")).withColumn("filled", F.round(F.col("n_tokens") / (F.col("n_containers") * F.col("capacity")), 6))
