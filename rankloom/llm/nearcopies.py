"""Near-duplicate texts by pigeonhole blocks of fingerprints.

A text's fingerprint is a row of min-wise hashes of its word runs. It is split into blocks of a few
hashes; texts that are close share at least one whole block, so that texts meet where their blocks
are equal, the Hamming distance of a bit fingerprint is verified there, and the exact share of common
runs decides at last. Every run counts in all three, however many texts it occurs in: what the
members of a large version group share is as frequent as boilerplate, and nothing but the pair
itself tells them apart. Exact copies are one class from the start.

How many hashes make a block follows from the number of texts and from how much unrelated ones have
in common: longer blocks let fewer of these meet, and their number grows so that a pair at the asked
share is missed with the same small probability ``MISS`` at any size. The rows of all blocks together
would be many times the texts, so that only some blocks are written at once: the words are kept as
numbers, each pass makes its own hashes of them, and its files are gone before the next.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..plans.lineage import cut, release
from .wordhash import GOLD, MIX, code_points, hashes, in_word, mixed, property_of, seed, seeds

#: Probability that a pair of exactly the asked share has no block in common.
MISS = 1e-4
#: Bits of the verified fingerprint, and how many deviations more than expected at the asked share may differ.
BITS, DEVIATIONS = 512, 4
#: Rounds in which all runs are dealt to the hashes; what stays empty after them is hashed by itself.
ROUNDS = 12
#: Texts whose fingerprints tell how much unrelated texts have in common (a hashed sample).
SAMPLE = 512
#: Costs of a block and of a meeting that the plan of the blocks weighs, in microseconds.
BLOCK_COST, PAIR_COST = 3.0, 0.06
#: Cost of reading a text's words once more in a further pass, in microseconds.
PASS_COST = 25.0
#: Bytes of a row in the files of a pass besides its 8 for each block, and block rows of one partition.
ROW, PART_ROWS = 80, 4_000_000
#: The rows of a pass take at most so many times what the kept words take, or so many bytes if that is more.
PASS_SHARE, PASS_LEAST = 2.0, 256_000_000
#: Members of one block that are compared in one task; larger blocks are split into tiles.
TILE = 512
_WORDS = [f"x{k}" for k in range(BITS // 64)]


class _Hasher:
    """Hashes of word runs of many texts at a time."""

    def __init__(self, run: int) -> None:
        self.run = run

    def word_hashes(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the words of all texts one after the other, and how many each text has."""
        cp, begins = code_points([t.lower() for t in texts])
        h, starts, _ = hashes(cp, property_of(cp, in_word).astype(bool))
        return h, np.diff(np.searchsorted(starts, begins))

    def many(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of the runs of all texts one after the other, repeated ones too, and how many each text has."""
        return self.runs(*self.word_hashes(texts))

    def runs(self, h: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``many`` of texts with the word hashes ``h``, ``n`` of each."""
        counts = np.maximum(0, n - self.run + 1)
        # Each run's first word; runs never reach into the next text.
        at = np.repeat(np.cumsum(n) - n - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
        out = np.zeros(len(at), np.uint64)
        for k in range(self.run):
            out = (out * GOLD) ^ (h[at + k] + np.uint64(k))
            out ^= out >> np.uint64(29)
        out *= MIX
        return out ^ (out >> np.uint64(32)), counts

    def digests(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Two 64-bit hashes of each text's words in their order, and the number of words."""
        h, n = self.word_hashes(texts)
        ends = np.cumsum(n)
        place = np.arange(len(h)) - np.repeat(ends - n, n)
        out = []
        for k in (1, 2):
            sums = np.concatenate(([np.uint64(0)], np.cumsum(mixed(h ^ seeds(place), seed(k)))))
            out.append((sums[ends] - sums[ends - n]).view(np.int64))
        return out[0], out[1], n


def distance(at_least: float) -> int:
    """Differing bits that a pair of this share has at most: 167 of 512 for a half, where texts without a common run differ in 256."""
    p = (1 - at_least) / 2
    return int(BITS * p + DEVIATIONS * (BITS * p * (1 - p)) ** 0.5)


def min_hashes(runs: np.ndarray, counts: np.ndarray, size: int, salt: int = 0) -> np.ndarray:
    """``size`` min-wise hashes (texts x size) of texts with at least one run each; others for each ``salt``.

    In each round every run is dealt to one of the hashes at random; a hash keeps the smallest of the
    first round that reaches it, so that a text takes a few passes over its runs instead of ``size``. A
    hash that no round has reached takes the smallest of all runs by itself. Two texts agree in a hash
    with the probability that is their share of common runs, as with ``size`` passes.
    """
    n = len(counts)
    text = np.repeat(np.arange(n, dtype=np.int64) * size, counts)
    low = np.full(n * size, np.iinfo(np.uint64).max, np.uint64)
    half = np.uint64(32)
    for r in range(ROUNDS):
        if r and low.max(initial=0) < np.iinfo(np.uint64).max:
            break  # every hash has its round
        y = mixed(runs, seed(r + (salt << 32)))
        place = ((y >> half) * np.uint64(size)) >> half
        np.minimum.at(low, text + place.astype(np.int64), (y & np.uint64(0xFFFFFFFF)) | np.uint64(r << 32))
    left = np.flatnonzero(low == np.iinfo(np.uint64).max)
    starts = np.cumsum(counts) - counts
    step = max(1, 4_000_000 // max(1, int(counts.max())))
    for a in range(0, len(left), step):
        part = left[a : a + step]
        owner, place = part // size, part % size
        many = counts[owner]
        ends = np.cumsum(many)
        at = np.repeat(starts[owner] - (ends - many), many) + np.arange(ends[-1])
        y = mixed(runs[at], np.repeat(seeds(place + 1000 + (salt << 32)), many))
        low[part] = (np.minimum.reduceat(y, ends - many) >> half) | np.uint64(ROUNDS << 32)
    return low.reshape(n, size)


def bits_of(low: np.ndarray) -> np.ndarray:
    """Bit fingerprints (texts x BITS / 64, int64), one bit of each of the first hashes."""
    bit = ((low[:, :BITS] * GOLD) >> np.uint64(63)) << (np.arange(BITS, dtype=np.uint64) % np.uint64(64))
    return np.ascontiguousarray(np.bitwise_or.reduce(bit.reshape(len(low), BITS // 64, 64), axis=2)).view(np.int64)


def blocks_of(low: np.ndarray, blocks: int, rows: int) -> np.ndarray:
    """Block keys (texts x blocks, int64) of ``rows`` hashes each."""
    wide = low[:, : blocks * rows].reshape(len(low), blocks, rows)
    key = np.arange(1, blocks + 1, dtype=np.uint64)[None, :] * GOLD
    for r in range(rows):
        key = (key ^ wide[:, :, r]) * np.uint64(0xD6E8FEB86659FD93)
        key ^= key >> np.uint64(32)
    return key.view(np.int64)


def n_blocks(at_least: float, rows: int) -> int:
    """Blocks of ``rows`` hashes of which a pair of this share has none in common with probability MISS."""
    p = at_least**rows
    return max(1, math.ceil(math.log(MISS) / math.log1p(-p))) if p < 1 else 1


def pass_sizes(n: int, blocks: int, parts: int, most: float) -> list[int]:
    """How many blocks each pass has, so that its rows of ``n`` texts in ``parts`` partitions or more take ``most`` bytes; one block at least."""
    for b in range(blocks, 0, -1):
        p = max(parts, n * b // PART_ROWS)
        if b == 1 or n * (ROW * p * (1 - (1 - 1 / p) ** b) + 8 * b) <= most:
            break
    k = -(-blocks // b)
    return [blocks * (i + 1) // k - blocks * i // k for i in range(k)]


def plan_blocks(n: int, shares: np.ndarray, at_least: float, most_rows: int = 12, passes: Callable[[int], int] = lambda blocks: 1) -> tuple[int, int]:
    """(blocks, rows) of least cost for ``n`` texts, of which any two have the sampled ``shares`` of runs in common."""
    cost = {}
    for rows in range(2, most_rows + 1):
        b = n_blocks(at_least, rows)
        meet = float((shares**rows).mean()) if len(shares) else 0.0
        cost[rows] = b * (n * BLOCK_COST + n * (n - 1) / 2 * meet * PAIR_COST) + (passes(b) - 1) * n * PASS_COST
    rows = min(cost, key=lambda r: (cost[r], r))
    return n_blocks(at_least, rows), rows


def _pieces(b: pa.RecordBatch) -> Iterator[tuple[np.ndarray, list[str]]]:
    """(ids, texts) of a batch, a bounded number of texts and characters at a time; only a longer text exceeds it, alone."""
    ids, texts = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_pylist()
    a = 0
    while a < len(texts):
        e, chars = a, 0
        while e < len(texts) and e - a < 256 and (e == a or chars < 1_000_000):
            chars += len(texts[e])
            e += 1
        yield ids[a:e], texts[a:e]
        a = e


def _chunks(b: pa.RecordBatch, hasher: _Hasher) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, runs, counts) of the texts that have a run, some of them at a time."""
    for ids, texts in _pieces(b):
        runs, counts = hasher.many(texts)
        ok = counts > 0
        if ok.any():
            yield ids[ok], runs, counts[ok]


def _digested(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    hasher = _Hasher(1)
    for b in batches:
        for ids, texts in _pieces(b):
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (ids, *hasher.digests(texts))], ["id", "k1", "k2", "n_words"])


def _sampled(run: int):
    def sample(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _Hasher(run)
        for b in batches:
            for _, runs, counts in _chunks(b, hasher):
                yield pa.RecordBatch.from_arrays([pa.array([low.tobytes() for low in min_hashes(runs, counts, BITS)], pa.binary())], ["low"])

    return sample


_STORED = "ids binary, counts binary, words binary, places binary, bits binary"


def _stored(run: int):
    """Some texts to a row: ids, numbers of words, the different words' hashes, the place of each word among these, fingerprints."""

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher, packed = _Hasher(run), pa.Codec("zstd")
        for b in batches:
            for ids, texts in _pieces(b):
                h, n = hasher.word_hashes(texts)
                ok = n >= run
                if not ok.any():
                    continue
                h, n = h[np.repeat(ok, n)], n[ok]
                words, places = np.unique(h, return_inverse=True)
                places = places.astype(np.uint16 if len(words) <= 1 << 16 else np.uint32)
                bits = bits_of(min_hashes(*hasher.runs(h, n), BITS))
                row = (ids[ok].tobytes(), n.astype(np.int64).tobytes(), words.tobytes(), packed.compress(places.tobytes(), asbytes=True), bits.tobytes())
                yield pa.RecordBatch.from_arrays([pa.array([x], pa.binary()) for x in row], [c.split()[0] for c in _STORED.split(", ")])

    return store


def _read(b: pa.RecordBatch, hasher: _Hasher) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]:
    """(ids, runs, counts, bits) of each row that ``_stored`` made."""
    packed = pa.Codec("zstd")
    for k in range(b.num_rows):
        ids, n, words, places, bits = (b.column(c)[k].as_buffer() for c in range(5))
        n, words = np.frombuffer(n, np.int64), np.frombuffer(words, np.uint64)
        kind = np.dtype(np.uint16 if len(words) <= 1 << 16 else np.uint32)
        at = np.frombuffer(packed.decompress(places, int(n.sum()) * kind.itemsize), kind)
        yield np.frombuffer(ids, np.int64), *hasher.runs(words[at], n), np.frombuffer(bits, np.int64).reshape(len(n), -1)


def _marked(run: int, blocks: int, rows: int, home: np.ndarray, salt: int):
    """One row of each text and partition that any of its blocks belongs to: the blocks travel together."""
    parts = len(home)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = _Hasher(run)
        for b in batches:
            for ids, runs, counts, bits in _read(b, hasher):
                keys = blocks_of(min_hashes(runs, counts, blocks * rows, salt), blocks, rows)
                part = (keys.view(np.uint64) % np.uint64(parts)).astype(np.int64)
                order = np.argsort(part, axis=1, kind="stable")
                keys, part = np.take_along_axis(keys, order, 1).ravel(), np.take_along_axis(part, order, 1)
                first = np.ones(part.shape, bool)
                first[:, 1:] = part[:, 1:] != part[:, :-1]
                at = np.flatnonzero(first.ravel())
                text = at // part.shape[1]
                lists = pa.ListArray.from_arrays(pa.array(np.append(at, len(keys)).astype(np.int32)), pa.array(keys))
                yield pa.RecordBatch.from_arrays([pa.array(home[part.ravel()[at]]), pa.array(ids[text]), *[pa.array(bits[text, k]) for k in range(bits.shape[1])], lists], ["home", "cls", *_WORDS, "blocks"])

    return mark


def _meet(limit: int, tile: int):
    """Pairs of a block within ``limit`` bits from rows sorted by block; the rows of larger blocks come out as they are, for tiles.

    No more than one batch and ``tile`` rows of a block are held at any time.
    """
    names = ["a", "b", "block", *_WORDS]

    def out(a, b, block, words) -> pa.RecordBatch:
        none = pa.nulls(len(a), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(a), none if b is None else pa.array(b), none if block is None else pa.array(block), *([none] * len(_WORDS) if words is None else [pa.array(w.view(np.int64)) for w in words])], names)

    def pairs(key: np.ndarray, cls: np.ndarray, words: list[np.ndarray]) -> pa.RecordBatch:
        left, right, d = [], [], 1
        i = np.flatnonzero(key[1:] == key[:-1])
        while len(i):
            j = i + d
            off = np.zeros(len(i), np.uint16)
            for w in words:
                off += np.bitwise_count(w[i] ^ w[j])
            near = (off <= limit) & (cls[i] != cls[j])
            left.append(cls[i[near]])
            right.append(cls[j[near]])
            d += 1
            i = i[i + d < len(key)]
            i = i[key[i] == key[i + d]]
        x, y = (np.concatenate(c) if c else np.empty(0, np.int64) for c in (left, right))
        both = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1), axis=0) if len(x) else np.empty((0, 2), np.int64)
        return out(both[:, 0], both[:, 1], None, None)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        columns = ["block", "cls", *_WORDS]
        held = [np.empty(0, np.int64)] * len(columns)
        hot = None
        for b in batches:
            held = [np.concatenate([h, b.column(c).to_numpy()]) for h, c in zip(held, columns)]
            key = held[0]
            if not len(key):
                continue
            starts = np.append(0, np.flatnonzero(key[1:] != key[:-1]) + 1)
            size = np.diff(np.append(starts, len(key)))
            large = (size > tile) | (key[starts] == hot if hot is not None else False)
            tail = starts[-1]  # the last block may go on in the next batch
            hot = key[tail] if large[-1] else None
            if large.any():
                wide = np.repeat(large, size)
                yield out(held[1][wide], None, key[wide], [h[wide] for h in held[2:]])
                done = ~wide
                done[tail:] = False
                rest, held = [h[len(h) if large[-1] else tail :] for h in held], [h[done] for h in held]
            else:
                rest, held = [h[tail:] for h in held], [h[:tail] for h in held]
            yield pairs(held[0], held[1], [h.view(np.uint64) for h in held[2:]])
            held = rest
        yield pairs(held[0], held[1], [h.view(np.uint64) for h in held[2:]])

    return meet


def _shares(run: int):
    def share(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        hasher = _Hasher(run)
        for whole in batches:
            for at in range(0, len(whole), 256):
                b = whole.iloc[at : at + 256]
                texts = dict(zip(b["a"], b["text_a"])) | dict(zip(b["b"], b["text_b"]))
                runs, counts = hasher.many(list(texts.values()))
                own = dict(zip(texts, map(np.unique, np.split(runs, np.cumsum(counts)[:-1]))))
                both = np.array([len(np.intersect1d(own[x], own[y], assume_unique=True)) for x, y in zip(b["a"], b["b"])], np.int64)
                every = np.array([len(own[x]) + len(own[y]) for x, y in zip(b["a"], b["b"])], np.int64)
                yield pd.DataFrame({"a": b["a"], "b": b["b"], "share": both / np.maximum(1, every - both)})

    return share


def texts_of(docs: DataFrame, id: str, text: str, longer_than: int) -> DataFrame:  # noqa: A002
    """``(id, text)``: of rows that repeat an id the greatest text."""
    rows = docs.select(F.col(id).cast("bigint").alias("id"), F.col(text).alias("text")).where("id IS NOT NULL AND length(text) > " + str(int(longer_than)))
    return rows.groupBy("id").agg(F.max("text").alias("text"))


def classes(texts: DataFrame) -> DataFrame:
    """``(id, cls, n_words)``: texts with the same words in the same order are one class, named by its smallest id.

    Only digests meet, never texts; the smallest id of each is a partial aggregate, so that a copy group may hold any share of the rows.
    """
    keyed = cut(texts.select("id", "text").mapInArrow(_digested, "id bigint, k1 bigint, k2 bigint, n_words bigint"))
    first = keyed.groupBy("k1", "k2").agg(F.min("id").alias("cls"), F.count("*").alias("n"))
    # Only digests that several texts have go into the join; all other texts are their own class.
    shared = keyed.hint("merge").join(first.where("n > 1").drop("n").hint("merge"), ["k1", "k2"]).select("id", "cls")
    return keyed.select("id", "n_words").join(shared.hint("merge"), "id", "left").select("id", F.coalesce("cls", "id").alias("cls"), "n_words")


def _homes(spark, parts: int) -> np.ndarray:
    """A label for each partition that Spark's hash sends to it, so that no two labels meet in one."""
    got = spark.range(40 * parts).select("id", F.pmod(F.hash("id"), F.lit(parts)).alias("p")).groupBy("p").agg(F.min("id").alias("id")).orderBy("p").collect()
    return np.array([r.id for r in got], np.int64)


def similar_classes(kept: DataFrame, texts: DataFrame, *, run: int, at_least: float, tile: int = TILE) -> DataFrame:
    """``(a, b, share)`` of class representatives with a < b whose texts share ``at_least`` of their runs."""
    spark = kept.sparkSession
    n = kept.where("id = cls").count()
    own = texts.hint("merge").join(kept.where("id = cls").select("id").hint("merge"), "id").select(F.col("id").alias("cls"), "text")
    some = texts.where(F.pmod(F.xxhash64("id"), F.lit(max(1, n // SAMPLE))) == 0).select(F.col("id").alias("cls"), "text").limit(2 * SAMPLE)
    seen = some.mapInArrow(_sampled(run), "low binary").collect()  # 4 KB of each sampled text
    low = np.array([np.frombuffer(r.low, np.uint64) for r in seen]) if seen else np.empty((0, BITS), np.uint64)
    shares = np.concatenate([(low[i + 1 :] == low[i]).mean(1) for i in range(len(low) - 1)]) if len(low) > 1 else np.empty(0)
    words = cut(own.mapInArrow(_stored(run), _STORED))
    release(spark)
    kept_bytes = words.select(F.sum(sum((F.length(c.split()[0]) for c in _STORED.split(", ")), F.lit(0)))).first()[0] or 0
    most, least = max(PASS_LEAST, PASS_SHARE * kept_bytes), int(spark.conf.get("spark.sql.shuffle.partitions"))
    blocks, rows = plan_blocks(n, shares, at_least, passes=lambda b: len(pass_sizes(n, b, least, most)))
    passes = pass_sizes(n, blocks, least, most)
    parts = max(least, n * max(passes) // PART_ROWS)
    home = _homes(spark, parts)
    longs = ", ".join(f"{w} bigint" for w in _WORDS)
    limit = distance(at_least)
    pairs = None
    for k, some in enumerate(passes, 1):
        marked = words.mapInArrow(_marked(run, some, rows, home, k), f"home bigint, cls bigint, {longs}, blocks array<bigint>")
        listed = marked.repartition(parts, "home").select(F.explode("blocks").alias("block"), "cls", *_WORDS).sortWithinPartitions("block")
        met = cut(listed.mapInArrow(_meet(limit, tile), f"a bigint, b bigint, block bigint, {longs}"))
        release(spark)
        near = met.where("b IS NOT NULL").select("a", "b")
        large = met.where("b IS NULL").select("block", F.col("a").alias("cls"), *_WORDS)
        if not large.isEmpty():
            for tiled in _tiled(large, limit, tile, most):
                near = near.unionByName(tiled)
        near = near if pairs is None else pairs.unionByName(near)
        pairs = cut(near.distinct())
        del met, near, large
        release(spark)
    del words
    said = lambda c: texts.select(F.col("id").alias(c), F.col("text").alias(f"text_{c}")).hint("merge")
    both = pairs.hint("merge").join(said("a"), "a").hint("merge").join(said("b"), "b")
    return both.select("a", "b", "text_a", "text_b").mapInPandas(_shares(run), "a bigint, b bigint, share double").where(F.col("share") >= at_least)


def _tiled(large: DataFrame, limit: int, tile: int, most: float) -> Iterator[DataFrame]:
    """``(a, b)`` of blocks with many members: a block is cut into shares, and any two shares meet in a task of their own.

    The shares' rows take ``most`` bytes at once; if all take more, some of the meetings follow the others.
    """
    spark = large.sparkSession
    sizes = large.groupBy("block").agg(F.ceil(F.count("*") / F.lit(tile)).cast("int").alias("s"), F.count("*").alias("n"))
    rounds = math.ceil(2 * (ROW + 16) * sizes.select(F.sum(F.col("s") * F.col("n"))).first()[0] / most)
    cutup = large.join(sizes.drop("n").hint("merge"), "block").withColumn("own", F.pmod(F.xxhash64("cls"), F.col("s")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("s") - 1))
    left = cutup.withColumn("other", every).select("block", F.col("own").alias("i"), F.col("other").alias("j"), F.col("cls").alias("a"), *_WORDS)
    right = cutup.withColumn("other", every).select("block", F.col("other").alias("i"), F.col("own").alias("j"), F.col("cls").alias("b"), *[F.col(w).alias("y" + w) for w in _WORDS])
    off = sum((F.bit_count(F.col(w).bitwiseXOR(F.col("y" + w))) for w in _WORDS), F.lit(0))
    for k in range(rounds):
        x, y = (side.where(F.pmod(F.xxhash64("block", "i", "j"), F.lit(rounds)) == k) if rounds > 1 else side for side in (left, right))
        found = x.hint("merge").join(y, ["block", "i", "j"]).where((F.col("a") < F.col("b")) & (off <= limit)).select("a", "b")
        if rounds > 1:
            found = cut(found.distinct())
            release(spark)
        yield found


def similar_pairs(docs: DataFrame, *, id: str, text: str, run: int = 5, at_least: float = 0.8, longer_than: int = 0, tile: int = TILE) -> DataFrame:  # noqa: A002
    """``(id_a, id_b)`` with id_a < id_b of all texts that share ``at_least`` of the runs of ``run`` words in either.

    Words are runs of letters and digits, case ignored; whole texts count. Defined cases: null ids and
    null texts are no texts; of rows with one id one text counts (the greatest); texts without a run
    (fewer words than ``run``) have nothing to share and are in no pair; copies are paired with
    each other; an empty table gives no rows. ``tile`` bounds the members of a block, or copies of a
    text, that meet in one task; it changes no result.
    """
    texts = texts_of(docs, id, text, longer_than)
    kept = cut(classes(texts))
    release(docs.sparkSession)
    pairs = similar_classes(kept, texts, run=run, at_least=at_least, tile=tile)
    # Copies of one text, in tiles; a class with no run has no pair, not even among its copies.
    sizes = kept.where(F.col("n_words") >= run).groupBy("cls").agg(F.ceil(F.count("*") / F.lit(tile)).cast("int").alias("s"), F.count("*").alias("n")).where("n > 1").drop("n")
    copied = kept.hint("merge").join(sizes.hint("merge"), "cls").withColumn("own", F.pmod(F.xxhash64("id"), F.col("s")).cast("int"))
    every = F.explode(F.sequence(F.lit(0), F.col("s") - 1))
    left = copied.withColumn("other", every).select("cls", F.col("own").alias("i"), F.col("other").alias("j"), F.col("id").alias("id_a"))
    right = copied.withColumn("other", every).select("cls", F.col("other").alias("i"), F.col("own").alias("j"), F.col("id").alias("id_b"))
    own = left.hint("merge").join(right, ["cls", "i", "j"]).where("id_a < id_b").select("id_a", "id_b")
    across = pairs.hint("merge").join(kept.select(F.col("cls").alias("a"), F.col("id").alias("p")).hint("merge"), "a").select("b", "p")
    across = across.hint("merge").join(kept.select(F.col("cls").alias("b"), F.col("id").alias("q")).hint("merge"), "b")
    return own.unionByName(across.select(F.least("p", "q").alias("id_a"), F.greatest("p", "q").alias("id_b")))


def components(edges: DataFrame, nodes: DataFrame, rounds: int = 60) -> DataFrame:
    """``(node, label)``: the smallest node that each node of ``nodes`` reaches over ``edges`` (a, b).

    Labels spread to neighbours and then jump to the label's own label, so that the rounds needed grow
    with the logarithm of a chain; each round is checkpointed, only a count comes to the driver.
    """
    both = cut(edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = cut(nodes.select("node", F.col("node").alias("label")))
    linked = label.hint("merge").join(both.select(F.col("a").alias("node")).distinct(), "node", "left_semi")
    for _ in range(rounds):
        seen = both.hint("merge").join(linked.select(F.col("node").alias("b"), "label"), "b").groupBy("a").agg(F.min("label").alias("low"))
        step = linked.hint("merge").join(seen.withColumnRenamed("a", "node"), "node").select("node", F.col("label").alias("was"), F.least("label", "low").alias("label"))
        jump = step.hint("merge").join(step.select(F.col("node").alias("at"), F.col("label").alias("far")), step.label == F.col("at"), "left")
        nxt = cut(jump.select("node", "was", F.least("label", F.coalesce("far", "label")).alias("label")))
        linked = nxt.select("node", "label")
        if nxt.where("label <> was").isEmpty():
            break
    else:
        raise RuntimeError("components did not settle")
    return nodes.select("node").hint("merge").join(linked, "node", "left").select("node", F.coalesce("label", "node").alias("label"))


def version_groups(docs: DataFrame, *, id: str, text: str, run: int = 5, at_least: float = 0.8, longer_than: int = 0, tile: int = TILE) -> DataFrame:  # noqa: A002
    """``(id, class_id, group_id, n_links)``: one row per text, with its copies' class, its group of versions
    and the number of different texts that it is similar to. Cases as in ``similar_pairs``."""
    texts = texts_of(docs, id, text, longer_than)
    kept = cut(classes(texts))
    release(docs.sparkSession)
    pairs = cut(similar_classes(kept, texts, run=run, at_least=at_least, tile=tile).select("a", "b"))
    links = pairs.select(F.explode(F.array("a", "b")).alias("cls")).groupBy("cls").agg(F.count("*").alias("n_links"))
    groups = components(pairs, kept.where("id = cls").select(F.col("cls").alias("node")))
    out = kept.hint("merge").join(groups.select(F.col("node").alias("cls"), F.col("label").alias("group_id")).hint("merge"), "cls").join(links.hint("merge"), "cls", "left")
    return out.select("id", F.col("cls").alias("class_id"), "group_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"))
