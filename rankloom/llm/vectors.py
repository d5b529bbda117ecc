"""The most similar vectors of every vector.

An index is fitted on a bounded sample: cells by spherical k-means, and a product code of sixteen
four-bit subspaces whose loss weighs the error parallel to the vector more than the rest, as that is
what moves large inner products. Every row is indexed: it asks in its own cell and is listed there and
in its next nearest cells. In each cell a table scan over the codes scores all listed rows for whole
batches of queries; what passes a threshold calibrated on the sample is reranked with the vectors
themselves. Exact copies are one row of the index, so that no group of copies meets itself.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..plans.lineage import cut, release

#: Rows the index is fitted on at least and at most; rows per cell; cells a row is listed in; queries of one share of a cell.
SAMPLE, MOST_SAMPLE, CELL_ROWS, LISTED, SHARE_ROWS = 20_000, 400_000, 300, 4, 20_000
#: Up to so many cells their number grows with the rows, beyond it with the root of the rows, so that neither cells nor their list get too large.
FLAT_CELLS, ROOT = 4096, 4.0
SUBSPACES, CENTRES = 16, 16
#: Inner products above this matter; it sets the weight of the parallel error.
MATTERS = 0.2
#: Part of the pairs at the least similarity that the code scan may lose.
SCAN_LOSS = 0.001
#: Numbers of one intermediate table; whatever is compared with all centres goes in pieces of so many.
PIECE = 2_000_000


def _steps(rows: int, wide: int) -> Iterator[slice]:
    """Pieces of so many rows that ``wide`` numbers of each are no more than PIECE."""
    step = max(1, PIECE // max(1, wide))
    for a in range(0, rows, step):
        yield slice(a, min(rows, a + step))


def _closest(x: np.ndarray, c: np.ndarray, less: np.ndarray | float = 0.0) -> np.ndarray:
    """Of each row the column of ``x @ c.T - less`` that is greatest."""
    out = np.empty(len(x), np.int64)
    for s in _steps(len(x), len(c)):
        out[s] = (x[s] @ c.T - less).argmax(1)
    return out


def _kmeans(x: np.ndarray, k: int, rng: np.random.Generator, rounds: int) -> np.ndarray:
    c = x[rng.choice(len(x), k, replace=len(x) < k)].copy()
    for _ in range(rounds):
        a = _closest(x, c, 0.5 * (c * c).sum(1))
        many = np.bincount(a, minlength=k)
        at = np.flatnonzero(many)
        c[at] = np.stack([np.bincount(a, x[:, j], k)[at] for j in range(x.shape[1])], 1) / many[at][:, None]
        gone = np.setdiff1d(np.arange(k), at)
        c[gone] = x[rng.choice(len(x), len(gone))]
    return c


def n_cells(rows: int) -> int:
    return max(1, min(round(rows / CELL_ROWS), max(FLAT_CELLS, round(ROOT * rows**0.5))))


def sample_rows(rows: int) -> int:
    """Rows the index is fitted on: sixteen per cell, within the bounds."""
    return min(MOST_SAMPLE, max(SAMPLE, 16 * n_cells(rows)))


def _centres(x: np.ndarray, k: int, rng: np.random.Generator) -> np.ndarray:
    """``k`` centres; many of them are found group by group."""
    if k <= FLAT_CELLS:
        return _kmeans(x, k, rng, 8)
    c = _kmeans(x, round(k**0.5), rng, 8)
    at = _closest(x, c, 0.5 * (c * c).sum(1))
    size = np.bincount(at, minlength=len(c))
    return np.concatenate([_kmeans(x[at == g], max(1, round(k * size[g] / len(x))), rng, 6) for g in np.flatnonzero(size)])


class VectorIndex:
    """Cells and codebooks of one column of unit vectors."""

    def __init__(self, sample: np.ndarray, rows: int, at_least: float, seed: int = 7) -> None:
        rng = np.random.default_rng(seed)
        self.dim = sample.shape[1]
        self.width = -(-self.dim // SUBSPACES)
        c = _centres(sample, min(n_cells(rows), len(sample)), rng)
        self.cells = len(c)
        self.centres = (c / np.maximum(np.linalg.norm(c, axis=1), 1e-9)[:, None]).astype(np.float32)
        self.weight = (self.dim - 1) * MATTERS**2 / (1 - MATTERS**2)
        x = self._split(sample)
        self.books = np.stack([_kmeans(x[:, m], CENTRES, rng, 8) for m in range(SUBSPACES)]).astype(np.float32)
        for _ in range(3):
            self._improve(x, self.encode(sample))
        self.least = self._calibrate(sample, at_least, rng)
        mine = _closest(sample, self.centres)
        share = np.bincount(mine, minlength=self.cells) * (rows / len(sample))
        self.shares = np.maximum(1, np.ceil(share / SHARE_ROWS)).astype(np.int64)

    def _split(self, unit: np.ndarray) -> np.ndarray:
        pad = SUBSPACES * self.width - self.dim
        return (np.pad(unit, ((0, 0), (0, pad))) if pad else unit).reshape(len(unit), SUBSPACES, self.width)

    def encode(self, unit: np.ndarray) -> np.ndarray:
        """Codes (rows x SUBSPACES) that lessen the anisotropic loss, by coordinate descent."""
        out = np.empty((len(unit), SUBSPACES), np.uint8)
        for s in _steps(len(unit), SUBSPACES * CENTRES):
            out[s] = self._encode(self._split(unit[s]))
        return out

    def _encode(self, x: np.ndarray) -> np.ndarray:
        dots = np.stack([x[:, m] @ self.books[m].T for m in range(SUBSPACES)], 1)
        loss = (self.books**2).sum(2)[None] - 2 * dots
        codes = loss.argmin(2)
        rows = np.arange(len(x))
        along = np.take_along_axis(dots, codes[:, :, None], 2)[:, :, 0]
        length = (x * x).sum((1, 2))
        left = length - along.sum(1)  # the residual's share along the vector
        for _ in range(2):
            for m in range(SUBSPACES):
                rest = left + along[:, m]
                codes[:, m] = (loss[:, m] + (self.weight - 1) * (rest[:, None] - dots[:, m]) ** 2).argmin(1)
                along[:, m] = dots[rows, m, codes[:, m]]
                left = rest - along[:, m]
        return codes.astype(np.uint8)

    def _improve(self, x: np.ndarray, codes: np.ndarray) -> None:
        """Each centre solves its own least squares under the anisotropic loss."""
        along = np.stack([(x[:, m] * self.books[m][codes[:, m]]).sum(1) for m in range(SUBSPACES)], 1)
        left = np.einsum("nmw,nmw->n", x, x) - along.sum(1)
        extra = self.weight - 1
        for m in range(SUBSPACES):
            rest = left + along[:, m]
            for k in range(CENTRES):
                on = codes[:, m] == k
                if on.any():
                    y = x[on, m]
                    a = len(y) * np.eye(self.width) + extra * (y.T @ y)
                    self.books[m, k] = np.linalg.solve(a, y.sum(0) + extra * (rest[on][:, None] * y).sum(0))
            along[:, m] = (x[:, m] * self.books[m][codes[:, m]]).sum(1)
            left = rest - along[:, m]

    def _calibrate(self, sample: np.ndarray, at_least: float, rng: np.random.Generator) -> float:
        """The scan's score that all but SCAN_LOSS of the pairs with similarity ``at_least`` reach."""
        x = sample[rng.choice(len(sample), min(len(sample), 5000), replace=False)]
        off = rng.standard_normal(x.shape).astype(np.float32)
        off -= (off * x).sum(1)[:, None] * x
        off /= np.maximum(np.linalg.norm(off, axis=1), 1e-9)[:, None]
        query = at_least * x + np.sqrt(max(0.0, 1 - at_least**2)) * off
        query, codes, score = query.astype(np.float32), self.pack(self.encode(x)), np.empty(len(x), np.float32)
        for s in _steps(len(x), SUBSPACES // 2 * CENTRES * CENTRES):
            tables, code = self.tables(query[s]), codes[s]
            score[s] = sum(tables[np.arange(len(code)), j, code[:, j]] for j in range(SUBSPACES // 2))
        return float(np.quantile(score, SCAN_LOSS))

    @staticmethod
    def pack(codes: np.ndarray) -> np.ndarray:
        """Two four-bit codes in a byte."""
        return codes[:, 0::2] | (codes[:, 1::2] << 4)

    def tables(self, query: np.ndarray) -> np.ndarray:
        """Of each query the inner products with all centres of each pair of subspaces: queries x 8 x 256."""
        one = np.einsum("qmw,mkw->qmk", self._split(query), self.books, optimize=True)
        return (one[:, 1::2, :, None] + one[:, 0::2, None, :]).reshape(len(query), SUBSPACES // 2, CENTRES * CENTRES)

    def scan(self, query: np.ndarray, codes: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Index pairs (query, row) whose table score passes; ``codes`` are packed."""
        columns = [np.ascontiguousarray(codes[:, j]).astype(np.intp) for j in range(codes.shape[1])]
        for a in range(0, len(query), 128):
            t = self.tables(query[a : a + 128])
            score = np.take(t[:, 0], columns[0], axis=1)
            for j in range(1, len(columns)):
                score += np.take(t[:, j], columns[j], axis=1)
            q, r = np.nonzero(score >= self.least)
            yield q + a, r

    def nearest_cells(self, unit: np.ndarray) -> np.ndarray:
        """The LISTED nearest cells of each row, nearest first."""
        return np.concatenate([self._nearest(unit[s]) for s in _steps(len(unit), self.cells)])

    def _nearest(self, unit: np.ndarray) -> np.ndarray:
        s = unit @ self.centres.T
        n = min(LISTED, self.cells)
        part = np.argpartition(-s, n - 1, axis=1)[:, :n]
        return np.take_along_axis(part, np.argsort(-np.take_along_axis(s, part, 1), axis=1, kind="stable"), 1)


def _matrix(column: pa.Array, dim: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the usable vectors of a list column, and their values: right length, finite, not all zero."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    length = np.asarray(column.value_lengths().fill_null(-1))
    ok = np.flatnonzero(length == dim)
    flat = column.take(pa.array(ok)).flatten()
    x = np.asarray(flat.to_numpy(zero_copy_only=False), np.float32).reshape(len(ok), dim)
    fine = np.isfinite(x).all(1) & (x != 0).any(1)
    return ok[fine], x[fine]


def _unit(x: np.ndarray) -> np.ndarray:
    wide = x.astype(np.float64)
    wide /= np.abs(wide).max(1)[:, None]
    return (wide / np.sqrt((wide * wide).sum(1))[:, None]).astype(np.float32)


def _units(dim: int):
    def units(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            _, x = _matrix(b.column("vec"), dim)
            if len(x):
                yield pa.RecordBatch.from_arrays([pa.array([_unit(x).tobytes()], pa.binary())], ["units"])

    return units


def _drawn(rows: DataFrame, dim: int) -> np.ndarray:
    """The usable vectors of ``rows``, of unit length, as bytes from the tasks on."""
    got = rows.select("vec").mapInArrow(_units(dim), "units binary").collect()
    return np.frombuffer(b"".join(r.units for r in got), np.float32).reshape(-1, dim)


def _binary(x: np.ndarray) -> pa.Array:
    """The rows of a matrix of bytes."""
    ends = pa.py_buffer((np.arange(len(x) + 1) * x.shape[1]).astype(np.int32))
    return pa.Array.from_buffers(pa.binary(), len(x), [None, ends, pa.py_buffer(np.ascontiguousarray(x).tobytes())])


def _planes(x: np.ndarray) -> np.ndarray:
    """Float bytes by significance, so that what vectors have in common lies together and compresses."""
    return np.ascontiguousarray(x.view(np.uint8).reshape(len(x), x.shape[1], 4).transpose(0, 2, 1)).reshape(len(x), 4 * x.shape[1])


def _floats(planes: list[bytes], dim: int) -> np.ndarray:
    raw = np.frombuffer(b"".join(planes), np.uint8).reshape(len(planes), 4, dim)
    return np.ascontiguousarray(raw.transpose(0, 2, 1)).reshape(len(planes), 4 * dim).view(np.float32)


def _digests(unit: np.ndarray) -> list[bytes]:
    """128-bit hashes of unit vectors; -0 is 0."""
    import xxhash

    return [xxhash.xxh3_128_digest(r) for r in np.ascontiguousarray(unit + np.float32(0))]


def _marks(dim: int):
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, x = _matrix(b.column("vec"), dim)
            h = np.frombuffer(b"".join(_digests(_unit(x))), np.int64).reshape(-1, 2) if len(at) else np.empty((0, 2), np.int64)
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(at)), pa.array(h[:, 0]), pa.array(h[:, 1])], ["id", "h1", "h2"])

    return mark


_ENTRY = "cell int, share int, id bigint, code bigint, raw binary"


def _enter(index: VectorIndex):
    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[bytes] = set()
        for b in batches:
            for a in range(0, b.num_rows, 2048):
                piece = b.slice(a, 2048)
                at, x = _matrix(piece.column("vec"), index.dim)
                if not len(at):
                    continue
                unit = _unit(x)
                # A task lists a vector once, so that copies in a cell are no more than tasks.
                new = np.array([h not in seen and not seen.add(h) for h in _digests(unit)], bool)
                at, x, unit = at[new], x[new], unit[new]
                if not len(at):
                    continue
                ids = piece.column("id").take(pa.array(at)).to_numpy()
                code = np.ascontiguousarray(index.pack(index.encode(unit))).view(np.int64).ravel()
                cells = index.nearest_cells(unit)
                raw = _binary(_planes(x))
                # The asking row, with its vector, in its share of its own cell; listings in every share.
                home = cells[:, 0]
                own = (ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(33)).astype(np.int64) % index.shares[home]
                yield pa.RecordBatch.from_arrays([pa.array(home.astype(np.int32)), pa.array(own.astype(np.int32)), pa.array(ids), pa.array(code), raw], ["cell", "share", "id", "code", "raw"])
                cell = cells.ravel()
                row = np.repeat(np.arange(len(x)), cells.shape[1])
                first = np.tile(np.arange(cells.shape[1]) == 0, len(x))
                times = index.shares[cell]
                cell, row, first = np.repeat(cell, times), np.repeat(row, times), np.repeat(first, times)
                share = np.arange(len(cell)) - np.repeat(np.cumsum(times) - times, times)
                keep = ~(first & (share == own[row]))
                cell, row, share = cell[keep], row[keep], share[keep]
                yield pa.RecordBatch.from_arrays([pa.array(cell.astype(np.int32)), pa.array(share.astype(np.int32)), pa.array(ids[row]), pa.array(code[row]), pa.nulls(len(cell), pa.binary())], ["cell", "share", "id", "code", "raw"])

    return enter


def _ask(index: VectorIndex):
    def ask(table: pa.Table) -> pa.Table:
        ids = table.column("id").to_numpy()
        codes = table.column("code").to_numpy().view(np.uint8).reshape(-1, SUBSPACES // 2)
        raw = table.column("raw").combine_chunks()
        asking = np.flatnonzero(np.asarray(raw.is_valid()))
        planes = raw.take(pa.array(asking)).to_pylist()
        qs, rs = [np.empty(0, np.int64)], [np.empty(0, np.int64)]
        if len(asking):
            for q, r in index.scan(_unit(_floats(planes, index.dim)), codes):
                qs.append(q)
                rs.append(r)
        q, r = np.concatenate(qs), np.concatenate(rs)
        other = ids[asking[q]] != ids[r]
        q, r = q[other], r[other]
        return pa.table({"a": pa.array(ids[asking[q]]), "b": pa.array(ids[r]), "raw": pa.array([planes[i] for i in q], pa.binary())})

    return ask


def _packed(dim: int):
    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, x = _matrix(b.column("vec"), dim)
            yield pa.RecordBatch.from_arrays([b.column("id").take(pa.array(at)), _binary(_planes(x))], ["b", "other"])

    return packed


def _rerank(dim: int, at_least: float):
    def rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            x, y = (_floats(b.column(c).to_pylist(), dim).astype(np.float64) for c in ("raw", "other"))
            cos = (x * y).sum(1) / np.sqrt((x * x).sum(1) * (y * y).sum(1))
            ok = np.flatnonzero(cos >= at_least)
            yield pa.RecordBatch.from_arrays([b.column("a").take(pa.array(ok)), b.column("b").take(pa.array(ok)), pa.array(cos[cos >= at_least])], ["a", "b", "cos"])

    return rerank


def neighbours(df: DataFrame, *, id: str, vector: str, k: int = 5, at_least: float = 0.9) -> DataFrame:  # noqa: A002
    """``(id_a, id_b, cos)``: of every vector its ``k`` nearest others, as far as their cosine reaches ``at_least``.

    Ties go to the smaller id. Defined cases: null, all-zero and non-finite vectors and null ids are no vectors; vectors
    of different lengths have no cosine, so that each length is a collection of its own; scale is ignored; an id counts
    once for each different vector it has and is never its own neighbour; empty tables give no rows.
    """
    rows = df.select(F.col(id).cast("bigint").alias("id"), F.col(vector).cast("array<float>").alias("vec")).where("id IS NOT NULL AND vec IS NOT NULL")
    sizes = rows.groupBy(F.size("vec").alias("n")).count().where("n > 0 AND count > 1").orderBy("n").collect()  # one row per length
    parts = [_within(rows.where(F.size("vec") == r.n), r.n, r["count"], k, at_least) for r in sizes]
    release(df.sparkSession)  # what only told the copies apart
    return reduce(DataFrame.unionByName, parts) if parts else df.sparkSession.createDataFrame([], _FOUND)


_FOUND = "id_a bigint, id_b bigint, cos double"


def _within(rows: DataFrame, dim: int, total: int, k: int, at_least: float) -> DataFrame:
    """``neighbours`` of vectors of one length."""
    spark = rows.sparkSession
    none = spark.createDataFrame([], _FOUND)
    marks = cut(rows.mapInArrow(_marks(dim), "id bigint, h1 bigint, h2 bigint"))
    same = marks.distinct().groupBy("h1", "h2").agg(F.min("id").alias("rep"), F.count("*").alias("n")).where("n > 1").select("h1", "h2", "rep")
    members = cut(marks.hint("merge").join(same.hint("merge"), ["h1", "h2"]).select("id", "rep").distinct())
    step = max(1, -(-total // sample_rows(total)))
    x = _drawn(rows.where(F.pmod(F.xxhash64("id"), F.lit(step)) == 0), dim)
    if len(x) < 64:
        x = _drawn(rows.limit(SAMPLE), dim)
    if not len(x):
        return none
    index = VectorIndex(x, total, at_least)
    shared = spark.sparkContext.broadcast(index)  # bounded: at most MOST_SAMPLE / 16 centres and 16 small books

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from _enter(shared.value)(batches)

    def ask(table: pa.Table) -> pa.Table:
        return _ask(shared.value)(table)

    entries = rows.mapInArrow(enter, _ENTRY)
    close = entries.groupBy("cell", "share").applyInArrow(ask, "a bigint, b bigint, raw binary")
    other = rows.mapInArrow(_packed(dim), "b bigint, other binary").hint("merge")
    found = close.hint("merge").join(other, "b").select("a", "b", "raw", "other").mapInArrow(_rerank(dim, at_least), "a bigint, b bigint, cos double")
    # Copies that different tasks listed become their class's smallest id.
    for c in ("a", "b"):
        found = found.hint("merge").join(members.select(F.col("id").alias(c), F.col("rep").alias(f"rep_{c}")).hint("merge"), c, "left").withColumn(c, F.coalesce(f"rep_{c}", c)).drop(f"rep_{c}")
    found = found.where("a <> b")
    both = found.unionByName(found.select(F.col("b").alias("a"), F.col("a").alias("b"), "cos"))
    nearest = both.groupBy("a", "b").agg(F.max("cos").alias("cos"))

    def first(frame: DataFrame, by: list[str], order: list, n: int) -> DataFrame:
        return frame.withColumn("place", F.row_number().over(W.partitionBy(*by).orderBy(*order))).where(F.col("place") <= n).drop("place")

    best = first(nearest, ["a"], [F.desc("cos"), F.col("b")], k)
    # Copies: of each class its first ids stand for it as neighbours, all of its members ask.
    head = first(members, ["rep"], [F.col("id")], k + 1).select("rep", F.col("id").alias("head"))
    asked = best.hint("merge").join(members.select(F.col("rep").alias("a"), F.col("id").alias("ma")).hint("merge"), "a", "left").select(F.coalesce("ma", "a").alias("a"), "b", "cos")
    across = asked.hint("merge").join(head.select(F.col("rep").alias("b"), F.col("head").alias("mb")).hint("merge"), "b", "left").select("a", F.coalesce("mb", "b").alias("b"), "cos")
    own = members.hint("merge").join(head.hint("merge"), "rep").select(F.col("id").alias("a"), F.col("head").alias("b"), F.lit(1.0).alias("cos"))
    every = across.unionByName(own).where("a <> b").groupBy("a", "b").agg(F.max("cos").alias("cos"))
    return first(every, ["a"], [F.desc("cos"), F.col("b")], k).select(F.col("a").alias("id_a"), F.col("b").alias("id_b"), F.col("cos"))


def neighbour_pairs(found: DataFrame) -> DataFrame:
    """``(id_a, id_b)`` with id_a < id_b where one is among the other's nearest."""
    return found.select(F.least("id_a", "id_b").alias("id_a"), F.greatest("id_a", "id_b").alias("id_b")).distinct()
