"""Embedding near-dedup by collision counting on one-dimensional projections."""

from __future__ import annotations

import functools
import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Scratch, components

#: Width of a cell on a line, in distances of a pair at the threshold, and how many vectors a cell should hold by chance.
WIDTH, HELD = 8.0, 256


def calibrate(cosine: float, lines: int, window: float, recall: float) -> tuple[float, int]:
    """(half width, least count): a pair at the threshold shares this many of `lines` windows with probability `recall`.

    The projection of a pair's difference on a Gaussian line is normal with the pair's distance as deviation, so each
    window of `window` deviations holds the partner with one known probability, and counts are binomial. Closer pairs
    collide more often.
    """
    distance = math.sqrt(2 - 2 * cosine)
    p = math.erf(window / math.sqrt(2))
    tail, least = 1.0, 0
    for c in range(lines + 1):  # P(count < c) <= 1 - recall
        if 1 - tail > 1 - recall:
            break
        least = c
        tail -= math.comb(lines, c) * p**c * (1 - p) ** (lines - c)
    return window * distance, least


def same_cell(distance: float, width: float) -> float:
    """Probability that two points this far apart share a cell of a Gaussian line cut at random places."""
    r = width / distance
    return math.erf(r / math.sqrt(2)) - math.sqrt(2 / math.pi) / r * (1 - math.exp(-r * r / 2))


@dataclass
class Cells:
    """Tables of cells: a cell of a table is a stretch on each of its `lines` lines."""

    tables: int
    lines: int
    width: float

    def codes(self, v: np.ndarray) -> np.ndarray:
        """(vector, table) to cell, as a hash of table, dimension and stretches."""
        r = np.random.RandomState(5)
        out = np.empty((len(v), self.tables), np.int64)
        odd = r.randint(1, 1 << 62, self.lines + 1, dtype=np.int64) * 2 + 1
        for t in range(self.tables):
            a, b = r.standard_normal((v.shape[1], self.lines)), r.uniform(0, self.width, self.lines)
            with np.errstate(over="ignore"):
                out[:, t] = np.floor((v @ a + b) / self.width).astype(np.int64) @ odd[:-1] + odd[-1] * (t * 65536 + v.shape[1])
        return out


def plan(n: int, cosine: float, recall: float, apart: float = math.sqrt(2)) -> Cells:
    """Tables for n vectors: enough lines that vectors `apart` share a cell with no more than HELD by chance, and enough
    tables that a pair at the threshold shares one of them with probability `recall`."""
    distance = math.sqrt(2 - 2 * cosine)
    width = WIDTH * distance
    lines = max(0, math.ceil(math.log(max(n, 1) / HELD) / -math.log(same_cell(apart, width))))
    share = same_cell(distance, width) ** lines
    return Cells(1 if share == 1 else math.ceil(math.log(1 - recall) / math.log(1 - share)), lines, width)


def unit(vectors: pa.Array) -> list[bytes | None]:
    """Unit vectors in double precision as bytes; None for null, empty, zero and non-finite ones. Lengths may differ."""
    sizes = vectors.value_lengths().fill_null(0).to_numpy(zero_copy_only=False)
    out: list[bytes | None] = [None] * len(vectors)
    for dim in np.unique(sizes[sizes > 0]):
        at = np.flatnonzero(sizes == dim)
        flat = vectors.take(pa.array(at)).flatten()
        missing = flat.is_null().to_numpy(zero_copy_only=False).reshape(-1, dim).any(1)
        values = flat.fill_null(0).to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
        with np.errstate(all="ignore"):
            top = np.abs(values).max(1)
            good = np.flatnonzero(~missing & np.isfinite(values).all(1) & (top > 0))
            values = values[good] / top[good][:, None]
            values /= np.sqrt(np.einsum("ij,ij->i", values, values))[:, None]
        for i, x in zip(at[good].tolist(), values):
            out[i] = x.tobytes()
    return out


@functools.lru_cache(maxsize=8)
def gaussian(dim: int, lines: int, seed: int = 11) -> np.ndarray:
    return np.random.RandomState(seed).standard_normal((dim, lines))


def stack(v: pa.BinaryArray) -> np.ndarray:
    """Vectors of one length as rows of a matrix."""
    at = np.frombuffer(v.buffers()[1], np.int32)[v.offset:v.offset + len(v) + 1]
    return np.frombuffer(v.buffers()[2], np.uint8)[at[0]:at[-1]].view(np.float64).reshape(len(v), -1)


def collisions(p: np.ndarray, r: np.ndarray, half: int) -> np.ndarray:
    """In how many windows of half width `half` around p[..., i, :] the points r[..., j, :] lie, for all i and j."""
    shape = (*p.shape[:-1], r.shape[-2])
    count, gap, hit = np.zeros(shape, np.uint8), np.empty(shape, np.int16), np.empty(shape, bool)
    p, low = np.ascontiguousarray(np.moveaxis(p, -1, 0)), np.ascontiguousarray(np.moveaxis(r, -1, 0)) - np.int16(half)
    for k in range(len(p)):  # a gap below the window wraps round to a large number
        np.subtract(p[k][..., :, None], low[k][..., None, :], out=gap)
        np.less_equal(gap.view(np.uint16), np.uint16(2 * half), out=hit)
        np.add(count, hit.view(np.uint8), out=count)
    return count


def near(x: np.ndarray, i: np.ndarray, j: np.ndarray, cosine: float) -> np.ndarray:
    return np.concatenate([np.einsum("ij,ij->i", x[i[s:s + 65536]], x[j[s:s + 65536]]) for s in range(0, len(i), 65536)] or [np.zeros(0)]) >= cosine


def met(x: np.ndarray, left: np.ndarray, right: np.ndarray, p: np.ndarray, half: int, reach: int, least: int, cosine: float):
    """Blocks of linked pairs (i, j) of x, i in left and j in right, each pair once if left is right.

    Both sides are sorted on the first line. A block of queries meets the stretch of the other side that lies within
    reach of it there, and counts collisions on all lines.
    """
    same = left is right
    left = left[np.argsort(p[left, 0], kind="stable")]
    right = left if same else right[np.argsort(p[right, 0], kind="stable")]
    line = p[right, 0].astype(np.int32)
    for s in range(0, len(left), 128):
        own = left[s:s + 128]
        a, b = (s if same else int(np.searchsorted(line, int(p[own[0], 0]) - reach))), int(np.searchsorted(line, int(p[own[-1], 0]) + reach, "right"))
        for c in range(a, b, 512):
            other = right[c:min(b, c + 512)]
            i, j = np.nonzero(collisions(p[own], p[other], half) >= least)
            if same:
                later = j + c > i + s
                i, j = i[later], j[later]
            if len(i) * 8 > len(own) * len(other):
                good = (x[own] @ x[other].T)[i, j] >= cosine
                i, j = own[i[good]], other[j[good]]
            else:
                i, j = own[i], other[j]
                good = near(x, i, j, cosine)
                i, j = i[good], j[good]
            if len(i):
                yield i, j


def within(x: np.ndarray, order: np.ndarray, starts: np.ndarray, sizes: np.ndarray, p: np.ndarray, half: int, reach: int, least: int, cosine: float, most: int = 64):
    """Blocks of linked pairs of x within cells order[start:start + size]; small cells of one size at a time, as one array."""
    for start, size in zip(starts[sizes > most].tolist(), sizes[sizes > most].tolist()):
        own = order[start:start + size]
        yield from met(x, own, own, p, half, reach, least, cosine)
    for size in np.unique(sizes[(sizes > 1) & (sizes <= most)]).tolist():
        own, step = starts[sizes == size], max(1, (1 << 18) // (size * size))
        later = np.triu(np.ones((size, size), bool), 1)
        for c in range(0, len(own), step):
            rows = order[own[c:c + step, None] + np.arange(size)]
            k, i, j = np.nonzero((collisions(p[rows], p[rows], half) >= least) & later)
            i, j = rows[k, i], rows[k, j]
            good = near(x, i, j, cosine)
            if good.any():
                yield i[good], j[good]


def link(vectors: DataFrame, scratch: Scratch, cosine: float = 0.95, lines: int = 24, window: float = 1.58, recall: float = 0.9995, rows: int = 2048) -> DataFrame:
    """vectors(vec_id, embedding array<float or double>) to vec_id, n_links, component_id, kept: classes linked by cosine.

    Vectors meet in cells: in each of some tables, those that share a stretch on each of the table's Gaussian lines
    (see plan(): the numbers follow from recall and the number of vectors, so that a vector meets about HELD others a
    table where nothing is alike). Where they meet, every vector is the centre of a window on each of `lines` further lines;
    collisions are counted and pairs with the calibrated count get their cosine taken. A pair belongs to the first
    table in which it shares a cell. With probability `recall` each, a pair at the threshold shares a cell and has the count;
    closer pairs more often.

    Vectors go to the cells' tasks in one shuffle. Small cells are dealt to tasks of about `rows` vectors; a cell of
    more is cut into blocks, which meet two at a time.
    So a task is bounded whatever the data; it returns links a vector and a spanning forest, never pairs. Equal vectors
    are one. Work grows with n * tables where nothing is alike, and with the square of a group of near copies only,
    since n_links counts its pairs.

    Vectors link with those of their length only. Null, empty and zero vectors and those with null or non-finite
    components have no links and are their own class. n_links counts rows, equal vectors too. component_id is the
    smallest vec_id of the class that is not null; kept is null-safe. Repeated and null vec_ids are separate rows. An
    empty table gives an empty result. Other columns are not read.
    """
    half, least = calibrate(cosine, lines, window, recall)
    step = half / 400  # projections of unit vectors then fit int16
    reach = math.ceil(4.5 * math.sqrt(2 - 2 * cosine) / step)

    def units(batches):
        for b in batches:
            for s in range(0, b.num_rows, 4096):
                own = b.slice(s, 4096)
                yield pa.record_batch([own.column("vec_id"), pa.array(unit(own.column("embedding")), pa.binary())], ["vec_id", "v"])

    flat = scratch.save(vectors.select("vec_id", "embedding").mapInArrow(units, "vec_id long, v binary").select("vec_id", "v", F.when(F.col("v").isNotNull(), F.xxhash64("v")).alias("node")))
    unique = scratch.save(flat.where("v is not null").groupBy("node").agg(F.first("v").alias("v"), F.min("vec_id").alias("low"), F.count("*").alias("copies")))
    n = unique.count()
    cells = plan(n, cosine, recall)

    def place(batches, whole=False):
        """(cell, t) of each vector in each table, with node or with all that pairs need."""
        for b in batches:
            for s in range(0, b.num_rows, 1024):
                own = b.slice(s, 1024)
                dims = pc.binary_length(own.column("v")).to_numpy(zero_copy_only=False)
                for dim in np.unique(dims):
                    part = own.take(pa.array(np.flatnonzero(dims == dim)))
                    codes = cells.codes(stack(part.column("v")))
                    for t in range(cells.tables):
                        out = {"cell": pa.array(codes[:, t]), "t": pa.array(np.full(part.num_rows, t, np.int32))}
                        yield pa.record_batch(out | ({c: part.column(c) for c in ("node", "copies", "v")} if whole else {}))

    def place_whole(batches):
        yield from place(batches, True)

    packs = max(1, round(n * cells.tables / rows))
    large = unique.select("v").mapInArrow(place, "cell long, t int").groupBy("cell").agg(F.count("*").alias("c")).where(F.col("c") > rows)
    large = scratch.save(large.select("cell", F.ceil(F.col("c") / rows).cast("int").alias("parts")))
    wide = unique.select("node", "copies", "v").mapInArrow(place_whole, "cell long, t int, node long, copies long, v binary").join(large, "cell", "left")
    cut = F.col("parts").isNotNull()
    wide = wide.withColumn("block", F.when(cut, F.pmod(F.col("node"), F.col("parts"))).otherwise(0).cast("int"))
    wide = wide.withColumn("other", F.explode(F.when(cut, F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.lit(0)))))
    pack = F.when(cut, F.col("cell")).otherwise(F.pmod(F.xxhash64("cell"), F.lit(packs)))
    wide = wide.select("node", "v", "copies", "cell", "t", "block", cut.alias("cut"), pack.alias("pack"), F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))

    def work(key, own):
        node, copies = own.column("node").to_numpy(), own.column("copies").to_numpy()
        v, dims = own.column("v").combine_chunks(), pc.binary_length(own.column("v")).to_numpy()
        who, one, spot = np.unique(node, return_index=True, return_inverse=True)
        many = copies[one]
        links, parent = np.zeros(len(who), np.int64), list(range(len(who)))
        label = np.arange(len(who))

        def root(x):
            while parent[x] != x:
                parent[x] = parent[parent[x]]
                x = parent[x]
            return x

        for dim in np.unique(dims):
            at = np.flatnonzero(dims == dim)
            part = own.take(pa.array(at))
            x, t, cell = stack(v.take(pa.array(at))), part.column("t").to_numpy(), part.column("cell").to_numpy()
            p = np.round(np.clip(x @ gaussian(x.shape[1], lines) / step, -12000, 12000)).astype(np.int16)
            if key[1].as_py() and key[2].as_py() != key[3].as_py():
                block = part.column("block").to_numpy()
                pairs = met(x, np.flatnonzero(block == key[2].as_py()), np.flatnonzero(block == key[3].as_py()), p, 400, reach, least, cosine)
            else:
                order = np.argsort(cell, kind="stable")
                starts = np.flatnonzero(np.concatenate([[True], np.diff(cell[order]) != 0]))
                pairs = within(x, order, starts, np.diff(starts, append=len(order)), p, 400, reach, least, cosine)
            codes = None
            for i, j in pairs:
                codes = cells.codes(x) if codes is None else codes
                first = np.argmax(codes[i] == codes[j], axis=1) == t[i]  # each pair in the first table that has it
                i, j = spot[at[i[first]]], spot[at[j[first]]]
                links += np.bincount(i, weights=many[j], minlength=len(who)).astype(np.int64) + np.bincount(j, weights=many[i], minlength=len(who)).astype(np.int64)
                new = label[i] != label[j]
                if new.any():
                    for s, e in zip(i[new].tolist(), j[new].tolist()):
                        s, e = root(s), root(e)
                        if s != e:
                            parent[max(s, e)] = min(s, e)
                    label = np.array([root(s) for s in range(len(who))])
        some = np.flatnonzero(links)
        return pa.table({"node": who[some], "links": links[some], "to": who[label[some]]})

    found = scratch.save(wide.groupBy("pack", "cut", "i", "j").applyInArrow(work, "node long, links long, to long"))
    classes = components(found.select(F.col("node").alias("u"), F.col("to").alias("v")), scratch)
    out = unique.select("node", "low", "copies").join(found.groupBy("node").agg(F.sum("links").alias("links")), "node", "left").join(classes, "node", "left")
    out = scratch.save(out.select("node", "low", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("n_links"), F.coalesce("component", "node").alias("component")))
    low = out.groupBy("component").agg(F.min("low").alias("component_id"))
    out = out.join(low, "component").select("node", "n_links", "component_id")
    out = flat.select("vec_id", "node").join(out, "node", "left")
    component = F.when(F.col("node").isNull(), F.col("vec_id")).otherwise(F.col("component_id"))
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))
