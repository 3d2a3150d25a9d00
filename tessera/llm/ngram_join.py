"""N-gram Jaccard join: a blocked sparse product of the document by n-gram incidence matrix with itself."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import Scratch, components, grams, mix, text_batches, word_hashes

#: Cells of the sketch of n-gram frequencies: 4 MB as counters, 1 MB as levels, at every size of the corpus.
SKETCH_BITS = 20
SKETCH_BLOCKS = 64
#: n-grams of a block of whole sets: two make a task, a megabyte each, so a family's texts go out once for each TILE of it.
TILE = 1 << 17


def shingle_sets(buf: np.ndarray, cuts: np.ndarray, k: int):
    """For each text its sorted distinct k-word shingles as 64-bit hashes; fewer words: the whole sequence as one."""
    words, at = word_hashes(buf, cuts, lower=True)
    all_grams = grams(words, k) if len(words) >= k else words[:0]
    for i in range(len(cuts) - 1):
        n = at[i + 1] - at[i]
        if n >= k:
            yield np.unique(all_grams[at[i]:at[i + 1] - k + 1])
        elif n:
            yield mix(grams(words[at[i]:at[i + 1]], int(n)) ^ np.uint64(0x8EBC6AF09C88C6E3 + int(n)))
        else:
            yield words[:0]


def overlaps(rows: np.ndarray, starts: np.ndarray, column: np.ndarray) -> np.ndarray:
    """Sizes of the intersections of several sets, one after the other in rows, with a sorted one."""
    at = np.searchsorted(column, rows)
    at[at == len(column)] = 0
    return np.add.reduceat((column[at] == rows).astype(np.int64), starts)


def lists(docs: DataFrame, k: int, scratch: Scratch):
    """(row, n, node) of every row, and the frequency levels of n-grams.

    node hashes the whole set: rows with equal sets are one node of the product. Frequencies come from a sketch of all
    documents' sets: one hashed counter array a task, added up by block; only its log levels, of fixed size, go to the
    driver and out again. They order n-grams (rare first, then by hash), which decides cost, never the result.
    """
    size = 1 << SKETCH_BITS

    def scan(batches):
        counts = np.zeros(size, np.uint32)
        for part, buf, cuts in text_batches(batches):
            n, node = [], []
            for s in shingle_sets(buf, cuts, k):
                n.append(len(s))
                node.append(int(mix(np.array([np.bitwise_xor.reduce(mix(s)), s.sum(dtype=np.uint64), len(s)], np.uint64)).sum(dtype=np.uint64).view(np.int64)) if len(s) else 0)
                np.add.at(counts, (s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), 1)
            yield pa.record_batch([part.column("row"), pa.array(n, pa.int64()), pa.array(node, pa.int64()), pa.nulls(len(n), pa.int32()), pa.nulls(len(n), pa.binary())], ["row", "n", "node", "block", "counts"])
        if counts.any():
            blocks = [zlib.compress(x.tobytes(), 1) for x in np.split(counts, SKETCH_BLOCKS)]
            yield pa.record_batch([pa.nulls(SKETCH_BLOCKS, pa.int64()), pa.nulls(SKETCH_BLOCKS, pa.int64()), pa.nulls(SKETCH_BLOCKS, pa.int64()), pa.array(range(SKETCH_BLOCKS), pa.int32()), pa.array(blocks)], ["row", "n", "node", "block", "counts"])

    def add(key: tuple, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size // SKETCH_BLOCKS, np.uint64)
        for b in batches:
            for x in b.column("counts"):
                total += np.frombuffer(zlib.decompress(x.as_py()), np.uint32)
        level = np.floor(4 * np.log2(total.astype(np.float64) + 1)).astype(np.uint8)
        yield pa.record_batch([pa.array([key[0].as_py()], pa.int32()), pa.array([level.tobytes()])], ["block", "level"])

    both = scratch.save(docs.select("row", "text").mapInArrow(scan, "row long, n long, node long, block int, counts binary"))
    rows = both.where("block is null").select("row", "n", "node")
    got = {r["block"]: r["level"] for r in both.where("block is not null").select("block", "counts").groupBy("block").applyInArrow(add, "block int, level binary").collect()}
    levels = np.concatenate([np.frombuffer(got[i], np.uint8) for i in range(SKETCH_BLOCKS)]) if got else np.zeros(size, np.uint8)
    return rows, levels


def least_shared(n: np.ndarray) -> np.ndarray:
    """How many n-grams of their prefixes two linked sets share at least."""
    return np.where(n < 20, 1, np.where(n < 60, 2, 3))


def needed(per_cent: int) -> Column:
    """How many n-grams the prefixes of sets of na and nb have to share at least, for the pair to link: those of the least
    overlap less what can lie beyond the prefix that ends first, which is at most what its set has left."""
    rest = [F.greatest(F.lit(0), F.ceil(F.col(n) * per_cent / 100) - F.when(F.col(n) < 20, 1).when(F.col(n) < 60, 2).otherwise(3)) for n in ("na", "nb")]
    return F.greatest(F.lit(1), F.ceil((F.col("na") + F.col("nb")) * per_cent / (100 + per_cent)) - F.greatest(*rest))


def links(docs: DataFrame, scratch: Scratch, k: int, per_cent: int, block: int = 64) -> tuple[DataFrame, DataFrame]:
    """(row, n, node) of every row and components (node, component) of links between nodes.

    The product runs over the columns that can decide. Sets of n and m that link share per_cent / 100 of the larger at
    least, so with all n-grams in one order, the first n - ceil(n * per_cent / 100) + s of both share s or more: a
    block of columns bounded by the set's size, rare n-grams first. Overlaps add up per pair over these columns. What a
    pair can still gain is bounded by what its sets have beyond the block; pairs that can't reach the overlap that
    their two sizes ask for are dropped, the rest is multiplied out in full.

    1. In each column every node meets the column's least node; their overlaps add up. Links found make components.
    2. Pairs of nodes of different components remain (others can't change a component), so of a column or family only
       nodes outside its largest component look for partners: n copies that link cost about n pairs, not n**2. Nodes
       with the same least node in their columns are a family. In a family of over `block` nodes, blocks of about
       TILE n-grams meet whole, in tasks of two blocks; all other pairs meet in the columns.
    """
    rows, levels = lists(docs, k, scratch)

    def prefix(batches):
        for part, buf, cuts in text_batches(batches):
            h, node, size = [], [], []
            for s in shingle_sets(buf, cuts, k):
                n = len(s)
                if not n:
                    continue
                m = n + int(least_shared(np.array(n))) + (-n * per_cent // 100)  # n - ceil(n * per_cent / 100) + s
                level = levels[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)]
                own = s[np.lexsort((s, level))[:m]] if m < n else s
                h.append(own)
                node.append(np.full(len(own), int(mix(np.array([np.bitwise_xor.reduce(mix(s)), s.sum(dtype=np.uint64), n], np.uint64)).sum(dtype=np.uint64).view(np.int64)), np.int64))
                size.append(np.full(len(own), n, np.int32))
            if h:
                yield pa.record_batch([pa.array(np.concatenate(h).view(np.int64)), pa.array(np.concatenate(node)), pa.array(np.concatenate(size))], ["h", "node", "n"])

    entries = docs.select("text").mapInArrow(prefix, "h long, node long, n int")
    columns = entries.groupBy("h").agg(F.min(F.struct("node", "n")).alias("low"), F.max("node").alias("high")).where("low.node <> high")
    columns = scratch.save(columns.select("h", F.col("low.node").alias("pivot"), F.col("low.n").alias("pivot_n")))
    # columns of one node are out; equal sets are one entry
    shared = scratch.save(entries.join(columns, "h").groupBy("h", "node", "n", "pivot", "pivot_n").count().drop("count"))
    scratch.release()
    nodes = scratch.save(rows.where("n > 0").groupBy("node", "n").agg(F.min("row").alias("row")))
    met = shared.where("node <> pivot").groupBy("node", "n", "pivot", "pivot_n").agg(F.count("*").alias("c"))
    # a column whose least node comes before the pivot may hold the pivot too, one whose least node comes after can't
    upto = F.sum("c").over(Window.partitionBy("node").orderBy("pivot").rowsBetween(Window.unboundedPreceding, 0))
    met = met.select(F.col("node").alias("a"), F.col("pivot").alias("b"), F.col("n").alias("na"), F.col("pivot_n").alias("nb"), upto.alias("c"))
    pairs = scratch.save(met.where((F.least("na", "nb") * 100 >= F.greatest("na", "nb") * per_cent) & (F.col("c") >= needed(per_cent))).select("a", "b"))
    edges = scratch.save(multiply(pairs, nodes, docs, scratch, k, per_cent))
    labels = components(edges.select(F.col("a").alias("u"), F.col("b").alias("v")), scratch)
    scratch.release()

    own = shared.groupBy("node", "n").agg(F.min("pivot").alias("family")).join(labels, "node", "left").withColumn("label", F.coalesce("component", "node")).drop("component")
    sizes = own.groupBy("family", "label").agg(F.count("*").alias("count"), F.sum("n").alias("grams")).groupBy("family").agg(F.sum("count").alias("size"), F.sum("grams").alias("grams"), F.max(F.struct("count", "label", F.col("grams").alias("own"))).alias("main"))
    sizes = sizes.where((F.col("size") > block) & (F.col("size") > F.col("main.count")))
    sizes = scratch.save(sizes.select("family", F.ceil(F.col("grams") / TILE).alias("all"), F.ceil((F.col("grams") - F.col("main.own")) / TILE).alias("some"), F.col("main.label").alias("main")))
    own = scratch.save(own.join(sizes, "family", "left"))
    tiles = _tiles(own.where("all is not null"), nodes, docs, k, per_cent)

    s = scratch.save(shared.select("h", "node", "n").join(own.select("node", "label", F.when(F.col("all").isNotNull(), F.col("family")).alias("family")), "node"))
    by = scratch.save(s.groupBy("h", "label").count().groupBy("h").agg(F.max_by("label", F.struct("count", "label")).alias("largest"), F.count("*").alias("labels")).where("labels > 1").drop("labels"))
    left = s.join(by, "h").where("label <> largest").select("h", F.col("node").alias("a"), F.col("n").alias("na"), "label", "largest", F.col("family").alias("fa"))
    right = s.join(by.select("h"), "h", "left_semi").select("h", F.col("node").alias("b"), F.col("n").alias("nb"), F.col("label").alias("other"), F.col("family").alias("fb"))
    cond = (F.col("label") != F.col("other")) & ((F.col("other") == F.col("largest")) | (F.col("a") < F.col("b"))) & (F.least("na", "nb") * 100 >= F.greatest("na", "nb") * per_cent)
    cond = cond & F.coalesce(F.col("fa") != F.col("fb"), F.lit(True))
    met = left.join(right, "h").where(cond).select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.when(F.col("a") < F.col("b"), F.col("na")).otherwise(F.col("nb")).alias("na"), F.when(F.col("a") < F.col("b"), F.col("nb")).otherwise(F.col("na")).alias("nb"))
    pairs = met.groupBy("a", "b", "na", "nb").agg(F.count("*").alias("c")).where(F.col("c") >= needed(per_cent)).select("a", "b")
    more = scratch.save(multiply(scratch.save(pairs), nodes, docs, scratch, k, per_cent).unionByName(tiles))
    scratch.release()
    if not more.isEmpty():
        labels = components(edges.unionByName(more).select(F.col("a").alias("u"), F.col("b").alias("v")), scratch)
    return rows, labels


def product(sets: list[np.ndarray], left: np.ndarray, right: np.ndarray, per_cent: int) -> tuple[np.ndarray, np.ndarray]:
    """Links (i, j) between sets left and right (places in `sets`): overlaps of all of them as a product of incidence
    matrices. Columns that many of both sides have are multiplied as dense blocks, others entry by entry."""
    size = np.array([len(s) for s in sets], np.int64)
    both = np.zeros(len(left) * len(right), np.float32)
    names = [np.concatenate([sets[i] for i in side]) if len(side) else np.zeros(0, np.uint64) for side in (left, right)]
    rows = [np.repeat(np.arange(len(side)), size[side]) for side in (left, right)]
    shared = np.intersect1d(*names)
    entries = []
    for name, row in zip(names, rows):
        column = np.searchsorted(shared, name)
        column[column == len(shared)] = 0
        keep = shared[column] == name if len(shared) else np.zeros(len(name), bool)
        column, row = column[keep], row[keep]
        order = np.argsort(column, kind="stable")
        entries.append((column[order], row[order]))
    (lc, lr), (rc, rr) = entries
    n, m = np.bincount(lc, minlength=len(shared)), np.bincount(rc, minlength=len(shared))
    heavy = n * m > 1024
    dense, start = np.flatnonzero(heavy), np.concatenate([[0], np.cumsum(m)])
    place = np.cumsum(heavy) - 1
    for c in range(0, len(dense), 2048):
        width = min(2048, len(dense) - c)
        part = []
        for column, row, side in ((lc, lr, left), (rc, rr, right)):
            a, b = np.searchsorted(column, [dense[c], dense[c + width - 1] + 1])
            own = heavy[column[a:b]]
            x = np.zeros((len(side), width), np.float32)
            x[row[a:b][own], place[column[a:b][own]] - c] = 1
            part.append(x)
        both += (part[0] @ part[1].T).ravel()
    lc, lr = lc[~heavy[lc]], lr[~heavy[lc]]
    times = m[lc]
    upto = np.concatenate([[0], np.cumsum(times)])
    a = 0
    while a < len(lc):
        b = max(a + 1, int(np.searchsorted(upto, upto[a] + (1 << 21), "right")) - 1)
        t = times[a:b]
        at = np.repeat(start[lc[a:b]] - (upto[a:b] - upto[a]), t) + np.arange(t.sum())
        both += np.bincount(np.repeat(lr[a:b], t) * len(right) + rr[at], minlength=len(both)).astype(np.float32)
        a = b
    both = both.reshape(len(left), len(right))
    i, j = np.nonzero((both > 0) & (both * 100 >= (size[left][:, None] + size[right][None, :] - both) * per_cent))
    return left[i], right[j]


def deal(own: DataFrame) -> DataFrame:
    """(node, label, family, i, j, first) from own(node, label, family, all, some, main): in which tasks of two blocks of
    its family a node's text is needed, `some` blocks of nodes outside the family's main component by `all` of all nodes."""
    one = own.where("label <> main").select("node", "label", "family", F.lit(True).alias("first"), F.pmod(F.xxhash64("node"), F.col("some")).alias("i"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("all") - 1)).alias("j"))
    two = own.select("node", "label", "family", F.lit(False).alias("first"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("some") - 1)).alias("i"), F.pmod(F.xxhash64("node"), F.col("all")).alias("j"))
    return one.unionByName(two)


def _tiles(own: DataFrame, nodes: DataFrame, docs: DataFrame, k: int, per_cent: int) -> DataFrame:
    """Links (a, b) within families, from own as in deal(); a task holds two blocks' sets."""
    needs = deal(own).groupBy("node").agg(F.collect_list(F.struct("family", "i", "j", "first", "label")).alias("to")).join(nodes.select("node", "row"), "node")
    texts = docs.select("row", "text").join(needs, "row").dropDuplicates(["row"]).select("node", "text", F.explode("to").alias("t")).select("t.*", "node", "text")

    def work(key, own):
        sets = []
        for _, buf, cuts in text_batches(own.select(["text"]).to_batches()):
            sets += shingle_sets(buf, cuts, k)
        first = own.column("first").to_numpy()
        i, j = product(sets, np.flatnonzero(first), np.flatnonzero(~first), per_cent)
        node, label = own.column("node").to_numpy(), own.column("label").to_numpy()
        m = label[i] != label[j]
        return pa.table({"a": node[i[m]], "b": node[j[m]]})

    return texts.groupBy("family", "i", "j").applyInArrow(work, "a long, b long")


def multiply(pairs: DataFrame, nodes: DataFrame, docs: DataFrame, scratch: Scratch, k: int, per_cent: int, block: int = 64) -> DataFrame:
    """Pairs (a, b) with intersection * 100 >= union * per_cent, from the whole sets.

    Pairs are dealt to blocks of rows: those of one b, at most `block` or so together. A block gets its texts once
    each; a task holds one block's sets.
    """
    pairs = scratch.save(_blocks(pairs, scratch, block))
    needs = pairs.select("block", F.explode(F.array("a", "b")).alias("node")).distinct()
    rows = needs.join(nodes.select("node", "row"), "node")
    texts = docs.select("row", "text").join(rows.groupBy("row").agg(F.collect_set(F.struct("block", "node")).alias("to")), "row").dropDuplicates(["row"])
    texts = texts.select(F.explode("to").alias("t"), "text").select("t.block", "t.node", "text")

    def work(key, left, right):
        sets: dict[int, np.ndarray] = {}
        names, i = right.column("node").to_pylist(), 0
        for _, buf, cuts in text_batches(right.select(["text"]).to_batches()):
            for s in shingle_sets(buf, cuts, k):
                sets[names[i]] = s
                i += 1
        a, b = left.column("a").to_numpy(), left.column("b").to_numpy()
        keep = np.zeros(len(a), bool)
        for y in np.unique(b):  # rows of a times the row b
            at = np.flatnonzero(b == y)
            size = np.array([len(sets[x]) for x in a[at].tolist()], np.int64)
            both = overlaps(np.concatenate([sets[x] for x in a[at].tolist()]), np.cumsum(size) - size, sets[int(y)])
            keep[at] = both * 100 >= (size + len(sets[int(y)]) - both) * per_cent
        return left.select(["a", "b"]).filter(pa.array(keep))

    return pairs.groupBy("block").cogroup(texts.groupBy("block")).applyInArrow(work, "a long, b long")


def _blocks(pairs: DataFrame, scratch: Scratch, block: int) -> DataFrame:
    """Pairs of one b in ceil(pairs / block) blocks by a hash of a. The counts are written first, so that Spark can split
    the join where one b has many."""
    count = scratch.save(pairs.groupBy("b").agg(F.ceil(F.count("*") / block).alias("parts")))
    return pairs.join(count, "b").select("a", "b", F.xxhash64("b", F.pmod(F.xxhash64("a"), F.col("parts"))).alias("block"))


def _classes(rows: DataFrame, scratch: Scratch, k: int, per_cent: int) -> DataFrame:
    """(row, n, class) of distinct rows; class is null for empty sets."""
    sets, labels = links(rows, scratch, k, per_cent)
    return sets.dropDuplicates(["row"]).join(labels, "node", "left").select("row", "n", F.when(F.col("n") > 0, F.coalesce("component", "node")).alias("class"))


def link(docs: DataFrame, scratch: Scratch, k: int = 5, per_cent: int = 80) -> DataFrame:
    """docs(doc_id, text) to doc_id, n_shingles, component_id: classes of documents linked by shingle sets.

    A set: distinct k-word shingles of the text with A-Z lower-cased; fewer words: the whole sequence as one. Documents
    link when 100 * intersection >= per_cent * union. component_id is the smallest doc_id reachable by links. Null and
    empty texts have empty sets, link with nothing and are their own class; so is a null doc_id, which stays null.
    Repeated rows link. Other columns are not read.
    """
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).withColumn("row", F.xxhash64("doc_id", "text"))
    ids = scratch.save(rows.select("doc_id", "row").join(_classes(rows, scratch, k, per_cent), "row"))
    low = scratch.save(ids.where("class is not null").groupBy("class").agg(F.min("doc_id").alias("component_id")))
    return ids.join(low, "class", "left").select("doc_id", F.col("n").alias("n_shingles"), F.coalesce("component_id", "doc_id").alias("component_id"))


def representatives(docs: DataFrame, scratch: Scratch, k: int = 5, per_cent: int = 80) -> DataFrame:
    """Rows of docs, all columns as they are, without all but one of each class of link(): that with the smallest doc_id
    (null first, then a hash of the row). Rows equal in doc_id and text count once. Texts without words stay."""
    rows = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("d"), F.xxhash64("doc_id", "text").alias("row"))
    flat = rows.select("d.doc_id", F.coalesce("d.text", F.lit("")).alias("text"), "row")
    own = flat.select("doc_id", "row").join(_classes(flat, scratch, k, per_cent).where("class is not null"), "row")
    keep = scratch.save(own.groupBy("class").agg(F.min(F.struct("doc_id", "row")).alias("first")).select(F.col("first.row").alias("row")))
    words = F.coalesce(F.col("d.text").rlike(r"[^\x20\x09-\x0D]"), F.lit(False))
    return rows.where(words).join(keep, "row", "left_semi").dropDuplicates(["row"]).unionByName(rows.where(~words)).select("d.*")
