"""Near-duplicates by DartMinHash.

A document is a weighted set: its five-word shingles with their counts. Darts are thrown, by hashing, at the regions
(weight x rank) of its elements; of the darts that hit, each of the signature's coordinates keeps the one of lowest rank.
Two documents keep the same dart at a coordinate with the probability of their weighted Jaccard similarity. Coordinates
are joined in bands; documents that share a band are compared with the band's centre, and the exact weighted Jaccard
similarity decides. Classes are the connected components of the links.

Exact copies are folded first, so a group of copies costs one document. A band of any size gives one comparison a member, with
its centre, never all pairs. Members that this does not join to their centre's class are compared again in finer bands (of 8 and of
16 coordinates, so the more alike two texts are the more of the small bands they share), with two centres each. These rounds only save work:
in each coarse band whose members are then still of several classes, all members of different classes are compared, block by block,
so every two texts that share a band are in one class, or were compared.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, of_bytes, release, text_of
from .words import U, lists, mix, powers, rows_of, shingles, signed, words

SHINGLE, THRESHOLD = 5, 0.8
#: At similarity 0.8 a pair shares no band with probability (1 - 0.8 ** 4) ** 24 = 3e-6.
BANDS, BAND_SIZE = 24, 4
#: Finer bands: so many coarse bands together, in so many combinations.
FINE = ((2, 72), (4, 144))
#: log2 of the lowest rank cell's width.
_LOW = -8
SLICE = 2 << 20
#: What a block of a band's members holds, in shingles, and what a member costs beside its shingles.
BLOCK, MEMBER = 1 << 18, 256
#: Cells of a matrix of members and elements.
CELLS = 4 << 20
#: Pairs of a centre for which it has a copy of its own.
HOT = 200


@cache
def _poisson(log_area: int) -> np.ndarray:
    """Cumulative probabilities of 0, 1, ... points in a cell of area 2 ** log_area."""
    area = 2.0**log_area
    n = np.arange(int(area + 12 * math.sqrt(area) + 12))
    logs = n * math.log(area) - area - np.concatenate([[0], np.cumsum(np.log(np.arange(1, len(n))))])
    return np.minimum(np.cumsum(np.exp(logs)), 1 - 2**-53)


def _unit(x: np.ndarray) -> np.ndarray:
    return (x >> U(11)).astype(np.float64) * 2.0**-53


def darts(elements: np.ndarray, weights: np.ndarray, most_rank: np.ndarray, k: int) -> tuple[np.ndarray, ...]:
    """(element index, coordinate, rank, id) of all darts that hit, with rank below 2 ** most_rank of their element.

    Cells are dyadic in weight and in rank. A cell's number of points and their places follow from the hash of
    element and cell alone, so any two sets that hold an element see the same darts."""
    found = []
    tops = int(most_rank.max(initial=_LOW))
    heaviest = float(weights.max(initial=0.0))
    for w in range(64):
        low, high = (0.0, 1.0) if w == 0 else (2.0 ** (w - 1), 2.0**w)
        if low >= heaviest:
            break
        heavy = np.flatnonzero(weights > low)
        for r in range(_LOW, tops + 1):
            mine = heavy if r == _LOW else heavy[most_rank[heavy] >= r]
            below, width = (0.0, 2.0**r) if r == _LOW else (2.0 ** (r - 1), 2.0 ** (r - 1))
            cell = U((w * 131 + (r - _LOW) * 8209 + 1) * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)
            seeds = mix(elements[mine] + cell)
            n = np.searchsorted(_poisson(round(math.log2(width * (high - low)))), _unit(seeds), "right")
            hit = n > 0
            n, seeds, mine = n[hit], seeds[hit], mine[hit]
            at = np.repeat(np.arange(len(n)), n)
            each = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
            ids = mix(seeds[at] + (each.astype(U) + U(1)) * U(0xD1342543DE82EF95))
            place = low + (high - low) * _unit(mix(ids + U(1)))
            rank = below + width * _unit(mix(ids + U(2)))
            slot = (mix(ids + U(3)) >> U(32)) % U(k)
            keep = place < weights[mine[at]]
            found.append((mine[at][keep], slot[keep].astype(np.int64), rank[keep], ids[keep]))
    return tuple(np.concatenate(x) for x in zip(*found, strict=True)) if found else (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0), np.zeros(0, U))


def signatures(elements: np.ndarray, weights: np.ndarray, counts: np.ndarray, k: int) -> np.ndarray:
    """k dart ids a row; counts: elements of each row. Rows without elements have zeros."""
    row = rows_of(counts)
    total = np.bincount(row, weights, len(counts))
    out = np.zeros((len(counts), k), dtype=U)
    open_rows = np.flatnonzero(total > 0)
    with np.errstate(divide="ignore"):
        ranks = np.ceil(np.log2(k * (math.log(k) + 3) / total))
    while len(open_rows):
        number = np.full(len(counts), -1)
        number[open_rows] = np.arange(len(open_rows))
        mine = np.flatnonzero(number[row] >= 0)
        element, slot, rank, ids = darts(elements[mine], weights[mine], np.maximum(ranks[row[mine]], _LOW), k)
        place = number[row[mine[element]]] * k + slot
        best = np.full(len(open_rows) * k, np.inf)
        np.minimum.at(best, place, rank)
        won = rank == best[place]
        sig = np.zeros(len(best), dtype=U)
        sig[place[won]] = ids[won]
        out[open_rows] = sig.reshape(-1, k)
        # a coordinate that no dart has hit: all ranks of that row go up to twice the bound
        open_rows = open_rows[np.isinf(best).reshape(-1, k).any(axis=1)]
        ranks[open_rows] = np.maximum(ranks[open_rows], _LOW) + 1
    return out


def weighted_shingles(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(element, weight, elements of each row): the distinct shingles of each row with their counts, sorted by row."""
    every, n = shingles(hashes, counts, SHINGLE)
    row = rows_of(n)
    keyed = mix(every + row.astype(U) * U(0xC2B2AE3D27D4EB4F))
    _, first, weight = np.unique(keyed, return_index=True, return_counts=True)
    order = np.argsort(first)
    first, weight = first[order], weight[order]
    return every[first], weight.astype(np.float64), np.bincount(row[first], minlength=len(counts))


def band_keys(sig: np.ndarray) -> np.ndarray:
    """A hash of each band of each row."""
    parts = sig.reshape(len(sig), BANDS, BAND_SIZE)
    key = np.zeros((len(sig), BANDS), dtype=U)
    for j in range(BAND_SIZE):
        key = mix(key * U(0xA24BAED4963EE407) + parts[:, :, j])
    return mix(key + np.arange(BANDS).astype(U))


def fine_keys(coarse: np.ndarray) -> np.ndarray:
    """Hashes of the finer bands, from those of the coarse ones: fixed random combinations."""
    rng = np.random.default_rng(7)
    out = []
    for size, n in FINE:
        for i in range(n):
            key = np.full(len(coarse), U(size * 1000 + i))
            for j in sorted(rng.choice(BANDS, size, replace=False).tolist()):
                key = mix(key * U(0xA24BAED4963EE407) + coarse[:, j])
            out.append(key)
    return np.stack(out, 1)


def _prints(w) -> list[np.ndarray]:
    """Two independent hashes of each row's sequence of words."""
    at = np.arange(len(w.hashes)) - np.repeat(np.cumsum(w.counts) - w.counts, w.counts)
    ends, out = np.cumsum(w.counts), []
    for base in (U(0xB5026F5AA96619E9), U(0x8EBC6AF09C88C6E3)):
        sums = np.zeros(len(w.hashes) + 1, dtype=U)
        np.cumsum(w.hashes * powers(base, int(w.counts.max(initial=0)) + 1)[at], out=sums[1:])
        out.append(mix(sums[ends] - sums[ends - w.counts] + w.counts.astype(U)).view(np.int64))
    return out


def _signed_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in of_bytes(batches, "text", SLICE):
        w = words(text_of(batch))
        element, weight, n = weighted_shingles(w.hashes, w.counts)
        key = band_keys(signatures(element, weight, n, BANDS * BAND_SIZE))
        some = n > 0
        prints = _prints(w)
        yield pa.RecordBatch.from_arrays([
            batch.column(0), pa.array(prints[0], mask=~some), pa.array(prints[1], mask=~some),
            pa.array(np.maximum(w.counts - SHINGLE + 1, some)), lists(signed(key[some].ravel()), np.where(some, BANDS, 0)),
        ], ["doc_id", "print1", "print2", "n_shingles", "bands"])


def _element_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, elements: hashes of (shingle, number of its occurrence), so that overlap of sets is overlap of counts."""
    for batch in of_bytes(batches, "text", SLICE):
        w = words(text_of(batch))
        every, n = shingles(w.hashes, w.counts, SHINGLE)
        keyed = mix(every + rows_of(n).astype(U) * U(0xC2B2AE3D27D4EB4F))
        order = np.argsort(keyed, kind="stable")
        ordered = keyed[order]
        new = np.concatenate([[True], ordered[1:] != ordered[:-1]])[: len(ordered)]
        begin = np.maximum.accumulate(np.where(new, np.arange(len(ordered)), 0))
        number = np.empty(len(ordered), dtype=U)
        number[order] = (np.arange(len(ordered)) - begin).astype(U)
        yield pa.RecordBatch.from_arrays([batch.column(0), lists(signed(mix(every + number * U(0x9FB21C651E98DF25))), n)], ["doc_id", "elements"])


def _fine_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """bands: doc_id, n_shingles, bands as the coarse ones were; out: doc_id, n_shingles, band."""
    for batch in batches:
        coarse = batch.column(2)
        fine = fine_keys(coarse.values.slice(coarse.offsets[0].as_py(), len(batch) * BANDS).to_numpy().view(U).reshape(-1, BANDS))
        each = np.repeat(np.arange(len(batch)), fine.shape[1])
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(each)), batch.column(1).take(pa.array(each)), signed(fine.ravel())], ["doc_id", "n_shingles", "band"])


def _sign(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_signed_rows, "doc_id long, print1 long, print2 long, n_shingles long, bands array<long>")


def components(links: DataFrame) -> DataFrame:
    """node, root: connected components of links (a, b), root the lowest id of the component. Alternating large and small stars until nothing changes; every step is cut."""
    pairs = links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u != v").distinct()
    before, last = None, None
    while True:
        # large star: neighbours above a node hang on its lowest neighbour
        both = pairs.unionByName(pairs.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("low"))
        large = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
        # small star: a node and its neighbours below it hang on the lowest of them
        low = large.groupBy("u").agg(F.min("v").alias("low"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("low").alias("v"))
        pairs = cut(small.unionByName(low.select("u", F.col("low").alias("v"))).where("u != v").distinct(), "stars")
        now = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(20,0)"))).first()
        if last is not None:
            release(last)
        last = pairs
        if now == before:
            return pairs.select(F.col("u").alias("node"), F.col("v").alias("root"))
        before = now


def _similar(pairs: DataFrame, elements: DataFrame, hot: int = HOT) -> DataFrame:
    """pairs (a, b) with their exact weighted Jaccard similarity. A centre b of many pairs is copied, one copy for each `hot` of its pairs, so that no task gets them all."""
    e = elements.withColumn("n", F.size("elements"))
    copies = cut(pairs.groupBy("b").agg(F.count(F.lit(1)).alias("__k")).where(F.col("__k") > hot).select("b", F.ceil(F.col("__k") / hot).cast("int").alias("__copies")), "hot")
    few = copies.limit(100_001).count() <= 100_000
    copied = lambda df: df.join(F.broadcast(copies) if few else copies, "b", "left").withColumn("__copies", F.coalesce("__copies", F.lit(1)))
    salted = copied(pairs).withColumn("__salt", F.pmod(F.xxhash64("a"), "__copies").cast("int"))
    centres = copied(pairs.select("b").distinct()).withColumn("__salt", F.explode(F.sequence(F.lit(0), F.col("__copies") - 1))).select("b", "__salt")
    centres = centres.join(e.select(F.col("doc_id").alias("b"), F.col("elements").alias("eb"), F.col("n").alias("nb")), "b")
    both = salted.join(e.select(F.col("doc_id").alias("a"), F.col("elements").alias("ea"), F.col("n").alias("na")), "a").join(centres, ["b", "__salt"])
    shared = F.size(F.array_intersect("ea", "eb"))
    return both.select("a", "b", (shared / (F.col("na") + F.col("nb") - shared)).alias("similarity"))


def _star_pairs(members: DataFrame, threshold: float, both_ends: bool = False) -> DataFrame:
    """a, b: each member of a band with the band's centre, its lowest doc_id (and also the highest, if both_ends). members: doc_id, n_shingles, band.
    Pairs that their lengths alone hold below the threshold are left out."""
    me = F.struct("doc_id", "n_shingles")
    ends = members.groupBy("band").agg(F.min(me).alias("low"), F.max(me).alias("high")).where("low.doc_id != high.doc_id")
    centres = ends.select("band", F.explode(F.array("low", "high") if both_ends else F.array("low")).alias("c"))
    hung = members.join(centres, "band").where(F.col("doc_id") != F.col("c.doc_id"))
    fits = F.least("n_shingles", "c.n_shingles") >= threshold * F.greatest("n_shingles", "c.n_shingles")
    return hung.where(fits).select(F.greatest("doc_id", "c.doc_id").alias("a"), F.least("doc_id", "c.doc_id").alias("b")).distinct()


def _overlaps(a: np.ndarray, na: np.ndarray, b: np.ndarray, nb: np.ndarray) -> np.ndarray:
    """How many elements each set of a shares with each set of b; a, b: the sets' distinct elements in order, na, nb: their sizes."""
    at = np.unique(np.concatenate([a, b]), return_inverse=True)[1]
    at_a, at_b = at[: len(a)], at[len(a) :]
    number = np.zeros(int(at.max(initial=-1)) + 1, dtype=bool)
    number[at_a] = True
    both = np.flatnonzero(number[at_b])
    shared = np.unique(at_b[both])
    number[:] = False
    number[shared] = True
    sides = []
    for at, n in ((at_a, na), (at_b, nb)):
        row, keep = rows_of(n), number[at]
        column = np.searchsorted(shared, at[keep])
        order = np.argsort(column, kind="stable")
        sides.append((row[keep][order], column[order]))
    out = np.zeros((len(na), len(nb)))
    step = max(1, CELLS // max(1, len(na), len(nb)))
    for low in range(0, len(shared), step):
        cells = []
        for (row, column), n in zip(sides, (na, nb), strict=True):
            begin, end = np.searchsorted(column, (low, low + step))
            cells.append(np.zeros((len(n), min(step, len(shared) - low)), dtype=np.float32))
            cells[-1][row[begin:end], column[begin:end] - low] = 1
        out += cells[0] @ cells[1].T
    return out


def _joins_of(threshold: float):
    """Of one pair of blocks: a, b, the classes of which a member of the one block is similar to a member of the other."""

    def compare(table: pa.Table) -> pa.Table:
        side = table.column("side").to_numpy()
        sides = []
        for number in (0, 1) if side.any() else (0, 0):
            mine = table.filter(pa.array(side == number)).combine_chunks()
            elements = mine.column("elements").combine_chunks()
            n = elements.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
            sides.append((mine.column("root").to_numpy(), n, elements.flatten().to_numpy()))
        (root_a, na, a), (root_b, nb, b) = sides
        ends_a, found = np.cumsum(na), []
        for low in range(0, len(na), 1024):
            strip = slice(low, low + 1024)
            begin, end = ends_a[low] - na[low], ends_a[strip][-1]
            shared = _overlaps(a[begin:end], na[strip], b, nb)
            i, j = np.nonzero((shared >= threshold * (na[strip, None] + nb - shared) - 1e-6) & (root_a[strip, None] != root_b))
            exact = shared[i, j] / (na[strip][i] + nb[j] - shared[i, j]) >= threshold
            x, y = root_a[strip][i[exact]], root_b[j[exact]]
            found.append(np.stack([np.maximum(x, y), np.minimum(x, y)], 1))
        once = np.unique(np.concatenate(found), axis=0)
        return pa.table({"a": once[:, 0], "b": once[:, 1]})

    return compare


def _rest(each: DataFrame, elements: DataFrame, roots: DataFrame, threshold: float) -> DataFrame:
    """a, b: classes (by their roots) that similar members of a band join. each: doc_id, n_shingles, band; roots: node, root of the classes so far.

    The members of a band that has several classes are dealt to blocks: those of a large class to blocks of that class alone, the others
    by class. Every two blocks are compared, except two of one class."""
    weight = F.col("n_shingles") + MEMBER
    member = each.join(roots.select(F.col("node").alias("doc_id"), "root"), "doc_id", "left").select("doc_id", "band", F.coalesce("root", "doc_id").alias("root"), weight.alias("weight"))
    per = cut(member.groupBy("band", "root").agg(F.sum("weight").alias("c")), "per")
    bands = per.groupBy("band").agg(F.count(F.lit(1)).alias("k"), F.sum(F.when(F.col("c") <= BLOCK, F.col("c"))).alias("small")).where("k > 1")
    large = F.col("c") > BLOCK
    blocks = F.ceil(F.when(large, F.col("c")).otherwise(F.col("small")) / BLOCK)
    dealt = per.join(bands, "band").select("band", "root", large.alias("large"), blocks.alias("blocks"))
    place = F.struct("large", F.when(F.col("large"), F.col("root")).otherwise(0).alias("of"), F.pmod(F.xxhash64(F.when(F.col("large"), F.col("doc_id")).otherwise(F.col("root"))), "blocks").alias("i"))
    placed = cut(member.join(dealt, ["band", "root"]).select("doc_id", "band", "root", place.alias("block")), "placed")
    x, y = (placed.select("band", F.col("block").alias(c)).distinct() for c in "xy")
    pairs = x.join(y, "band").where("x <= y AND NOT (x.large AND y.large AND x.of = y.of)")
    pairs = cut(pairs.withColumn("g", F.monotonically_increasing_id()), "blocks")
    sides = pairs.select("g", "band", F.col("x").alias("block"), F.lit(0).alias("side")).unionByName(pairs.where("x != y").select("g", "band", F.col("y").alias("block"), F.lit(1).alias("side")))
    rows = placed.join(sides, ["band", "block"]).join(elements, "doc_id").select("g", "side", "root", "elements")
    return cut(rows.groupBy("g").applyInArrow(_joins_of(threshold), "a long, b long").distinct(), "links")


def links(docs: DataFrame, signed_docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """a, b: links between different texts, enough to join the classes of all similar texts that share a band. docs and signed_docs have one row for each distinct text."""
    each = signed_docs.select("doc_id", "n_shingles", F.explode("bands").alias("band"))
    pairs = cut(_star_pairs(each, threshold), "pairs")
    # Only documents that share a band with another go on.
    shared = each.join(each.groupBy("band").count().where("count > 1").select("band"), "band", "left_semi").select("doc_id").distinct()
    shared = cut(shared, "shared")
    elements = cut(docs.join(shared, "doc_id", "left_semi").select("doc_id", "text").mapInArrow(_element_rows, "doc_id long, elements array<long>"), "elements")
    close = lambda p: cut(_similar(p, elements).where(F.col("similarity") >= threshold).select("a", "b"), "links")
    found = close(pairs)
    roots = components(found)
    fine = signed_docs.join(shared, "doc_id", "left_semi").select("doc_id", "n_shingles", "bands").mapInArrow(_fine_rows, "doc_id long, n_shingles long, band long")
    more = _star_pairs(fine, threshold, both_ends=True)
    root = lambda c: F.coalesce(F.col(f"root_{c}"), F.col(c))
    for c in ("a", "b"):
        more = more.join(roots.select(F.col("node").alias(c), F.col("root").alias(f"root_{c}")), c, "left")
    more = cut(more.where(root("a") != root("b")).select("a", "b").join(pairs, ["a", "b"], "left_anti"), "pairs")
    tree = lambda r: r.select(F.col("node").alias("a"), F.col("root").alias("b"))
    roots = components(tree(roots).unionByName(close(more)))
    return tree(roots).unionByName(_rest(each.join(shared, "doc_id", "left_semi"), elements, roots, threshold))


def classes(docs: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, class_id, n_copies, n_shingles: one row for each doc_id; class_id is the lowest doc_id of the class.

    Words are what ASCII white space separates, A-Z as a-z; a text of one to four words has one shingle, of all of them.
    Texts of the same words are exact copies; n_copies counts the documents with the row's words. A null or empty text has
    no shingle and is a class of its own. Rows with a null doc_id cannot be named and are not returned. Rows that share a
    doc_id are one document, taken with the first text (in binary order). Columns beyond doc_id and text are not read.
    """
    once = docs.where(F.col("doc_id").isNotNull()).select("doc_id", "text")
    signed_docs = cut(_sign(once), "signed")
    several = signed_docs.groupBy("doc_id").count().where("count > 1")
    if several.limit(1).count():
        once = cut(once.groupBy("doc_id").agg(F.min("text").alias("text")), "once")
        signed_docs = cut(_sign(once), "signed")
    copies = cut(signed_docs.where(F.col("print1").isNotNull()).groupBy("print1", "print2").agg(F.min("doc_id").alias("first"), F.count(F.lit(1)).alias("n_copies")), "copies")
    firsts = signed_docs.join(copies.select(F.col("first").alias("doc_id")), "doc_id", "left_semi")
    roots = components(links(once, firsts, threshold)).select(F.col("node").alias("first"), "root")
    named = copies.join(roots, "first", "left").select("print1", "print2", "n_copies", F.coalesce("root", "first").alias("class_id"))
    out = signed_docs.select("doc_id", "print1", "print2", "n_shingles").join(named, ["print1", "print2"], "left")
    return out.select("doc_id", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("n_copies", F.lit(1)).cast("long").alias("n_copies"), "n_shingles")


def stage(docs: DataFrame) -> DataFrame:
    """docs without the documents whose class has one of a lower doc_id. Rows with a null doc_id stay; of rows that share a doc_id, one with the lowest
    text stays, by which the document was compared."""
    doubled = classes(docs).where("doc_id != class_id").select("doc_id")
    named = docs.where(F.col("doc_id").isNotNull())
    if named.groupBy("doc_id").count().where("count > 1").limit(1).count():
        named = named.groupBy("doc_id").agg(F.min_by(F.struct(*docs.columns), F.struct(F.col("text").isNull(), "text")).alias("__row")).select("__row.*")
    return named.join(doubled, "doc_id", "left_anti").select(*docs.columns).unionByName(docs.where(F.col("doc_id").isNull()))
