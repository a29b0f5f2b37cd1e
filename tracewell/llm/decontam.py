"""Benchmark decontamination: size-partitioned MinHash containment search, verified by exact shingle containment.

Test items are put in classes by their number of shingles, up to 1, 2, 4, 8, ... For a class of size s a document is seen in
windows of 2 s shingles that begin at every s-th, so a stretch of s shingles lies whole in one of them and the item is
never small beside the window, however long the document is. Item and window have one-permutation MinHash signatures:
the least hash in each of 256 bins. A window that shares a value with an item makes the item a candidate, and the share of
the item's distinct shingles that the document holds, counted exactly, decides.

An item of fewer than five words has one shingle, of all its words, and is looked for among the document's runs of so many words.

The items are the stated query set. They are taken in blocks of a bounded number of shingles. Up to BROADCAST blocks are broadcast; beyond, the
blocks lie in the shared folder and a task reads one after the other. A document is hashed once and passes all blocks without a shuffle.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import Files, of_bytes, own_place, text_of
from .words import U, runs, shingles, words

SHINGLE, THRESHOLD = 5, 0.8
#: Shingles of a block of items at which the next block begins (8 bytes each in the broadcast).
BLOCK = 1_000_000
#: Most blocks that are broadcast; of more, tasks read each for every LARGE_SLICE bytes of text instead of SLICE.
BROADCAST = 4
SLICE, LARGE_SLICE = 2 << 20, 16 << 20
_BIN = U(56)  # the top 8 bits of a hash are its bin
_FILTER = 1 << 20
FOUND = T.ArrayType(T.StructType([T.StructField("item_id", T.LongType()), T.StructField("containment", T.DoubleType())]))


def size_class(n: np.ndarray) -> np.ndarray:
    return np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64)


def signature(hashes: np.ndarray) -> np.ndarray:
    """The least hash of each bin that has one."""
    ordered = np.unique(hashes)
    bins = ordered >> _BIN
    return ordered[np.concatenate([[True], bins[1:] != bins[:-1]])] if len(ordered) else ordered


def window_signatures(hashes: np.ndarray, windows: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(window, value) of the signatures of windows of 2 * size hashes of one document; windows: their numbers, of which each begins at its number times size."""
    at = windows[:, None] * size + np.arange(2 * size)[None, :]
    row = np.broadcast_to(np.arange(len(windows))[:, None], at.shape)
    inside = at < len(hashes)
    value, row = hashes[at[inside]], row[inside]
    order = np.lexsort((value, row))
    value, row = value[order], row[order]
    slot = row * 256 + (value >> _BIN).astype(np.int64)
    first = np.concatenate([[True], slot[1:] != slot[:-1]]) if len(slot) else np.zeros(0, dtype=bool)
    return windows[row[first]], value[first]


@dataclass
class Block:
    """Items of a block: their distinct shingles, by class the sorted signature values with the items that have them, and by number of words the same of short items."""

    ids: np.ndarray
    shingles: list[np.ndarray]
    by_class: dict[int, tuple[np.ndarray, np.ndarray]]
    short: dict[int, tuple[np.ndarray, np.ndarray]]

    @classmethod
    def of(cls, ids: np.ndarray, n_words: np.ndarray, shingle_sets: list[np.ndarray]) -> Block:
        sizes = size_class(np.array([len(x) for x in shingle_sets]))
        by_class, short = {}, {}
        for k in range(1, SHINGLE):
            mine = np.flatnonzero(n_words == k)
            if len(mine):
                values = np.array([shingle_sets[i][0] for i in mine], dtype=U)
                order = np.argsort(values, kind="stable")
                short[k] = (values[order], mine[order])
        for c in np.unique(sizes[n_words >= SHINGLE]).tolist():
            mine = np.flatnonzero((sizes == c) & (n_words >= SHINGLE))
            signatures = [signature(shingle_sets[i]) for i in mine]
            values, owners = np.concatenate(signatures), np.repeat(mine, [len(x) for x in signatures])
            order = np.argsort(values, kind="stable")
            by_class[c] = (values[order], owners[order])
        return cls(ids, shingle_sets, by_class, short)

    def __post_init__(self) -> None:
        self.values = np.unique(np.concatenate([np.zeros(0, U), *(v for v, _ in self.by_class.values())]))
        self.bits = np.zeros(_FILTER, dtype=bool)
        self.bits[(self.values & U(_FILTER - 1)).astype(np.int64)] = True

    def hits(self, hashes: np.ndarray) -> np.ndarray:
        """Places whose hash is a value of some signature: by a table of bits first, then for certain."""
        maybe = np.flatnonzero(self.bits[(hashes & U(_FILTER - 1)).astype(np.int64)])
        if not len(self.values):
            return maybe
        at = np.minimum(np.searchsorted(self.values, hashes[maybe]), len(self.values) - 1)
        return maybe[self.values[at] == hashes[maybe]]

    def candidates(self, hashes: np.ndarray, hits: np.ndarray) -> np.ndarray:
        """Items that share a signature value with a window of the document. hits: places in hashes whose value is one of a signature:
        only windows around them can share one."""
        found = []
        for c, (values, owners) in self.by_class.items():
            size = 1 << c
            mine = hits[np.isin(hashes[hits], values)]
            last = max(0, -(-(len(hashes) - size) // size))
            windows = np.unique(np.concatenate([mine // size, mine // size - 1]))
            windows = windows[(windows >= 0) & (windows <= last)]
            for at in range(0, len(windows), max(1, (1 << 20) // size)):  # bounded memory for one long document
                _, value = window_signatures(hashes, windows[at : at + max(1, (1 << 20) // size)], size)
                low, high = np.searchsorted(values, value, "left"), np.searchsorted(values, value, "right")
                n = high - low
                places = np.repeat(low - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
                found.append(np.unique(owners[places]))
        return np.unique(np.concatenate(found)) if found else np.zeros(0, dtype=np.int64)

    def contained(self, hashes: np.ndarray, hits: np.ndarray, threshold: float) -> list[tuple[int, float]]:
        out = []
        candidates = self.candidates(hashes, hits)
        own = np.unique(hashes) if len(candidates) else hashes
        for i in candidates.tolist():
            item = self.shingles[i]
            at = np.minimum(np.searchsorted(own, item), len(own) - 1)
            share = float((own[at] == item).sum() / len(item))
            if share >= threshold:
                out.append((int(self.ids[i]), share))
        return out


    def short_items(self, hashes: np.ndarray, counts: np.ndarray) -> list[tuple[int, int]]:
        """(row, id) of the short items that rows of so many words hold; hashes: of all words in order."""
        out = set()
        for k, (values, owners) in self.short.items():
            every, n = runs(hashes, counts, k, SHINGLE)
            low, high = np.searchsorted(values, every, "left"), np.searchsorted(values, every, "right")
            hit = np.flatnonzero(high > low)
            row = np.searchsorted(np.cumsum(n), hit, "right")
            for r, a, b in zip(row.tolist(), low[hit].tolist(), high[hit].tolist(), strict=True):
                out.update((r, int(self.ids[i])) for i in owners[a:b])
        return sorted(out)


def _item_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in of_bytes(batches, "text", SLICE):
        w = words(text_of(batch))
        every, n = shingles(w.hashes, w.counts, SHINGLE)
        ends = np.cumsum(n)
        sets = [np.unique(every[e - k : e]) for e, k in zip(ends.tolist(), n.tolist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.minimum(w.counts, SHINGLE)), pa.array([x.view(np.int64) for x in sets], pa.list_(pa.int64()))], ["item_id", "n_words", "shingles"])


def blocks(items: DataFrame) -> tuple[int, Iterator[Block]]:
    """(number of blocks, the items in blocks). Items without a word are in none; nor are items with a null id or text.
    Rows that share an id are items of their own with that id; the same shingles under the same id count once."""
    rows = items.where(F.col("item_id").isNotNull()).select("item_id", "text").mapInArrow(_item_rows, "item_id long, n_words long, shingles array<long>").where(F.size("shingles") > 0).distinct()
    total = rows.agg(F.sum(F.size("shingles"))).first()[0] or 0
    n = -(-total // BLOCK)

    def each() -> Iterator[Block]:
        for b in range(n):
            mine = rows.where(F.pmod(F.xxhash64("item_id"), F.lit(n)) == b).orderBy("item_id", "shingles").toArrow()
            if mine.num_rows:
                yield Block.of(mine["item_id"].to_numpy(), mine["n_words"].to_numpy(), [np.array(x.values.to_numpy()).view(U) for x in mine["shingles"]])

    return n, each()


@dataclass
class Stored:
    """Blocks in the shared folder, of which one at a time is in memory."""

    files: Files
    n: int

    @classmethod
    def of(cls, files: Files, every: Iterable[Block]) -> Stored:
        n = 0
        for block in every:
            files.write(f"block-{n}", [pickle.dumps(block)])
            n += 1
        return cls(files, n)

    def __iter__(self) -> Iterator[Block]:
        return (pickle.loads(self.files.read(f"block-{i}")) for i in range(self.n))


def find(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """docs with found: array of (item_id, containment) of the items of whose distinct five-word shingles the text holds at least the threshold.

    One row for each row of docs, with all its columns (an own column found is replaced). An item of fewer than five words is found where all its words
    stand in a row, with containment 1. A null or empty text finds nothing; so does any text if there are no items. Words are what ASCII white space
    separates, A-Z as a-z. Items are sorted by id."""
    spark = docs.sparkSession
    plain = docs.drop("found")
    n, every = blocks(items)
    few = n <= BROADCAST
    held = spark.sparkContext.broadcast(list(every)) if few else Stored.of(Files(own_place(spark, "benchmark")), every)
    kind = pa.list_(pa.struct([("item_id", pa.int64()), ("containment", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in of_bytes(batches, "text", SLICE if few else LARGE_SLICE):
            w = words(text_of(batch))
            every, n = shingles(w.hashes, w.counts, SHINGLE, short=False)
            ends = np.cumsum(n)
            found: list[list[tuple[int, float]]] = [[] for _ in range(batch.num_rows)]
            for block in held.value if few else held:
                hits = block.hits(every)
                row = np.searchsorted(ends, hits, "right")
                for r in np.unique(row).tolist():
                    begin = int(ends[r] - n[r])
                    found[r] += block.contained(every[begin : int(ends[r])], hits[row == r] - begin, threshold)
                for r, i in block.short_items(w.hashes, w.counts):
                    found[r].append((i, 1.0))
            listed = pa.array([[{"item_id": i, "containment": c} for i, c in sorted(x)] for x in found], kind)
            yield pa.RecordBatch.from_arrays([*batch.columns, listed], [*batch.schema.names, "found"])

    return plain.mapInArrow(run, T.StructType([*plain.schema.fields, T.StructField("found", FOUND)]))


def report(docs: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, contaminated, item_ids (distinct, ascending), containment (the highest, 0 if none), one row for each row of docs."""
    found = find(docs.select("doc_id", "text"), items)
    ids = F.array_sort(F.array_distinct(F.transform("found", lambda x: x["item_id"])))
    return found.select("doc_id", (F.size("found") > 0).alias("contaminated"), ids.alias("item_ids"), F.coalesce(F.array_max(F.transform("found", lambda x: x["containment"])), F.lit(0.0)).alias("containment"))


def stage(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without those that hold an item (an own column found is kept)."""
    renamed = docs.withColumnsRenamed({"found": "__own_found"})
    return find(renamed, items).where(F.size("found") == 0).drop("found").withColumnsRenamed({"__own_found": "found"}).select(*docs.columns)


SQL = f"""
WITH items AS (SELECT item_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
item_sh AS (SELECT DISTINCT item_id, k, array_to_string(w[i : i + k - 1], ' ') AS s FROM (SELECT item_id, w, least({SHINGLE}, len(w)) AS k, unnest(range(1, len(w) - least({SHINGLE}, len(w)) + 2)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT item_id, count(*) AS n FROM item_sh GROUP BY item_id),
docs AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents WHERE text IS NOT NULL),
lengths AS (SELECT DISTINCT k FROM item_sh),
doc_sh AS (SELECT DISTINCT doc_id, k, array_to_string(w[i : i + k - 1], ' ') AS s FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM docs, lengths WHERE len(w) >= k)),
hits AS (SELECT d.doc_id, i.item_id, count(*) AS k FROM doc_sh d JOIN item_sh i ON d.k = i.k AND d.s = i.s GROUP BY d.doc_id, i.item_id),
found AS (SELECT h.doc_id, h.item_id, h.k / s.n AS c FROM hits h JOIN sizes s ON h.item_id = s.item_id WHERE h.k / s.n >= {THRESHOLD}),
lists AS (SELECT doc_id, list(item_id ORDER BY item_id) AS item_ids, max(c) AS containment FROM found GROUP BY doc_id)
SELECT d.doc_id, l.doc_id IS NOT NULL AS contaminated, coalesce(l.item_ids, []::BIGINT[]) AS item_ids, coalesce(l.containment, 0.0)::DOUBLE AS containment
FROM documents d LEFT JOIN lists l ON d.doc_id = l.doc_id
"""
