"""Packing documents into sequences of a fixed number of tokens by best-fit decreasing.

Ids come from a public tokenizer, an end id follows each document. A document longer than a sequence is first cut into full
sequences; what is left of each document, at most one sequence long, is packed longest first into the open sequence with the
least room that still holds it, which a segment tree over remaining room finds. Pieces are dealt out evenly to packing
groups of a bounded number of tokens, whose number follows the corpus, and each group is packed by itself.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, of_bytes, text_of
from .words import words

SEQUENCE, END = 4096, 2
VOCABULARY = "word_bpe_49k.json"
#: Tokens of the pieces that one group packs, about.
GROUP_TOKENS = 1 << 20
#: Words whose ids a worker remembers, and text that it takes at a time.
REMEMBERED, SLICE = 400_000, 1 << 20


class Encoder:
    """Ids of texts by a tokenizer that ignores case and splits at white space and between letters or digits and what else there is: words are
    encoded once, a full stop or comma at their end apart, and remembered."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.forget()

    def forget(self) -> None:
        self.place: dict[int, int] = {}
        self.ids, self.begins = np.zeros(0, dtype=np.uint32), np.zeros(1, dtype=np.int64)

    def learn(self, keys: list[int], texts: list[str]) -> None:
        ids, sizes = [], []
        for at in range(0, len(texts), 512):
            some = texts[at : at + 512]
            encoded = self.tokenizer.encode(" ".join(some), add_special_tokens=False)
            ends = np.cumsum([len(x) + 1 for x in some])
            begins = np.array([a for a, _ in encoded.offsets], dtype=np.int64)
            sizes.append(np.bincount(np.searchsorted(ends, begins, "right"), minlength=len(some)))
            ids.append(np.array(encoded.ids, dtype=np.uint32))
        known = len(self.place)
        self.place.update(zip(keys, range(known, known + len(keys)), strict=True))
        self.ids = np.concatenate([self.ids, *ids])
        self.begins = np.concatenate([self.begins, self.begins[-1] + np.cumsum(np.concatenate(sizes))])

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all rows, ids of each row)."""
        w = words(texts, tails=True)
        keys, first, which = np.unique(w.hashes, return_index=True, return_inverse=True)
        if len(self.place) > REMEMBERED:
            self.forget()
        listed = keys.tolist()
        new = [i for i, k in enumerate(listed) if k not in self.place]
        if new:
            data = w.data.tobytes()
            at = first[new]
            self.learn([listed[i] for i in new], [data[a:b].decode() for a, b in zip(w.starts[at].tolist(), w.ends[at].tolist(), strict=True)])
        place = np.fromiter((self.place[k] for k in listed), dtype=np.int64, count=len(listed))[which]
        begin, size = self.begins[place], self.begins[place + 1] - self.begins[place]
        places = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        ends = np.concatenate([[0], np.cumsum(size)])[np.concatenate([[0], np.cumsum(w.counts)])]
        return self.ids[places], np.diff(ends)


@cache
def encoder(path: str) -> Encoder:
    """One for each worker, which keeps what it has learnt from task to task."""
    return Encoder(path)


def pieces(docs: DataFrame, vocabulary: str, sequence: int = SEQUENCE, end: int = END, with_ids: bool = False) -> DataFrame:
    """doc_id, start, length, ids_crc32, doc_tokens (and ids): each document cut into full sequences and a rest. A null text is an empty one, whose only id is the end."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = encoder(vocabulary)
        for batch in of_bytes(batches, "text", SLICE):
            ids, sizes = coder.encode(text_of(batch))
            ends = np.cumsum(sizes)
            ids = np.insert(ids, ends, np.uint32(end)).astype("<u4")
            sizes = sizes + 1
            n = -(-sizes // sequence)
            row = np.repeat(np.arange(len(sizes)), n)
            start = (np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)) * sequence
            length = np.minimum(sequence, sizes[row] - start)
            begin = (np.cumsum(sizes) - sizes)[row] + start
            crc = [zlib.crc32(ids[b : b + k].tobytes()) for b, k in zip(begin.tolist(), length.tolist(), strict=True)]
            columns = [batch.column(0).take(pa.array(row)), pa.array(start), pa.array(length), pa.array(crc, pa.int64()), pa.array(sizes[row])]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens"]
            if with_ids:  # pieces follow each other, so their ids are the batch's
                columns.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(length)]).astype(np.int32)), pa.array(ids.astype(np.int32))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(columns, names)

    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long" + ", ids array<int>" * with_ids
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, schema)


class Room:
    """Open sequences by remaining room: a segment tree over room 0..capacity that finds the least room of at least so much."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.count = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(self.leaves)]

    def _add(self, room: int, n: int) -> None:
        at = self.leaves + room
        while at:
            self.count[at] += n
            at >>= 1

    def put(self, room: int, sequence: int) -> None:
        self.open[room].append(sequence)
        self._add(room, 1)

    def take(self, least: int) -> tuple[int, int] | None:
        """(room, sequence) with the least room that is at least `least`, removed; None if there is none."""
        at = self.leaves + least
        if not self.count[at]:
            while at > 1 and (at & 1 or not self.count[at + 1]):
                at >>= 1
            if at <= 1:
                return None
            at += 1
            while at < self.leaves:
                at = 2 * at if self.count[2 * at] else 2 * at + 1
        room = at - self.leaves
        self._add(room, -1)
        return room, self.open[room].pop()


def best_fit_decreasing(lengths: list[int], capacity: int) -> tuple[list[int], list[int]]:
    """(sequence, offset) of each piece; the lengths fall."""
    room, where, offset, n = Room(capacity), [], [], 0
    for length in lengths:
        found = room.take(length)
        left, sequence = found or (capacity, n)
        n += found is None
        where.append(sequence)
        offset.append(capacity - left)
        if left > length:
            room.put(left - length, sequence)
    return where, offset


def pack(docs: DataFrame, vocabulary: str, sequence: int = SEQUENCE, end: int = END, with_ids: bool = False) -> DataFrame:
    """pieces with sequence_id and offset: every id is in one piece, and pieces of a sequence follow each other from 0 without gaps.

    Every row of docs is packed, repeated rows and rows with a null doc_id as documents of their own. An empty table has no pieces.
    Columns beyond doc_id and text are not read. With ids the pieces' ids go along."""
    cut_up = cut(pieces(docs, vocabulary, sequence, end, with_ids).withColumn("__piece", F.monotonically_increasing_id()), "pieces")
    full = cut_up.where(F.col("length") == sequence).withColumn("sequence_id", -1 - F.col("__piece")).withColumn("offset", F.lit(0).cast("long"))
    rest = cut_up.where(F.col("length") < sequence)
    total = rest.agg(F.sum("length")).first()[0] or 0
    groups = max(1, round(total / GROUP_TOKENS))

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["length", "__piece"], ascending=[False, True])
        where, offset = best_fit_decreasing(pdf["length"].tolist(), sequence)
        return pd.DataFrame({"__piece": pdf["__piece"], "sequence_id": pdf["group"].astype("int64") * 2**32 + np.array(where, dtype=np.int64), "offset": np.array(offset, dtype=np.int64)})

    # A group has about GROUP_TOKENS tokens however the documents are keyed: pieces are numbered without gaps of note and dealt by a hash of the number.
    dealt = rest.select("__piece", "length", F.pmod(F.xxhash64("__piece"), F.lit(groups)).cast("int").alias("group"))
    packed = dealt.groupBy("group").applyInPandas(one, "__piece long, sequence_id long, offset long")
    return rest.join(packed, "__piece").unionByName(full).drop("__piece")


def sequences(packed: DataFrame, sequence: int = SEQUENCE) -> DataFrame:
    """sequence_id, n_pieces, n_tokens, padding: a sequence is padded to its full length, except at a power of two."""
    filled = packed.groupBy("sequence_id").agg(F.count(F.lit(1)).alias("n_pieces"), F.sum("length").alias("n_tokens"))
    exact = F.expr("n_tokens & (n_tokens - 1)") == 0
    return filled.withColumn("padding", F.when(exact, 0).otherwise(sequence - F.col("n_tokens")).cast("long"))
