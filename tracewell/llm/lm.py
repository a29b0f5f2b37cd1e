"""Interpolated modified Kneser-Ney n-gram model: counted in Spark, kept as sorted hash arrays, memory-mapped by the workers that score.

Words and n-grams are 64-bit hashes. Each task counts its n-grams of the highest order and sends them, as arrays, to shards by the hash of their
context; n-grams whose context is all of frequent words are spread over all shards. A shard sums its n-grams, writes their sorted hashes and counts to the
shared folder, sends what it knows of contexts and of single words (tokens, followers, predecessors) on to be summed by a second
shuffle, and sends the n-grams without their first word, with the number of first words, to the shards of the next lower order. The
number of shards follows the number of tokens, and is the number of shuffle partitions at least, so a shard holds a bounded part however large the
corpus. A shard is two files. Scoring workers map them, a bounded number at a time, and look the distinct words and n-grams of a slice of texts up at once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import Files, cut, held_out, of_bytes, own_place, text_of
from .words import U, mix, signed, words

#: Words of the longest n-grams.
ORDER = 2
#: Tokens of a shard, n-grams that a task gathers before it sends their counts, tokens from which a word is frequent, and how many words can be: more tokens are asked for then.
SHARD, GATHER, FREQUENT, MOST_FREQUENT = 2_000_000, 2_000_000, 250_000, 1_000_000
#: Bytes of text scored at once, up to the second figure where a model has more files than may be open.
SLICE, LARGE_SLICE = 2 << 20, 16 << 20
START, END = U(0x243F6A8885A308D3), U(0x13198A2E03707344)
#: What is known of a word: tokens, and kinds of words before it; and of a context: tokens after it, and kinds of words after it once, twice, more often.
COLUMNS = ("tokens", "before", "after", "once", "twice", "more")
#: What goes from task to task: n-grams (kind 1; cols are their words and counts) or what is known of words and contexts (kind 0; cols are keys and COLUMNS),
#: and how many n-grams were seen once to four times.
ROWS = "kind int, shard int, cols array<array<long>>, seen array<long>"


def gram_hash(columns: list[np.ndarray]) -> np.ndarray:
    """Of n-grams, from their words' hashes, one array a place; a single word keeps its own."""
    return reduce(lambda h, w: mix(h * U(0xA24BAED4963EE407) + w), columns)


def _sums(keys: list[np.ndarray], *columns: list[np.ndarray]) -> tuple[np.ndarray, ...]:
    """Distinct keys, sorted, with the sums of each column."""
    every = np.concatenate([np.zeros(0, U), *keys])
    order = np.argsort(every, kind="stable")
    every = every[order]
    first = np.flatnonzero(np.concatenate([[True], every[1:] != every[:-1]])[: len(every)])
    add = lambda x: np.add.reduceat(np.concatenate([np.zeros(0, np.int64), *x])[order], first) if len(first) else np.zeros(0, np.int64)
    return every[first], *(add(c) for c in columns)


def _by_shard(shard: np.ndarray, n: int, columns: list[np.ndarray]) -> Iterator[tuple[int, list[np.ndarray]]]:
    order = np.argsort(shard, kind="stable")
    ends = np.searchsorted(shard[order], np.arange(n + 1), "left")
    for s in np.flatnonzero(np.diff(ends)).tolist():
        at = order[ends[s] : ends[s + 1]]
        yield s, [c[at] for c in columns]


def _texts_as_grams(batch: pa.RecordBatch, order: int) -> tuple[list[np.ndarray], np.ndarray]:
    """(n-grams of all tokens of all rows in order, one array a place, the token last; tokens of each row): its words and one end, before which stand order - 1 starts."""
    w = words(text_of(batch))
    token = np.insert(w.hashes, np.cumsum(w.counts), END)
    n = w.counts + 1
    at = np.arange(len(token))
    place = at - np.repeat(np.cumsum(n) - n, n)
    return [np.where(place >= back, token[np.maximum(at - back, 0)], START) for back in range(order - 1, 0, -1)] + [token], n


def _token_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    keys, counts, size = [], [], 0

    def flush() -> pa.RecordBatch:
        k, c = _sums(keys, counts)
        return pa.RecordBatch.from_arrays([signed(k), pa.array(c)], ["word", "tokens"])

    for batch in of_bytes(batches, "text", SLICE):
        (token,), _ = _texts_as_grams(batch, 1)
        k, c = np.unique(token, return_counts=True)
        keys.append(k)
        counts.append(c)
        size += len(k)
        if size > GATHER:
            k, c = _sums(keys, counts)
            keys, counts, size = [k], [c], len(k)
            if size > GATHER // 2:
                yield flush()
                keys, counts, size = [], [], 0
    if keys:
        yield flush()


def discounts(n: list[int]) -> tuple[float, float, float]:
    """Chen and Goodman's three discounts from the numbers of n-grams seen once to four times; 0.75 where they leave one undefined."""
    n1, n2, n3, n4 = (float(x) for x in n)
    y = n1 / (n1 + 2 * n2) if n1 else 0.0
    found = [k - (k + 1) * y * b / a if a and b and y else 0.75 for k, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
    return tuple(x if 0 < x < k else 0.75 for k, x in enumerate(found, 1))


def _write(files: Files, name: str, *arrays: np.ndarray) -> None:
    """Arrays of one file: their number, then of each its dtype and shape, then their values, each at a multiple of eight bytes."""
    heads = [np.frombuffer(a.dtype.str.encode().ljust(8), dtype=np.int64).tolist() + [a.shape[0] if a.ndim > 1 else 1, a.shape[-1]] for a in arrays]
    parts = [np.array([len(arrays), *sum(heads, [])], dtype=np.int64).tobytes()]
    for a in arrays:
        parts += [np.ascontiguousarray(a).tobytes(), bytes(-a.nbytes % 8)]
    files.write(name, parts)


def _read(files: Files, name: str) -> list[np.ndarray]:
    data = files.read(name)
    if data is None:
        raise FileNotFoundError(f"{files.uri}/{name}: a shard that was written is not there")
    number = int(np.frombuffer(data, np.int64, 1)[0])
    heads = np.frombuffer(data, np.int64, 3 * number, 8).reshape(-1, 3)
    at, out = 8 + 24 * number, []
    for kind, rows, columns in heads.tolist():
        dtype = np.dtype(np.array([kind], dtype=np.int64).tobytes().decode().strip())
        array = np.frombuffer(data, dtype, rows * columns, at)
        out.append(array.reshape(rows, columns) if rows != 1 else array)
        at += array.nbytes + -array.nbytes % 8
    return out


def _places(held: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, whether it is the key's) of each of the keys in a sorted array that is not empty."""
    place = np.minimum(np.searchsorted(held, keys), len(held) - 1)
    return place, held[place] == keys


@dataclass
class Model:
    files: Files
    order: int
    shards: int
    frequent: np.ndarray  # sorted hashes
    train_tokens: int
    vocabulary: int
    pairs: int  # distinct pairs
    discounts: dict[int, tuple[float, float, float]]  # of n-grams of two words and more
    word_discounts: tuple[float, float, float]
    word_mass: float  # of the discounts, for the uniform distribution
    written: frozenset[str]  # names of all files; a shard without n-grams has none

    def known(self, keys: np.ndarray) -> np.ndarray:
        """COLUMNS of each of the words or contexts; zeros for those that the training texts do not have."""
        out = np.zeros((len(COLUMNS), len(keys)), dtype=np.int64)
        for s, (at,) in _by_shard((mix(keys) % U(self.shards)).astype(np.int64), self.shards, [np.arange(len(keys))]):
            held = _read(self.files, f"known-{s}") if f"known-{s}" in self.written else None
            if held is not None and len(held[0]):
                place, hit = _places(held[0], keys[at])
                out[:, at[hit]] = held[1].reshape(len(COLUMNS), -1)[:, place[hit]]
        return out

    def counts(self, columns: list[np.ndarray]) -> np.ndarray:
        """How often each of the n-grams counts: in the highest order its occurrences, in lower ones the kinds of words before it."""
        out = np.zeros(len(columns[0]), dtype=np.int64)
        key = gram_hash(columns)
        for s, (at,) in _by_shard(_shard(columns, self.frequent, self.shards), self.shards, [np.arange(len(key))]):
            name = f"grams{len(columns)}-{s}"
            held = _read(self.files, name) if name in self.written else None
            if held is not None and len(held[0]):
                place, hit = _places(held[0], key[at])
                count = held[1][place[hit]].astype(np.int64)
                many = np.flatnonzero(count == 255)
                if len(many):
                    count[many] = held[3][np.searchsorted(held[2], key[at[hit]][many])]
                out[at[hit]] = count
        return out

    def word_probability(self, before: np.ndarray) -> np.ndarray:
        """From the kinds of words before it."""
        uniform = self.word_mass / (self.vocabulary + 1)
        return np.maximum(before - _discount(before, self.word_discounts), 0.0) / max(self.pairs, 1) + uniform

    def scores(self, columns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(log10 probability, log10 base probability, known) of each token, the last of its n-gram."""
        keys, which = np.unique(columns[-1], return_inverse=True)
        known = self.known(keys)
        p = self.word_probability(known[1].astype(np.float64))[which]
        for k in range(2, self.order + 1):
            mine = columns[-k:]
            _, first, back = np.unique(gram_hash(mine), return_index=True, return_inverse=True)
            mine = [c[first] for c in mine]
            count, lower = self.counts(mine), p[first]
            contexts, of = np.unique(gram_hash(mine[:-1]), return_inverse=True)
            _, _, after, once, twice, more = self.known(contexts)
            d1, d2, d3 = self.discounts[k]
            seen = np.maximum(after, 1)
            mass = (d1 * once + d2 * twice + d3 * more) / seen
            p = np.where(after[of] > 0, np.maximum(count - _discount(count, self.discounts[k]), 0.0) / seen[of] + mass[of] * lower, lower)[back]
        base = np.log10((known[0] + 0.1) / (self.train_tokens + 0.1 * (self.vocabulary + 1)))
        return np.log10(p), base[which], (known[0] > 0)[which]


def _discount(count: np.ndarray, d: tuple[float, float, float]) -> np.ndarray:
    return np.array([0.0, *d])[np.minimum(count, 3).astype(np.int64)]


def _shard(columns: list[np.ndarray], frequent: np.ndarray, shards: int) -> np.ndarray:
    """By the context, or by the whole n-gram where all words of the context are frequent."""
    spread = np.ones(len(columns[0]), dtype=bool)
    for c in columns[:-1]:
        spread &= _places(frequent, c)[1]
    return (mix(np.where(spread, gram_hash(columns), gram_hash(columns[:-1]))) % U(shards)).astype(np.int64)


def _rows(kind: int, shard: np.ndarray, shards: int, columns: list[np.ndarray], seen: list[int] | None = None) -> pa.Table:
    """A row for each shard with its part of the columns; the first row tells what was seen."""
    dealt = list(_by_shard(shard, shards, columns))
    if not dealt and seen:
        dealt = [(0, [c[:0] for c in columns])]
    parts = [p.view(np.int64) for _, row in dealt for p in row]
    ends = np.concatenate([[0], np.cumsum([len(p) for p in parts])]).astype(np.int32)
    inner = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([np.zeros(0, np.int64), *parts])))
    outer = pa.ListArray.from_arrays(pa.array(np.arange(0, len(parts) + 1, len(columns), dtype=np.int32)), inner)
    return pa.Table.from_arrays([pa.array(np.full(len(dealt), kind, np.int32)), pa.array([s for s, _ in dealt], pa.int32()), outer, pa.array([seen if i == 0 else None for i in range(len(dealt))], pa.list_(pa.int64()))], ["kind", "shard", "cols", "seen"])


def _columns(group: pa.Table) -> list[np.ndarray]:
    """The columns of all rows of a group, one row after the other."""
    rows = [[np.asarray(c.values) for c in row] for batch in group.column("cols").chunks for row in batch]
    return [np.concatenate([np.zeros(0, np.int64), *c]) for c in zip(*rows, strict=True)]


def fit(texts: DataFrame, order: int = ORDER) -> Model:
    """A model of the rows of texts (null: empty). Each row is a document that counts as often as it occurs."""
    spark = texts.sparkSession
    files = Files(own_place(spark, "lm"))
    counts = cut(texts.select("text").mapInArrow(_token_rows, "word long, tokens long").groupBy("word").agg(F.sum("tokens").alias("tokens")), "words")
    tokens = counts.agg(F.sum("tokens")).first()[0] or 0
    least = max(FREQUENT, tokens // MOST_FREQUENT)
    frequent_rows = counts.where(F.col("tokens") > least).select("word").toArrow()  # MOST_FREQUENT at most, which is 8 MB
    frequent = np.sort(np.array([*frequent_rows["word"].to_numpy(), START.astype(np.int64)]).view(U))
    shards = max(1, math.ceil(tokens / SHARD), int(spark.conf.get("spark.sql.shuffle.partitions")))

    def gram_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0

        def flush() -> Iterator[pa.RecordBatch]:
            columns = [np.concatenate(c) for c in zip(*held, strict=True)]
            _, first, count = np.unique(gram_hash(columns), return_index=True, return_counts=True)
            columns = [c[first] for c in columns]
            yield from _rows(1, _shard(columns, frequent, shards), shards, [*columns, count]).to_batches()

        for batch in of_bytes(batches, "text", SLICE):
            columns, _ = _texts_as_grams(batch, order)
            held.append(columns)
            n += len(columns[0])
            if n > GATHER:
                yield from flush()
                held, n = [], 0
        if n:
            yield from flush()

    def known_rows(keys: np.ndarray, columns: list[np.ndarray], seen: list[int] | None) -> pa.Table:
        return _rows(0, (mix(keys) % U(shards)).astype(np.int64), shards, [keys, *columns], seen)

    def sum_grams(k: int):
        def run(group: pa.Table) -> pa.Table:
            shard = group["shard"][0].as_py()
            *columns, n = _columns(group)
            columns = [c.view(U) for c in columns]
            context, key = gram_hash(columns[:-1]), gram_hash(columns)
            order = np.lexsort((key, context))
            new = order[np.concatenate([[True], key[order][1:] != key[order][:-1]])]
            n = np.add.reduceat(n[order], np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]])))
            columns, context, key = [c[new] for c in columns], context[new], key[new]
            by_key = np.argsort(key)
            many = by_key[n[by_key] >= 255]
            _write(files, f"grams{k}-{shard}", key[by_key], np.minimum(n[by_key], 255).astype(np.uint8), key[many], n[many])
            one = np.ones(len(n), dtype=np.int64)
            begin = np.flatnonzero(np.concatenate([[True], context[1:] != context[:-1]]))
            of_context = [np.add.reduceat(x, begin) for x in (n, (n == 1) * one, (n == 2) * one, (n > 2) * one)]
            zero = np.zeros(len(begin), dtype=np.int64)
            seen = [k, *(int((n == i).sum()) for i in (1, 2, 3, 4)), shard]
            if k == 2:
                followers, before = _sums([columns[1]], [one])
                none = np.zeros(len(followers), dtype=np.int64)
                keys, *known = _sums([context[begin], followers], [zero, none], [zero, before], *([x, none] for x in of_context))
                return known_rows(keys, known, seen)
            _, first, kinds = np.unique(gram_hash(columns[1:]), return_index=True, return_counts=True)
            shorter = [c[first] for c in columns[1:]]
            return pa.concat_tables([known_rows(context[begin], [zero, zero, *of_context], seen), _rows(1, _shard(shorter, frequent, shards), shards, [*shorter, kinds])])

        return run

    def token_lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = batch.column(0).to_numpy().view(U)
            zero = np.zeros(len(keys), dtype=np.int64)
            yield from known_rows(keys, [batch.column(1).to_numpy(), *[zero] * 5], None).to_batches()

    levels = range(2, order + 1)
    names = ["tokens", "words", "pairs", *(f"w{i}" for i in (1, 2, 3, 4, 5)), *(f"n{k}_{i}" for k in levels for i in (1, 2, 3, 4))]

    def sum_known(group: pa.Table) -> pa.Table:
        shard = group["shard"][0].as_py()
        keys, *columns = _columns(group)
        keys, *columns = _sums([keys.view(U)], *([c] for c in columns))
        table = np.stack(columns)
        _write(files, f"known-{shard}", keys, (table.astype(np.uint32) if table.max(initial=0) < 1 << 32 else table).ravel())
        seen = [x for x in group["seen"].to_pylist() if x]
        row = {"tokens": int(table[0].sum()), "words": int((table[0] > 0).sum()), "pairs": int(table[1].sum())}
        row |= {f"w{i}": int((table[1] == i).sum()) for i in (1, 2, 3, 4)} | {"w5": int((table[1] > 2).sum())}
        row |= {f"n{k}_{i}": sum(x[i] for x in seen if x[0] == k) for k in levels for i in (1, 2, 3, 4)}
        row["written"] = [f"known-{shard}", *(f"grams{x[0]}-{x[5]}" for x in seen)]
        return pa.Table.from_pylist([row])

    level = texts.select("text").mapInArrow(gram_rows, ROWS)
    known = counts.mapInArrow(token_lists, ROWS)
    for k in reversed(levels):
        level = level.where("kind = 1").groupBy("shard").applyInArrow(sum_grams(k), ROWS)
        if k > 2:
            level = cut(level, "grams")
        known = known.unionByName(level.where("kind = 0"))
    whole = known.groupBy("shard").applyInArrow(sum_known, ", ".join([*(f"{c} long" for c in names), "written array<string>"])).agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names), F.flatten(F.collect_list("written")).alias("written")).first()
    word_discounts = discounts([whole[f"w{i}"] for i in (1, 2, 3, 4)])
    mass = word_discounts[0] * whole["w1"] + word_discounts[1] * whole["w2"] + word_discounts[2] * whole["w5"]
    by_order = {k: discounts([whole[f"n{k}_{i}"] for i in (1, 2, 3, 4)]) for k in levels}
    return Model(files, order, shards, frequent, whole["tokens"], whole["words"], whole["pairs"], by_order, word_discounts, mass / whole["pairs"] if whole["pairs"] else 1.0, frozenset(whole["written"]))


def score(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, n_tokens, n_known, base_score, score, one row for each row of docs. A null or empty text is one end token."""
    size = min(LARGE_SLICE, SLICE * max(1, model.order * model.shards // model.files.most))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in of_bytes(batches, "text", size):
            columns, n = _texts_as_grams(batch, model.order)
            log, base, known = model.scores(columns)
            begin = np.cumsum(n) - n
            add = lambda x: np.add.reduceat(x, begin) if len(begin) else x
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(add(known.astype(np.int64))), pa.array(add(base)), pa.array(add(log))], ["doc_id", "n_tokens", "n_known", "base_score", "score"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, n_known long, base_score double, score double")


def perplexities(docs: DataFrame, order: int = ORDER) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score and perplexity, one row for each row of docs.

    The model learns from the documents that are not held out; a null doc_id is not held out. Repeated rows count and are scored as often as
    they occur. If no document is left to learn from, every word is unknown. Columns beyond doc_id and text are not read."""
    model = fit(docs.where(~held_out(F.col("doc_id"), 10, 0)), order)
    scored = score(docs, model)
    return scored.select("doc_id", held_out(F.col("doc_id"), 10, 0).alias("held_out"), "n_tokens", "n_known", F.lit(model.train_tokens).cast("long").alias("train_tokens"), "base_score", "score", F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))
