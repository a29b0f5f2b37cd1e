"""Token counts by dynamic programming over a trie of words.

The pieces are those of a public vocabulary, which has no probabilities of them. Those are estimated from the corpus: words are
counted in Spark, each round segments every distinct word by the costs so far and counts the pieces of the cheapest
segmentations, weighted by the words' counts, and the counts give the next costs. The cheapest segmentation of a word
then gives its number of tokens.

The distinct words of a batch are sorted into a trie; the forward cost of a prefix is computed once for all words that share
it, a level of the trie at a time for all nodes at once, and a word's count is stored where it ends. In estimation, weights go
back over the same trie, so a shared prefix is also walked back once. Counts of words are remembered, up to a bound, from batch
to batch.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import cut, of_bytes, text_of
from .words import U, mix, powers, words

VOCABULARY = "piece_bpe_32k.model"
#: What stands for the white space before a word, at its start.
MARK = "▁"
#: Costs are natural logarithms in units of 1 / 65536; times 4096 plus 1 a token, so that of equally likely segmentations the shortest wins.
UNIT, TIE = 65536, 4096
#: Rounds of estimation, and what each piece counts at least.
ROUNDS, LEAST = 3, 0.5
REMEMBERED, SLICE = 500_000, 1 << 20
#: Characters from which a word is segmented by itself: so long a word shares little, and a trie's level would be for it alone.
LONG = 256
#: Words of a trie in estimation, and distinct words that a task gathers before it sends their counts.
TRIE, GATHER = 50_000, 1_000_000
_BASE = U(0xDA942042E4DD58B5)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), dtype=np.uint32)


class Model:
    """Pieces with costs. Byte pieces are not in the list: a character that no piece covers costs `byte_cost` and one token for each of its bytes."""

    def __init__(self, pieces: list[str], counts: np.ndarray | None = None):
        """counts: of each piece in segmented text; without any, all pieces are equally likely."""
        weights = np.full(len(pieces), LEAST) if counts is None else counts + LEAST
        logs = np.log(weights / weights.sum())
        costs = np.round(-logs * UNIT).astype(np.int64) * TIE + 1
        self.pieces = pieces
        self.byte_cost = int(np.round((-logs.min() + 5) * UNIT)) * TIE + 1 if pieces else TIE + 1
        self.by_length: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        lengths = np.array([len(p) for p in pieces], dtype=np.int64)
        for n in np.unique(lengths).tolist():
            mine = np.flatnonzero(lengths == n)
            codes = np.stack([_codes(pieces[i]) for i in mine])
            keys = np.zeros(len(mine), dtype=U)
            for j in range(n):
                keys = keys * _BASE + mix(codes[:, j].astype(U) + U(1))
            order = np.argsort(keys, kind="stable")
            self.by_length[n] = (keys[order], costs[mine][order], mine[order])
        self.cost = dict(zip(pieces, costs.tolist(), strict=True))
        self.number = {p: i for i, p in enumerate(pieces)}

    @classmethod
    def of(cls, path: str, counts: np.ndarray | None = None) -> Model:
        from sentencepiece import SentencePieceProcessor

        p = SentencePieceProcessor(model_file=path)
        return cls([p.id_to_piece(i) for i in range(p.vocab_size()) if not (p.is_control(i) or p.is_unknown(i) or p.is_byte(i) or p.is_unused(i))], counts)

    def counts(self, texts: list[str]) -> np.ndarray:
        """Tokens of each of the texts, which are distinct and need no order."""
        out = np.zeros(len(texts), dtype=np.int64)
        long = np.array([len(x) >= LONG for x in texts], dtype=bool)
        for i in np.flatnonzero(long).tolist():
            out[i] = self._alone(texts[i])[0]
        short = np.flatnonzero(~long)
        out[short] = self._forward([texts[i] for i in short.tolist()], None)[0]
        return out

    def _alone(self, text: str) -> tuple[int, dict[str, int]]:
        """(tokens, counts of the pieces) of one word's cheapest segmentation."""
        longest = max(self.by_length, default=1)
        costs, tokens, last = [0], [0], [0]
        for j in range(1, len(text) + 1):
            width = len(text[j - 1].encode())
            cost, count, length = costs[j - 1] + width * self.byte_cost, tokens[j - 1] + width, 0
            for n in range(1, min(longest, j) + 1):
                price = self.cost.get(text[j - n : j])
                if price is not None and costs[j - n] + price < cost:
                    cost, count, length = costs[j - n] + price, tokens[j - n] + 1, n
            costs.append(cost)
            tokens.append(count)
            last.append(length)
        pieces: dict[str, int] = {}
        j = len(text)
        while j:
            if last[j]:
                piece = text[j - last[j] : j]
                pieces[piece] = pieces.get(piece, 0) + 1
            j -= last[j] or 1
        return tokens[-1], pieces

    def piece_counts(self, texts: list[str], weights: np.ndarray) -> np.ndarray:
        """How often each piece stands in the cheapest segmentations of the texts, each counted by its weight."""
        out = np.zeros(len(self.pieces), dtype=np.int64)
        long = np.array([len(x) >= LONG for x in texts], dtype=bool)
        for i in np.flatnonzero(long).tolist():
            for piece, n in self._alone(texts[i])[1].items():
                out[self.number[piece]] += n * int(weights[i])
        texts, weights = [x for x, far in zip(texts, long.tolist(), strict=True) if not far], weights[~long]
        _, parents, pieces, lengths, ends = self._forward(texts, weights)
        # From the deepest level up: what a node carries goes to its last piece and on to the node before that piece. A node without a last piece ends in bytes.
        for depth in range(len(parents) - 1, 0, -1):
            carried, piece, n = ends[depth], pieces[depth], lengths[depth]
            np.add.at(out, piece[piece >= 0], carried[piece >= 0])
            above = np.arange(len(carried))
            for step in range(1, int(n.max(initial=0)) + 1):
                above = parents[depth - step + 1][above]
                here = n == step
                np.add.at(ends[depth - step], above[here], carried[here])
        return out

    def _forward(self, texts: list[str], weights: np.ndarray | None):
        """(tokens of each text) and, if the texts have weights, of each level of the trie: parents' places, last pieces, their lengths, and weights of the texts that end there."""
        order = sorted(range(len(texts)), key=texts.__getitem__)
        flat = [_codes(texts[i]) for i in order]
        order = np.array(order, dtype=np.int64)
        sizes = np.array([len(x) for x in flat], dtype=np.int64)
        codes = np.concatenate(flat) if flat else np.zeros(0, np.uint32)
        begins = np.cumsum(sizes) - sizes
        out = np.zeros(len(texts), dtype=np.int64)
        alive = np.arange(len(flat))
        node = np.zeros(len(flat), dtype=np.int64)  # of each word that goes on
        # levels of the trie, the last ones first: parents' places, prefix hashes, costs, tokens
        parents, hashes, costs, tokens = [np.zeros(1, np.int64)], [np.zeros(1, U)], [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
        pieces, lengths, ends = [np.full(1, -1)], [np.zeros(1, np.int64)], [np.zeros(1, np.int64)]
        longest = max(self.by_length, default=1)
        depth = 0
        while len(alive):
            code = codes[begins[alive] + depth]
            new = np.ones(len(alive), dtype=bool)
            new[1:] = (node[1:] != node[:-1]) | (code[1:] != code[:-1])
            at = np.cumsum(new) - 1
            parent, letter = node[new], code[new]
            depth += 1
            value = hashes[-1][parent] * _BASE + mix(letter.astype(U) + U(1))
            width = 1 + (letter > 0x7F).astype(np.int64) + (letter > 0x7FF) + (letter > 0xFFFF)
            cost, count = costs[-1][parent] + width * self.byte_cost, tokens[-1][parent] + width
            piece, length = np.full(len(parent), -1), np.ones(len(parent), dtype=np.int64)
            above = parent
            for n in range(1, min(longest, depth) + 1):
                if n > 1:
                    above = parents[-n + 1][above]
                if n in self.by_length:
                    keys, prices, numbers = self.by_length[n]
                    key = value - hashes[-n][above] * powers(_BASE, n + 1)[n]
                    found = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
                    hit = np.flatnonzero(keys[found] == key)
                    total = costs[-n][above[hit]] + prices[found[hit]]
                    better = total < cost[hit]
                    hit, total = hit[better], total[better]
                    cost[hit], count[hit] = total, tokens[-n][above[hit]] + 1
                    piece[hit], length[hit] = numbers[found[hit]], n
            for level, x in ((parents, parent), (hashes, value), (costs, cost), (tokens, count)):
                level.append(x)
                if weights is None or level is not parents:
                    del level[:-longest]
            ended = sizes[alive] == depth
            out[order[alive[ended]]] = count[at[ended]]
            if weights is not None:
                pieces.append(piece)
                lengths.append(length)
                ends.append(np.bincount(at[ended], weights[order[alive[ended]]], len(parent)).astype(np.int64))
            alive, node = alive[~ended], at[~ended]
        return out, parents, pieces, lengths, ends


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n: the distinct words of all texts with MARK before them. Tasks count before they send, so a frequent word is a row a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, list] = {}

        def flush() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([x for x, _ in known.values()], pa.string()), pa.array([n for _, n in known.values()], pa.int64())], ["word", "n"])

        for batch in of_bytes(batches, "text", SLICE):
            w = words(text_of(batch), fold=False)
            keys, first, n = np.unique(w.hashes, return_index=True, return_counts=True)
            data = None
            for k, i, c in zip(keys.tolist(), first.tolist(), n.tolist(), strict=True):
                if k in known:
                    known[k][1] += c
                else:
                    data = data or w.data.tobytes()
                    known[k] = [MARK + data[w.starts[i] : w.ends[i]].decode(), c]
            if len(known) > GATHER:
                yield flush()
                known.clear()
        if known:
            yield flush()

    return docs.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def estimated(docs: DataFrame, vocabulary: str, rounds: int = ROUNDS) -> np.ndarray:
    """Counts of the vocabulary's pieces in the cheapest segmentations of all words of docs, after so many rounds. What comes to the driver is a number a piece."""
    counted = cut(word_counts(docs), "words")
    counts = None
    for _ in range(rounds):

        def run(batches: Iterator[pa.RecordBatch], counts=counts) -> Iterator[pa.RecordBatch]:
            model = Model.of(vocabulary, counts)
            total = np.zeros(len(model.pieces), dtype=np.int64)
            for batch in batches:
                for at in range(0, batch.num_rows, TRIE):
                    some = batch.slice(at, TRIE)
                    total += model.piece_counts(some.column(0).to_pylist(), some.column(1).to_numpy())
            used = np.flatnonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array(total[used])], ["piece", "n"])

        found = counted.mapInArrow(run, "piece int, n long").groupBy("piece").agg(F.sum("n").alias("n")).toArrow()
        counts = np.zeros(len(Model.of(vocabulary).pieces), dtype=np.int64)
        counts[found["piece"].to_numpy()] = found["n"].to_numpy()
    return counts


@cache
def remembered(path: str, counts: bytes) -> tuple[Model, dict[int, int]]:
    """A worker's model and the counts of words that it has met, kept from task to task."""
    return Model.of(path, np.frombuffer(counts, dtype=np.int64)), {}


def count(docs: DataFrame, vocabulary: str, rounds: int = ROUNDS) -> DataFrame:
    """doc_id, n_words, n_tokens, one row for each row of docs.

    A word is what ASCII white space separates, with MARK before it. Null and empty texts have 0 words and tokens. Other columns of docs are
    not read; a repeated row is counted, and its words are learnt from, as often as it occurs."""
    learnt = estimated(docs, vocabulary, rounds).tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, known = remembered(vocabulary, learnt)
        for batch in of_bytes(batches, "text", SLICE):
            w = words(text_of(batch), fold=False)
            keys, first, which = np.unique(w.hashes, return_index=True, return_inverse=True)
            if len(known) > REMEMBERED:
                known.clear()
            listed = keys.tolist()
            new = [i for i, k in enumerate(listed) if k not in known]
            if new:
                data = w.data.tobytes()
                at = first[new]
                texts = [MARK + data[a:b].decode() for a, b in zip(w.starts[at].tolist(), w.ends[at].tolist(), strict=True)]
                known.update(zip((listed[i] for i in new), model.counts(texts).tolist(), strict=True))
            each = np.fromiter((known[k] for k in listed), dtype=np.int64, count=len(listed))[which]
            total = np.concatenate([[0], np.cumsum(each)])[np.concatenate([[0], np.cumsum(w.counts)])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(w.counts), pa.array(np.diff(total))], ["doc_id", "n_words", "n_tokens"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_words long, n_tokens long")
