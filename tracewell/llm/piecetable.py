"""Encoding and decoding by the merges of a SentencePiece model, without running the merges.

Merging a text leaves, for each of its prefixes, one last piece, and what comes before that piece is the encoding of the shorter prefix. So a table of
last pieces is filled from left to right: an automaton gives all pieces that end at a character, and the one that may follow the last piece of the
prefix before it is the entry. Whether two pieces may stand side by side is a property of the two alone: merging their joined text must give them back.
The ids are then read off the table backwards.

Where no piece has the space mark behind another character, no merge crosses from a word to the next space, so words are encoded one by one and remembered.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from functools import cache
from itertools import batched, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .shared import of_bytes, text_of

VOCABULARY = "piece_bpe_32k.model"
#: What the model writes for a space.
MARK = "▁"
#: Words and pairs of pieces that a worker remembers, words that it takes at a time, text of a batch in bytes, and the longest word worth remembering.
WORDS, PAIRS, BLOCK, SLICE, LONG = 300_000, 300_000, 50_000, 1 << 20, 64


def merged(text: str, ranks: dict[str, float]) -> list[str]:
    """The pieces of a text by the merges themselves: the best pair first, of equals the leftmost. For short texts."""
    parts = list(text)
    while True:
        best = min(((ranks[pair], i) for i in range(len(parts) - 1) if (pair := parts[i] + parts[i + 1]) in ranks), default=None)
        if best is None:
            return parts
        parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]


class Model:
    """Pieces of a model with merges and byte fallback, that leaves texts as they are but for spaces and one space mark before them."""

    def __init__(self, path: str):
        from sentencepiece import sentencepiece_model_pb2

        proto = sentencepiece_model_pb2.ModelProto()
        with open(path, "rb") as f:
            proto.ParseFromString(f.read())
        kind, how, kinds = proto.trainer_spec, proto.normalizer_spec, sentencepiece_model_pb2.ModelProto.SentencePiece
        if kind.model_type != kind.BPE or not kind.byte_fallback or kind.treat_whitespace_as_suffix:
            raise ValueError("not a model of merges with byte fallback and leading space marks")
        if how.precompiled_charsmap or how.remove_extra_whitespaces or not how.escape_whitespaces or not how.add_dummy_prefix or proto.denormalizer_spec.precompiled_charsmap:
            raise ValueError("a model that rewrites texts")
        listed = [(i, p.piece, p.score) for i, p in enumerate(proto.pieces) if p.type == kinds.NORMAL]
        if len(listed) + sum(p.type in (kinds.CONTROL, kinds.UNKNOWN, kinds.BYTE) for p in proto.pieces) < len(proto.pieces):
            raise ValueError("a model with user-defined or unused pieces")
        self.end, self.bytes = kind.eos_id, [0] * 256
        surfaces = [b""] * len(proto.pieces)
        for i, p in enumerate(proto.pieces):
            if p.type == kinds.BYTE:
                value = int(p.piece[1:-1], 16)
                self.bytes[value], surfaces[i] = i, bytes([value])
            elif p.type == kinds.UNKNOWN:
                surfaces[i] = kind.unk_surface.encode()
        self._prepare(listed, surfaces)

    def _prepare(self, listed: list[tuple[int, str, float]], surfaces: list[bytes]) -> None:
        import ahocorasick

        self.rank = {piece: -score for _, piece, score in listed}
        number = {piece: i for i, piece, _ in listed}
        self.text = [""] * len(surfaces)
        # When a piece comes into being, and of which two it is made: characters are there from the start. `sure`: each part is made before the whole.
        self.made = [-1.0] * len(surfaces)
        self.left, self.right, self.sure = [0] * len(surfaces), [0] * len(surfaces), [True] * len(surfaces)
        self.automaton = ahocorasick.Automaton()
        for i, piece, _ in sorted(listed, key=lambda x: (len(x[1]), x[0])):
            self.text[i], surfaces[i] = piece, piece.replace(MARK, " ").encode()
            if len(piece) > 1:
                halves = self._halves(piece)
                if halves is None:  # no merges lead to it
                    continue
                a, b = (number.get(h, -1) for h in halves)
                self.made[i], self.left[i], self.right[i] = self.rank[piece], a, b
                self.sure[i] = min(a, b) >= 0 and self.sure[a] and self.sure[b] and max(self.made[a], self.made[b]) < self.made[i]
            self.automaton.add_word(piece, (i, len(piece)))
        self.automaton.make_automaton()
        self.length = [len(x) for x in self.text]
        self.pattern = re.compile(f"{MARK}*[^{MARK}]+|{MARK}+" if not any(re.search(f"[^{MARK}]{MARK}", x) for x in self.text) else r"(?s:.+)")
        sizes = np.array([len(x) for x in surfaces], dtype=np.int64)
        self.surface, self.surface_ends = np.frombuffer(b"".join(surfaces), dtype=np.uint8), np.cumsum(sizes)
        self.surface_sizes = sizes
        self.pairs: dict[int, bool] = {}
        self.forget()

    def _halves(self, piece: str) -> tuple[str, str] | None:
        """The two parts that the last merge of a piece joins; None if merging its text does not give it."""
        parts = list(piece)
        while len(parts) > 2:
            best = min(((self.rank[pair], i) for i in range(len(parts) - 1) if (pair := parts[i] + parts[i + 1]) in self.rank), default=None)
            if best is None:
                return None
            parts[best[1] : best[1] + 2] = [parts[best[1]] + parts[best[1] + 1]]
        return parts[0], parts[1]

    def forget(self) -> None:
        self.place: dict[str, int] = {}
        self.ids, self.begins = np.zeros(0, dtype=np.int32), np.zeros(1, dtype=np.int64)

    def fits(self, a: int, b: int) -> bool:
        """Whether merging the joined text of two pieces gives these two."""
        key = a * len(self.text) + b
        known = self.pairs.get(key)
        if known is None:
            if len(self.pairs) >= PAIRS:
                self.pairs.clear()
            known = self.pairs[key] = self._apart(a, b) if self.sure[a] and self.sure[b] else merged(self.text[a] + self.text[b], self.rank) == [self.text[a], self.text[b]]
        return known

    def _apart(self, a: int, b: int) -> bool:
        """Goes back in time from the two pieces: what touches at the seam must at no time be a better merge than the next one at either side. Of equally
        good merges the left one comes first. Sound where each part of a piece is made before the piece."""
        ends_a = ends_b = float("inf")
        while True:
            across = self.rank.get(self.text[a] + self.text[b])
            if across is not None and across < ends_a and across <= ends_b:
                return False
            if self.made[a] > self.made[b]:
                ends_a, a = self.made[a], self.right[a]
            elif self.made[b] >= 0:
                ends_b, b = self.made[b], self.left[b]
            else:
                return True

    def table(self, word: str) -> list[int]:
        """The last piece of each prefix; 0 for a character that no piece covers, which is encoded as its bytes."""
        last = [0] * (len(word) + 1)
        for at, (piece, length) in self.automaton.iter(word):
            end = at + 1
            if not last[end]:
                before = last[end - length]
                if not before or self.fits(before, piece):
                    last[end] = piece
        return last

    def encode_word(self, word: str) -> list[int]:
        last, at, ids = self.table(word), len(word), []
        while at:
            if piece := last[at]:
                ids.append(piece)
                at -= self.length[piece]
            else:
                ids.extend(self.bytes[x] for x in reversed(word[at - 1].encode()))
                at -= 1
        ids.reverse()
        return ids

    def encode(self, texts: Iterable[str | None]) -> list[np.ndarray]:
        """Ids of each text, without an end id."""
        out, words, owners = [], [], []

        def flush() -> None:
            ids, ends = self._words(words)
            at = 0
            for row, n in owners:
                out[row].append(ids[ends[at] : ends[at + n]])
                at += n
            words.clear()
            owners.clear()

        for row, text in enumerate(texts):
            out.append([])
            if text:
                for some in batched((m.group() for m in self.pattern.finditer(MARK + text.replace(" ", MARK))), BLOCK):
                    words.extend(some)
                    owners.append((row, len(some)))
                    if len(words) >= BLOCK:
                        flush()
        flush()
        return [np.concatenate([np.zeros(0, dtype=np.int32), *parts]) for parts in out]

    def _words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all words, where those of each begin, and the end)."""
        if len(self.place) > WORDS:
            self.forget()
        place = self.place
        new = {x for x in words if x not in place}
        learnt = [self.encode_word(x) for x in new]
        first = len(self.begins) - 1
        place.update(zip(new, range(first, first + len(new)), strict=True))
        ids = np.concatenate([self.ids, np.fromiter(chain.from_iterable(learnt), dtype=np.int32)])
        begins = np.concatenate([self.begins, self.begins[-1] + np.cumsum([len(x) for x in learnt], dtype=np.int64)])
        at = np.fromiter(map(place.__getitem__, words), dtype=np.int64, count=len(words))
        begin, size = begins[at], begins[at + 1] - begins[at]
        ends = np.concatenate([[0], np.cumsum(size)])
        found = ids[np.repeat(begin - ends[:-1], size) + np.arange(ends[-1])]
        if any(len(x) >= LONG for x in new):  # long words are not kept, and places count up, so what was learnt with one goes with it
            for x in new:
                del place[x]
        else:
            self.ids, self.begins = ids, begins
        return found, ends

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids: pieces side by side, marks as spaces, the first of them dropped; control ids give nothing; bytes that are not UTF-8 give one U+FFFD each."""
        sizes = self.surface_sizes[ids]
        first = self.surface_ends[ids] - sizes
        raw = self.surface[np.repeat(first - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))].tobytes()
        begins = np.flatnonzero(sizes)
        lead = len(begins) > 0 and self.text[ids[begins[0]]].startswith(MARK)
        # bytes on both sides of a control id do not make a character together
        seams = np.unique(np.cumsum(sizes)[sizes == 0]).tolist()
        return "".join(utf8(raw[a:b]) for a, b in zip([0, *seams], [*seams, len(raw)], strict=True))[int(lead) :]


def utf8(raw: bytes) -> str:
    """UTF-8 read as far as it goes: a byte that begins no valid character is one U+FFFD."""
    out, at = [], 0
    while at < len(raw):
        try:
            out.append(raw[at:].decode())
            break
        except UnicodeDecodeError as bad:
            out += [raw[at : at + bad.start].decode(), "�"]
            at += bad.start + 1
    return "".join(out)


@cache
def model(path: str) -> Model:
    """One for each worker, which keeps what it has learnt from task to task."""
    return Model(path)


def encode(docs: DataFrame, vocabulary: str, end: bool = True, decoded: bool = False) -> DataFrame:
    """doc_id, ids, and with `decoded` the text that these ids decode to: one row for each row of docs, in tasks of their own without a shuffle.

    Null and empty texts have the end id only. Repeated rows and null doc_ids are rows like others; columns beyond doc_id and text are not read. A text is taken
    whole, BLOCK words at a time; an empty table gives an empty one."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = model(vocabulary)
        tail = np.array([coder.end] if end else [], dtype=np.int32)
        for batch in of_bytes(batches, "text", SLICE):
            each = [np.concatenate([x, tail]) for x in coder.encode(text_of(batch).to_pylist())]
            bounds = np.concatenate([[0], np.cumsum([len(x) for x in each])]).astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(bounds), pa.array(np.concatenate(each)))
            texts = [pa.array(map(coder.decode, each), pa.string())] if decoded else []
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, *texts], ["doc_id", "ids", "text"][: 2 + decoded])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, ids array<int>" + ", text string" * decoded)


def decode(encoded: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, ids, text of encoded (doc_id, ids). Null ids have an empty text. An id that the model does not have is an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = model(vocabulary)
        for batch in batches:
            lists = batch.column(1)
            bounds, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            texts = [coder.decode(flat[a:b]) for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), lists, pa.array(texts, pa.string())], ["doc_id", "ids", "text"])

    return encoded.select("doc_id", F.coalesce("ids", F.array().cast("array<int>")).alias("ids")).mapInArrow(run, "doc_id long, ids array<int>, text string")


def round_trip(docs: DataFrame, vocabulary: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 (decimal ids joined by a space), decoded_sha256 of each row of docs, which encoding and decoding give."""
    ids = F.array_join(F.col("ids").cast("array<string>"), " ")
    return encode(docs, vocabulary, decoded=True).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), F.sha2(ids, 256).alias("ids_sha256"), F.sha2("text", 256).alias("decoded_sha256"))
