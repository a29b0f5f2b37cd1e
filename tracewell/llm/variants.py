"""Spelling variants: of each word its neighbours at one edit, and the frequent neighbour that it probably stands for.

The words are sorted, cut into shards of a bounded number of words, and each shard is written as a compact trie into the folder that all executors share.
Every worker reads the shards that the Levenshtein automata of its words can enter, and walks them depth-first: an automaton stands on the word's own way
until an edit is spent, and then only the rest of the word leads on. Words are in the shards twice, as they are and reversed. The forward tries
are searched for edits in the second half of a word, the reversed ones for edits in the first, so the wide upper levels of a trie are crossed without an
edit to spend, and each neighbour is found once. What each word finds is reduced on the spot to a count and the best form.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .shared import Files, cut, own_place

#: Runs of letters; of these one in TYPO has lost a character, by a hash of its document and text.
RUN, TYPO = r"[A-Za-zÀ-ÿ]+", 31
#: Least code points of a word, least occurrences, and how much more frequent the form of a word must be.
LEAST_LENGTH, LEAST_COUNT, RATIO = 7, 2, 10
#: Words of a shard and shards that a worker keeps. A node of a trie takes 13 bytes, a word at most one node for each of its characters.
SHARD, OPEN = 1 << 17, 8
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def occurrences(docs: DataFrame) -> DataFrame:
    """word: a row for each run of letters of each text, A-Z in lower case, with the planted slips. A null doc_id counts as an empty one."""
    low = F.translate("text", UPPER, LOWER)
    runs = docs.select(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).alias("id"), F.explode(F.regexp_extract_all(low, F.lit(RUN), F.lit(0))).alias("run"))
    h, n = F.crc32(F.concat("id", F.lit(":"), "run")), F.length("run")
    at = (h % n).cast("int")
    slipped = F.concat(F.substring(F.col("run"), F.lit(1), at), F.substring(F.col("run"), at + 2, n))
    return runs.where(F.length("run") >= LEAST_LENGTH).select(F.when(h % TYPO == 0, slipped).otherwise(F.col("run")).alias("word"))


def vocabulary(docs: DataFrame) -> DataFrame:
    """word, n of the words that are long and frequent enough."""
    words = occurrences(docs).where(F.length("word") >= LEAST_LENGTH)
    return words.groupBy("word").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") >= LEAST_COUNT)


@dataclass
class Trie:
    """Words of one shard. Node 0 is the root; the arcs of a node lie side by side, and arc i leads to node i + 1, so only labels and where each
    node's arcs begin are kept. `counts`: how often the word that ends at a node occurs, 0 if none does."""

    labels: bytes
    begins: memoryview
    counts: memoryview

    @classmethod
    def arrays(cls, words: list[bytes], counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(labels, begins, counts) of sorted distinct words, built a level at a time."""
        flat = np.frombuffer(b"".join(words), dtype=np.uint8)
        sizes = np.array([len(x) for x in words], dtype=np.int64)
        starts = np.cumsum(sizes) - sizes
        alive, node = np.arange(len(words)), np.zeros(len(words), dtype=np.int64)
        ends = np.zeros(1, dtype=np.int64)
        ends_all, arcs, labels, depth = [ends], [], [], 0
        while len(alive):
            done = sizes[alive] == depth
            ends[node[done]] = counts[alive[done]]
            alive, node = alive[~done], node[~done]
            letter = flat[starts[alive] + depth]
            new = np.ones(len(alive), dtype=bool)
            new[1:] = (node[1:] != node[:-1]) | (letter[1:] != letter[:-1])
            arcs.append(np.bincount(node[new], minlength=len(ends)))
            labels.append(letter[new])
            ends = np.zeros(int(new.sum()), dtype=np.int64)
            ends_all.append(ends)
            node, depth = np.cumsum(new) - 1, depth + 1
        arcs.append(np.zeros(len(ends), dtype=np.int64) if not arcs or len(ends) else np.zeros(0, dtype=np.int64))
        begins = np.concatenate([[0], np.cumsum(np.concatenate(arcs))])
        return np.concatenate([np.zeros(0, np.uint8), *labels]), begins.astype("<u4"), np.concatenate(ends_all).astype("<i8")

    @classmethod
    def of(cls, labels: np.ndarray, begins: np.ndarray, counts: np.ndarray) -> Trie:
        return cls(labels.tobytes(), memoryview(begins), memoryview(counts))

    def rest(self, node: int, word: bytes, at: int) -> int:
        """How often the word occurs that goes on from a node as `word` does from `at`; 0 if there is none."""
        labels, begins = self.labels, self.begins
        for i in range(at, len(word)):
            arc = labels.find(word[i], begins[node], begins[node + 1])
            if arc < 0:
                return 0
            node = arc + 1
        return self.counts[node]

    def near(self, word: bytes, exact: int) -> dict[bytes, int]:
        """Words at one edit, with their counts, of which the first `exact` characters are those of the word: the word's automaton goes down its own way,
        and at each node from there on spends its edit on a character left out, put in or replaced, and follows the rest."""
        labels, begins, rest = self.labels, self.begins, self.rest
        found, node = {}, 0
        for at in range(len(word) + 1):
            first, last = begins[node], begins[node + 1]
            if at >= exact:
                if at < len(word) and (n := rest(node, word, at + 1)):
                    found[word[:at] + word[at + 1 :]] = n
                for arc in range(first, last):
                    letter = labels[arc : arc + 1]
                    if at < len(word) and letter[0] != word[at] and (n := rest(arc + 1, word, at + 1)):
                        found[word[:at] + letter + word[at + 1 :]] = n
                    if n := rest(arc + 1, word, at):
                        found[word[:at] + letter + word[at:]] = n
            if at < len(word):
                arc = labels.find(word[at], first, last)
                if arc < 0:
                    break
                node = arc + 1
        found.pop(word, None)
        return found


def _write(files: Files, name: str, words: list[bytes], counts: np.ndarray) -> None:
    labels, begins, ends = Trie.arrays(words, counts)
    files.write(name, [np.array([len(labels), len(begins), len(ends)], dtype="<i8").tobytes(), ends.tobytes(), begins.tobytes(), labels.tobytes()])


@lru_cache(maxsize=OPEN)
def _read(uri: str, name: str) -> Trie:
    data = Files(uri, most=1).read(name)
    if data is None:
        raise FileNotFoundError(f"{uri}/{name}: a shard that was written is not there")
    n_labels, n_begins, n_ends = np.frombuffer(data[:24], dtype="<i8").tolist()
    at = 24 + 8 * n_ends
    return Trie.of(np.frombuffer(data[at + 4 * n_begins :], dtype=np.uint8, count=n_labels), np.frombuffer(data[at : at + 4 * n_begins], dtype="<u4"), np.frombuffer(data[24:at], dtype="<i8"))


def _partitions(df: DataFrame, rows: int) -> int:
    """As many partitions as the session has for shuffles, more where one would hold more than two shards."""
    return max(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows // (2 * SHARD)))


def search(words: DataFrame, n_words: int, backward: bool) -> DataFrame:
    """word, n, n_near, form, form_n of words (word, n): neighbours whose edit lies in the second half of a word, or in the first if `backward`.

    form: the most frequent of them, the first in order of equals. What the driver gets is a name and a first word for each shard of SHARD words."""
    spark = words.sparkSession
    files = Files(own_place(spark, "tries"))
    keyed = words.select("word", "n", (F.reverse("word") if backward else F.col("word")).alias("key"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, flushed, n, held = TaskContext.get().partitionId(), 0, 0, []

        def flush() -> Iterator[pa.RecordBatch]:
            name = f"{part}-{flushed}"
            table = pa.Table.from_batches(held)
            _write(files, name, [x.encode("latin-1") for x in table["key"].to_pylist()], table["n"].to_numpy())
            for i, batch in enumerate(held):
                first = [name if i == j == 0 else None for j in range(batch.num_rows)]
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first, pa.string())], [*batch.schema.names, "begins"])

        for batch in batches:
            while batch.num_rows:
                some = batch.slice(0, SHARD - n)
                held.append(some)
                n += some.num_rows
                batch = batch.slice(some.num_rows)
                if n == SHARD:
                    yield from flush()
                    flushed, n, held = flushed + 1, 0, []
        if n:
            yield from flush()

    ranged = keyed.repartitionByRange(_partitions(words, n_words), "key").sortWithinPartitions("key")
    dealt = cut(ranged.mapInArrow(build, "word string, n long, key string, begins string"), "words")
    shards = sorted((r["key"], r["begins"]) for r in dealt.where("begins IS NOT NULL").collect())
    firsts, names, uri = [x for x, _ in shards], [x for _, x in shards], files.uri

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_near, forms, form_n = [], [], []
            for key in batch.column(batch.schema.get_field_index("key")).to_pylist():
                half = len(key) // 2
                exact = len(key) - half if backward else half
                # shards whose words can begin as this one does
                begin, end = bisect_right(firsts, key[:exact]) - 1, bisect_right(firsts, key[:exact] + "￿")
                coded, near = key.encode("latin-1"), {}
                for i in range(max(begin, 0), end):
                    near |= _read(uri, names[i]).near(coded, exact)
                if backward:
                    near = {x[::-1]: n for x, n in near.items()}
                    word = coded[::-1]
                    near = {x: n for x, n in near.items() if x[:half] != word[:half]}
                best = min(((-n, x) for x, n in near.items()), default=None)
                n_near.append(len(near))
                forms.append(best and best[1].decode("latin-1"))
                form_n.append(best and -best[0])
            columns = [batch.column(batch.schema.get_field_index(c)) for c in ("word", "n")]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(n_near, pa.int64()), pa.array(forms, pa.string()), pa.array(form_n, pa.int64())], ["word", "n", "n_near", "form", "form_n"])

    return dealt.mapInArrow(find, "word string, n long, n_near long, form string, form_n long")


def _stronger(n: Column, form: Column) -> Column:
    """Orders forms: the most frequent first, of equals the first in order."""
    return F.struct((-n).alias("less"), form.alias("form"))


def groups(words: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n, a row for each row of words (word, n), which are distinct words of letters up to U+00FF.

    A form occurs at least RATIO times as often as its word, so a chain of forms is at most log10 of the largest count long, and as many roots are found as
    twice that in doublings. An empty table gives an empty one."""
    words = cut(words.select("word", "n"), "vocabulary")
    size = words.agg(F.count(F.lit(1)).alias("rows"), F.max("n").alias("most")).first()
    halves = search(words, size["rows"], False).unionByName(search(words, size["rows"], True))
    best = F.min(F.when(F.col("form").isNotNull(), _stronger(F.col("form_n"), F.col("form"))))
    near = halves.groupBy("word").agg(F.first("n").alias("n"), F.sum("n_near").alias("n_near"), best.alias("best"))
    holds = -F.col("best.less") >= RATIO * F.col("n")
    found = cut(near.select("word", "n", "n_near", F.when(holds, F.col("best.form")).alias("form"), F.when(holds, -F.col("best.less")).alias("form_n")), "forms")
    way, steps = found.where("form IS NOT NULL").select("word", F.col("form").alias("root")), 1
    while RATIO**steps <= (size["most"] or 0):
        on = way.select(F.col("word").alias("root"), F.col("root").alias("farther"))
        way = cut(way.join(on, "root", "left").select("word", F.coalesce("farther", "root").alias("root")), "roots")
        steps *= 2
    out = found.join(way, "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of the words of docs. Null and empty texts have no words; a repeated row counts again; a text counts whole;
    columns beyond doc_id and text are not read."""
    return groups(vocabulary(docs))
