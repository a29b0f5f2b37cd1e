"""The pipeline against a brute-force version of its stages."""

import random
import zlib
from collections import defaultdict

import numpy as np
from conftest_llm import SCHEMA, prose
from test_text_operators import WORD, brute_lines, fold, shingle_counts

import corpus_pipeline
from tracewell.llm import bytecnn, packing
from tracewell.llm.shared import vocabulary


def corpus(rng):
    """(documents, labels, benchmark): clean prose, junk, exact and near copies, three-line passages that repeat, benchmark items."""
    passage = "\n".join(prose(rng, 20) for _ in range(3))
    items = [(i, prose(rng, 30)) for i in range(3)]
    texts = []
    for i in range(60):
        lines = [prose(rng, 15) for _ in range(rng.randrange(2, 9))]
        texts.append("\n".join(lines[:1] + ([passage] if i % 6 == 0 else []) + lines[1:] + ([items[i % 3][1]] if i % 11 == 0 else [])))
    texts += [" ".join(w.upper() + "!!" for w in prose(rng, 60).split()) for _ in range(40)]
    for i in range(1, 10):
        words = texts[i].split(" ")
        words[len(words) // 2] = "edit"
        texts += [" ".join(words), texts[i + 10]]
    texts += [None, "", "a b"]
    docs = [(i, t, "en", "s", None if t is None else len(t)) for i, t in enumerate(texts)]
    return docs, [(i, int(i < 60), 0) for i in range(100)], items


def test_run_is_the_stages_by_brute_force(spark, tmp_path):
    docs, labels, items = corpus(random.Random(21))
    table = spark.createDataFrame(docs, SCHEMA)
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    for name, df in (("documents", table), ("labels", marks), ("benchmark", spark.createDataFrame(items, "item_id long, text string"))):
        df.coalesce(1).write.parquet(f"{tmp_path}/{name}.parquet")
    network = bytecnn.fit(table, marks)
    left = {i: t for i, t, *_ in docs if bytecnn.probability(network, [(t or "").encode()])[0] >= bytecnn.GOOD}
    assert len(left) >= 60 and sum(60 <= i < 100 for i in left) <= 4

    texts = {i: t for i, t in left.items() if t is not None}
    cut = brute_lines(list(texts.items()))
    left = {i: None if t is None else cut[i] for i, t in left.items() if t is None or cut[i] == t or WORD.search(cut[i])}

    counts, root = {i: shingle_counts(t) for i, t in left.items()}, {i: i for i in left}
    for a in sorted(left):
        for b in sorted(left):
            if b < a and counts[a] and counts[b] and (shared := (counts[a] & counts[b]).total()) >= 0.8 * (counts[a].total() + counts[b].total() - shared):
                low, high = sorted((root[a], root[b]))
                root = {i: low if r == high else r for i, r in root.items()}
    once = {i: t for i, t in left.items() if root[i] == i}
    assert len(once) < len(left)

    shingles = lambda t: {tuple(w[i : i + 5]) for w in [WORD.findall(fold(t or ""))] for i in range(len(w) - 4)}
    clean = {i: t for i, t in once.items() if all(len(shingles(x) & shingles(t)) < 0.8 * len(shingles(x)) for _, x in items)}
    assert len(clean) < len(once)

    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary(packing.VOCABULARY))
    want = {i: np.array([*tokenizer.encode(t or "", add_special_tokens=False).ids, packing.END], dtype="<u4") for i, t in clean.items()}
    pieces, sequences = corpus_pipeline.run(spark, str(tmp_path)).collect(), defaultdict(list)
    held = defaultdict(int)
    for r in pieces:
        ids = want[r["doc_id"]][r["start"] : r["start"] + r["length"]]
        assert len(ids) == r["length"] and zlib.crc32(ids.tobytes()) == r["ids_crc32"] and len(want[r["doc_id"]]) == r["doc_tokens"]
        held[r["doc_id"]] += r["length"]
        sequences[r["sequence_id"]].append((r["offset"], r["length"]))
    assert held == {i: len(ids) for i, ids in want.items()}
    for parts in sequences.values():
        assert [o for o, _ in sorted(parts)] == [sum(n for _, n in sorted(parts)[:k]) for k in range(len(parts))] and sum(n for _, n in parts) <= packing.SEQUENCE
