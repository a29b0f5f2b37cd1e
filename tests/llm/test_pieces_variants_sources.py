"""Encoding by a piece table, spelling variants and divergence of sources against the library, brute force and SQL."""

import hashlib
import random
import re
import zlib
from collections import Counter

import duckdb
import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import SCHEMA, odd_rows, prose
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewell.llm import piecetable, termshards, variants
from tracewell.llm.shared import Files, vocabulary

LOW = str.maketrans(variants.UPPER, variants.LOWER)


# --- 11 encoding and decoding


@pytest.fixture(scope="module")
def library():
    from sentencepiece import SentencePieceProcessor

    return SentencePieceProcessor(model_file=vocabulary(piecetable.VOCABULARY))


@pytest.fixture(scope="module")
def coder():
    return piecetable.Model(vocabulary(piecetable.VOCABULARY))


def same(coder, library, texts):
    for text, ids in zip(texts, coder.encode(texts), strict=True):
        assert ids.tolist() == library.encode(text), text
        assert coder.decode(np.append(ids, coder.end)) == library.decode([*ids.tolist(), coder.end])


@given(st.lists(st.one_of(st.text(max_size=40), st.text(alphabet=" ▁aethn\n<0xA>é日😀\x00", max_size=60)), max_size=6))
@settings(max_examples=300, deadline=None)
def test_pieces_are_those_of_the_library(coder, library, texts):
    same(coder, library, texts)


def test_pieces_side_by_side_are_those_of_the_library(coder, library):
    rng = random.Random(5)
    pieces = [x.replace("▁", " ") for x in coder.text if x]
    same(coder, library, ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 9))) for _ in range(6000)])
    # runs of spaces are pieces of equal rank, for which the quick test of a pair does not hold
    same(coder, library, [f"a{' ' * n}b{' ' * (n % 7)}" for n in range(80)] + ["=" * n for n in range(120)] + ["x" * 30_000])


@given(st.lists(st.one_of(st.integers(0, 258), st.integers(0, 31_999)), max_size=12))
@settings(max_examples=300, deadline=None)
def test_decoding_any_ids_is_that_of_the_library(coder, library, ids):
    assert coder.decode(np.array(ids, dtype=np.int32)) == library.decode(ids)


def test_a_pair_fits_where_merging_gives_it_back(coder):
    rng = random.Random(2)
    pieces = [i for i, x in enumerate(coder.text) if x and (len(x) == 1 or coder.made[i] >= 0)]
    for _ in range(4000):
        a, b = rng.choice(pieces), rng.choice(pieces)
        assert coder.fits(a, b) == (piecetable.merged(coder.text[a] + coder.text[b], coder.rank) == [coder.text[a], coder.text[b]])


def test_what_is_remembered_changes_nothing(coder, library, monkeypatch):
    rng = random.Random(8)
    texts = [prose(rng, rng.randrange(200)) for _ in range(40)]
    monkeypatch.setattr(piecetable, "WORDS", 50)
    monkeypatch.setattr(piecetable, "BLOCK", 7)
    monkeypatch.setattr(piecetable, "PAIRS", 20)
    same(coder, library, texts + ["y" * 100, "y" * 100 + " z"])


def test_models_that_rewrite_texts_are_refused(tmp_path):
    from sentencepiece import sentencepiece_model_pb2

    proto = sentencepiece_model_pb2.ModelProto()
    with open(vocabulary(piecetable.VOCABULARY), "rb") as f:
        proto.ParseFromString(f.read())
    proto.normalizer_spec.remove_extra_whitespaces = True
    (tmp_path / "other.model").write_bytes(proto.SerializeToString())
    with pytest.raises(ValueError, match="rewrites"):
        piecetable.Model(str(tmp_path / "other.model"))


def test_round_trip_of_odd_rows(odd, empty, clashing, library):
    path = vocabulary(piecetable.VOCABULARY)

    def want(text):
        ids = [*library.encode(text or ""), library.eos_id()]
        return len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids).encode()).hexdigest()

    expected = Counter((i, *want(t)) for i, t, *_ in odd_rows())
    assert Counter(map(tuple, piecetable.round_trip(odd, path).collect())) == expected
    assert Counter(map(tuple, piecetable.round_trip(clashing, path).collect())) == expected
    assert piecetable.round_trip(empty, path).collect() == []


def test_ids_and_texts_of_the_operator(spark, library):
    path = vocabulary(piecetable.VOCABULARY)
    docs = spark.createDataFrame([(1, "some words"), (2, None)], "doc_id long, text string")
    assert {r["doc_id"]: r["ids"] for r in piecetable.encode(docs, path, end=False).collect()} == {1: library.encode("some words"), 2: []}
    ids = spark.createDataFrame([(1, library.encode("some words")), (2, None)], "doc_id long, ids array<int>")
    assert {r["doc_id"]: r["text"] for r in piecetable.decode(ids, path).collect()} == {1: "some words", 2: ""}


# --- 12 spelling variants


def apart(a, b):
    """Whether one inserted, deleted or replaced character leads from a to b."""
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    short, long = sorted((a, b), key=len)
    return len(long) == len(short) + 1 and any(long[:i] + long[i + 1 :] == short for i in range(len(long)))


def brute_variants(n_of):
    out = {}
    for w, n in n_of.items():
        near = [v for v in n_of if apart(w, v)]
        best = min(((-n_of[v], v) for v in near), default=(0, None))
        out[w] = [best[1] if -best[0] >= 10 * n and near else None, None, n, len(near), None]
        out[w][4] = n_of[out[w][0]] if out[w][0] else None
    for w in out:
        root = w
        while out[root][0]:
            root = out[root][0]
        out[w][1] = root
    return {w: tuple(x) for w, x in out.items()}


def brute_words(rows):
    words = Counter()
    for doc_id, text, *_ in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = run.translate(LOW)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            words[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    return {w: n for w, n in words.items() if len(w) >= 7 and n >= 2}


def found(df):
    rows = df.collect()
    out = {r["word"]: (r["form"], r["root"], r["n"], r["n_near"], r["form_n"]) for r in rows}
    assert len(out) == len(rows)
    return out


@pytest.mark.parametrize("shard", [1 << 17, 7])
def test_variants_are_those_of_brute_force(spark, monkeypatch, shard):
    monkeypatch.setattr(variants, "SHARD", shard)
    rng = random.Random(3)
    n_of = {}
    for _ in range(60):
        word = "".join(rng.choice("abcÀÿé") for _ in range(rng.randrange(7, 12)))
        n_of[word] = rng.choice([2, 20, 200, 5000])
        for _ in range(rng.randrange(9)):
            at, letter = rng.randrange(len(word) + 1), rng.choice("abcé")
            other = rng.choice([word[:at] + letter + word[at:], word[:at] + word[at + 1 :], word[:at] + letter + word[at + 1 :]])
            if len(other) >= 7:
                n_of.setdefault(other, rng.choice([2, 2, 3, 20, 199, 200]))
    # chains of forms, ties, repeated letters, one word that another begins with
    n_of |= {"chainaa": 2, "chainaab": 20, "chainaabb": 200, "chainaabbb": 2000, "tieaaaa": 2, "tieaaab": 20, "tieaaac": 20, "aaaaaaa": 2, "aaaaaaaa": 3, "aaaaaaaaa": 40, "z" * 300: 2, "z" * 301: 30}
    words = spark.createDataFrame(list(n_of.items()), "word string, n long")
    assert found(variants.groups(words)) == brute_variants(n_of)


def test_variants_of_texts(spark, odd, empty, clashing):
    rng = random.Random(4)
    forms = ["".join(rng.choice("aeioustrl") for _ in range(9)) for _ in range(30)]
    rows = [(i, " ".join(rng.choice(forms).title() + rng.choice([",", "", "_", "ß"]) for _ in range(80)), "en", "s", 1) for i in range(120)] + odd_rows()
    docs = spark.createDataFrame(rows, SCHEMA)
    want = brute_variants(brute_words(rows))
    assert any(x[0] for x in want.values()) and found(variants.variants(docs)) == want
    assert found(variants.variants(odd)) == brute_variants(brute_words(odd_rows())) == found(variants.variants(clashing))
    assert found(variants.variants(empty)) == {}


def test_a_trie_of_one_or_no_word():
    for words in ([], [b"abcdefg"], [b"abcdefg", b"abcdefgh"]):
        trie = variants.Trie.of(*variants.Trie.arrays(words, np.arange(1, len(words) + 1)))
        assert trie.near(b"abcdefx", 0) == ({b"abcdefg": 1} if words else {})
        assert trie.near(b"abcdefgh", 3) == ({b"abcdefg": 1} if words else {})


def test_a_shard_that_is_gone_is_an_error(tmp_path):
    files = Files(f"file://{tmp_path}/tries")
    variants._write(files, "0-0", [b"abcdefg"], np.array([3]))
    assert variants._read(files.uri, "0-0").near(b"abcdef", 0) == {b"abcdefg": 3}
    with pytest.raises(FileNotFoundError):
        variants._read(files.uri, "0-1")


# --- 13 divergence of sources


def brute_divergence(rows):
    docs = [((lang or ""), (source or ""), Counter(x.translate(LOW) for x in re.findall(termshards.TERM, text or ""))) for _, text, lang, source, _ in rows]
    out = Counter()
    for lang in {x[0] for x in docs}:
        of = [x for x in docs if x[0] == lang]
        in_docs = Counter(t for _, _, c in of for t in c)
        kept = [t for t, n in in_docs.items() if n >= termshards.DOCUMENTS]

        def shares(some, kept=kept):
            c = Counter()
            for x in some:
                c.update({t: n for t, n in x[2].items() if t in set(kept)})
            total = sum(c.values())
            return c, {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}

        whole, by = shares(of)[1], {s: shares([x for x in of if x[1] == s]) for s in {x[1] for x in of}}
        for s, (count, p) in by.items():
            pairs = sorted((-sum(abs(p[t] - by[o][1][t]) for t in kept), o.encode(), o) for o in by if o != s)
            terms = sorted((whole[t] - p[t], t.encode(), t) for t in kept if count[t] and p[t] > whole[t])[:50]
            for part, listed in (("pair", pairs), ("term", terms)):
                out.update((lang, s, part, item, -v, i + 1) for i, (v, _, item) in enumerate(listed))
    return out


def listed(df):
    return Counter((r["lang"], r["source"], r["part"], r["item"], r["value"], r["rank"]) for r in df.collect())


@pytest.mark.parametrize("slices", [(16 << 20, 500_000), (2000, 15)])
def test_divergence_is_that_of_brute_force(spark, empty, monkeypatch, slices):
    monkeypatch.setattr(termshards, "SLICE", slices[0])
    monkeypatch.setattr(termshards, "SHARD", slices[1])
    rng = random.Random(6)
    words = ["É", "éa", "日本", "Word", "wORD", "x1y", "\x7fq", *(f"t{chr(97 + i)}" for i in range(20))]
    rows = [(i, " ".join(rng.choice(words[: 4 + 6 * (i % 5)]) for _ in range(rng.randrange(40))) + ("\n" if i % 2 else ""), ["en", "de", None][i % 3], ["a", "b", "ü", None][i % 4], 1) for i in range(330)]
    rows += [(999, None, "en", "none", 0), (998, "t", "xx", "alone", 0), (997, "", "yy", "a", 0), (996, None, "yy", "b", 0), (1, "éa word", "en", "a", 0)] + odd_rows()
    docs = spark.createDataFrame(rows, SCHEMA)
    want = brute_divergence(rows)
    assert {x[2] for x in want} == {"pair", "term"} and any(x[4] == 0 for x in want)
    assert listed(termshards.divergence(docs)) == want
    assert listed(termshards.divergence(empty)) == Counter()
    if slices[1] == 15:  # columns with names that the plan uses
        from pyspark.sql import functions as F

        more = docs.withColumns({c: F.lit("mine") for c in ("term", "n", "documents", "shard", "part", "item", "value", "rank", "total", "terms", "row")})
        assert listed(termshards.divergence(more)) == want
        con = duckdb.connect()
        con.register("documents", pa.Table.from_pylist([dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r, strict=True)) for r in rows]))
        assert Counter(con.sql(f"SELECT lang, source, part, item, value, rank FROM ({termshards.SQL})").fetchall()) == want
