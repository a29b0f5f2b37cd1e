"""Operators against brute force, and their results in odd cases."""

import hashlib
import html
import itertools
import math
import os
import random
import re
import time
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest_llm import SCHEMA, odd_rows, prose
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewell.llm import bytecnn, decontam, htmlpages, htmltext, linededup, lm, neardup, outliers, packing, secrets, trietokens
from tracewell.llm import words as W
from tracewell.llm.shared import Files, vocabulary

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def fold(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def by_id(df):
    return {r["doc_id"]: r for r in df.collect()}


# --- words


@given(st.lists(st.one_of(st.none(), st.text(alphabet="aAbé. ,\n\t\x0b\x1c日", max_size=30)), max_size=8))
@settings(max_examples=60, deadline=None)
def test_words_are_those_of_the_pattern(texts):
    w = W.words(pa.array(texts, pa.string()))
    want = [m for t in texts for m in WORD.findall(t or "")]
    assert [bytes(w.data[a:b]).decode() for a, b in zip(w.starts, w.ends, strict=True)] == want
    assert w.counts.tolist() == [len(WORD.findall(t or "")) for t in texts]
    hashes = {}
    for word, h in zip(want, w.hashes.tolist(), strict=True):
        assert hashes.setdefault(fold(word), h) == h
    assert len(set(hashes.values())) == len(hashes)


def test_words_do_not_depend_on_pieces(monkeypatch):
    rng = random.Random(3)
    texts = [prose(rng, rng.randrange(60)) for _ in range(30)] + ["y" * 500]
    whole = W.words(pa.array(texts))
    monkeypatch.setattr(W, "PIECE", 64)
    cut = W.words(pa.array(texts))
    assert whole.hashes.tolist() == cut.hashes.tolist() and whole.counts.tolist() == cut.counts.tolist()


# --- 1 quality classifier


def test_classifier_learns_and_reads_whole_texts(spark):
    rng = random.Random(0)
    good = [prose(rng, 60) for _ in range(120)]
    bad = [" ".join(w.upper() + "!!" for w in prose(rng, 40).split()) for _ in range(120)]
    texts = [x.encode() for x in good + bad]
    net = bytecnn.train(texts[:100] + texts[120:220], np.array([1.0] * 100 + [0.0] * 100), passes=6)
    p = bytecnn.probability(net, texts[100:120] + texts[220:])
    assert (p[:20] > 0.5).all() and (p[20:] < 0.5).all()
    # junk at the very end of a long text is seen, and a batch gives what single texts give
    tail = ((prose(rng, 9000)) + " " + bad[0]).encode()
    assert bytecnn.probability(net, [tail])[0] < bytecnn.probability(net, [tail[: -len(bad[0])]])[0]
    assert np.allclose(bytecnn.probability(net, [tail, b"", texts[0]]), [bytecnn.probability(net, [x])[0] for x in (tail, b"", texts[0])])


def test_chunk_means_are_those_of_a_plain_loop():
    net = bytecnn.train([b"ab", b"cd"], np.array([1.0, 0.0]), passes=1)
    for text in (b"", b"abc", bytes(range(65, 90)) * 20):
        best, _, _ = bytecnn.features(net, [text, b"zz"])
        codes = text + bytes(bytecnn.WIDTH - 1)
        answers = [np.maximum(net.bias + sum(net.filters[k, codes[i + k]] for k in range(bytecnn.WIDTH)), 0) for i in range(max(len(text), 1))] if text else [net.bias.clip(0) + 0 * net.bias]
        if not text:
            continue
        halves = [answers[i : i + bytecnn.HALF] for i in range(0, len(answers), bytecnn.HALF)]
        chunks = [a + b for a, b in zip(halves, halves[1:], strict=False)] or halves
        assert np.allclose(best[0], np.max([np.mean(c, axis=0) for c in chunks], axis=0), atol=1e-4)


def test_classifier_odd_cases(spark, odd, empty, clashing):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 0), (5, 1, None), (6, 0, 0), (6, 0, 0), (None, 1, 0), (7, None, 0), (8, 1, 1), (99, 1, 0)], "doc_id long, quality int, toxic int")
    out = bytecnn.classify(odd, labels).collect()
    assert len(out) == len(odd_rows()) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.7) for r in out)
    assert {r["doc_id"]: r["held_out"] for r in out if r["doc_id"] is not None} == {i: zlib.crc32(str(i).encode()) % 4 == 2 for i in range(1, 13)}
    assert bytecnn.classify(empty, labels).count() == 0
    assert bytecnn.classify(odd, labels.limit(0)).count() == len(odd_rows())
    assert bytecnn.stage(clashing, labels).columns == clashing.columns


def test_training_rows_are_bounded_but_whole(spark):
    docs = spark.createDataFrame([(i, "x" * (1000 if i % 10 else 200_000)) for i in range(200)] + [(900, None)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(1000)], "doc_id long, quality int, toxic int")
    every = [len(r["text"]) for r in bytecnn.training_rows(docs, labels).collect()]
    assert len(every) == sum(zlib.crc32(str(i).encode()) % 4 != 2 for i in range(200)) and every.count(200_000) > 5
    some = [len(r["text"]) for r in bytecnn.training_rows(docs, labels, most=60, most_bytes=500_000).collect()]
    assert some == every[: len(some)] and sum(some[:-1]) < 500_000 <= sum(some)


# --- 2 near-duplicates


def shingle_counts(text):
    w = WORD.findall(fold(text or ""))
    return Counter(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else None


def test_near_duplicates_are_the_components_of_similar_pairs(spark):
    rng = random.Random(5)
    docs = []
    for family in range(25):
        base = prose(rng, rng.randrange(30, 120)).split()
        for copy in range(rng.choice((1, 2, 3, 8))):
            w = list(base)
            for _ in range(rng.randrange(0, 1 + len(w) // 25)):
                w[rng.randrange(len(w))] = f"edit{rng.randrange(10**6)}"
            docs.append((len(docs), " ".join(w)))
    docs += [(len(docs), docs[3][1].upper()), (len(docs) + 1, ""), (len(docs) + 2, "")]
    counts = [shingle_counts(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a in range(len(docs)):
        for b in range(a):
            if counts[a] and counts[b]:
                shared = (counts[a] & counts[b]).total()
                if shared / (counts[a].total() + counts[b].total() - shared) >= 0.8:
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    got = by_id(neardup.classes(spark.createDataFrame(docs, "doc_id long, text string")))
    assert {i: r["class_id"] for i, r in got.items()} == {i: find(i) for i in range(len(docs))}


def test_dart_signatures_estimate_weighted_jaccard():
    rng = np.random.default_rng(1)
    ids = W.mix(np.arange(300, dtype=np.uint64))
    a, b = rng.integers(0, 5, 300).astype(float), rng.integers(0, 5, 300).astype(float)
    b[:240] = a[:240]
    ia, ib = np.flatnonzero(a), np.flatnonzero(b)
    sig = neardup.signatures(np.concatenate([ids[ia], ids[ib]]), np.concatenate([a[ia], b[ib]]), np.array([len(ia), len(ib)]), 2048)
    want = np.minimum(a, b).sum() / np.maximum(a, b).sum()
    assert abs((sig[0] == sig[1]).mean() - want) < 4 * math.sqrt(want * (1 - want) / 2048)
    # one row alone or in a batch, and rows of very different weight, come out alike
    alone = neardup.signatures(ids[ia], a[ia], np.array([len(ia)]), 64)
    both = neardup.signatures(np.concatenate([ids[:1], ids[ia], ids]), np.concatenate([[1e4], a[ia], np.full(300, 0.25)]), np.array([1, len(ia), 300]), 64)
    assert (alone[0] == both[1]).all() and both.all()


def test_components_of_chains_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 130)] + [(7, 7), (200, 201), (201, 200)]
    got = {r["node"]: r["root"] for r in neardup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 130)} | {201: 200}
    assert neardup.components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_near_duplicates_of_a_base_of_middle_id(spark):
    """1000 copies edited independently: like their base, unlike each other, so that the base alone joins them. Other texts share much of it, but too little."""
    rng = random.Random(5)
    base = prose(rng, 300, 10**6).split()

    def edited(n):
        words = list(base)
        for i in rng.sample(range(len(words)), n):
            words[i] = f"new{rng.randrange(10**9)}"
        return " ".join(words)

    texts = [edited(6 if i % 8 else 14) for i in range(1000)]
    texts.insert(500, " ".join(base))
    sets = [{tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in map(str.split, texts)]
    root = list(range(len(sets)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    linked = 0
    for a in range(len(sets)):
        for b in range(a):
            shared = len(sets[a] & sets[b])
            if shared >= 0.8 * (len(sets[a]) + len(sets[b]) - shared):
                linked += a != 500 != b
                low, high = sorted((top(a), top(b)))
                root[high] = low
    got = by_id(neardup.classes(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")))
    assert linked < 100 and len({top(i) for i in range(len(sets))}) > 100
    assert {i: r["class_id"] for i, r in got.items()} == {i: top(i) for i in range(len(sets))}


def test_near_duplicates_odd_cases(spark, odd, empty, clashing):
    got = by_id(neardup.classes(odd))
    assert set(got) == set(range(1, 13))
    assert all(r["class_id"] == i for i, r in got.items() if i != 11 or r["class_id"] == 11)
    assert got[1]["n_shingles"] == 0 and got[4]["n_shingles"] == 1 and got[7]["n_copies"] == 1
    assert neardup.classes(empty).count() == 0
    staged = neardup.stage(clashing)
    assert staged.columns == clashing.columns and staged.count() == 13  # of two ids that occur twice, one row each stays, and the row without an id
    hot = spark.createDataFrame([(i, "the very same words in every one of these texts") for i in range(500)], "doc_id long, text string")
    assert [(r["class_id"], r["n_copies"]) for r in neardup.classes(hot).distinct().select("class_id", "n_copies").distinct().collect()] == [(0, 500)]


# --- 3 main text


def found_words(text, known=None):
    """(words found and wanted, words found, words wanted) of a labelled page."""
    main = " ".join(re.sub(r"<[^>]*>", " ", x) for x in re.findall(f"{htmlpages.IN}(.*?){htmlpages.OUT}", text, re.S))
    want, got = Counter(html.unescape(main).split()), Counter(htmltext.main_text(re.sub(f"[{htmlpages.IN}{htmlpages.OUT}]", "", text), known).split())
    return (want & got).total(), got.total(), want.total()


@pytest.mark.parametrize("names", [True, False])
def test_held_out_pages(names):
    """Pages that were not learnt from; without class names, only elements, words, links and layout tell."""
    both, got, want = map(sum, zip(*(found_words(p) for p in htmlpages.pages(80, seed=77, names=names)), strict=True))
    assert both / got > 0.95 and both / want > 0.9


def naive_unshown(page, comments=False):
    """Of each element, whether it or one around it is not shown, or named as comments and without a title, if anything else is text."""
    def one(e):
        titled = "h1" in page.names[e.begin : e.end]
        return e.name in htmltext.UNSHOWN or (not comments and not titled and htmltext.named_comments(e))

    out = [one(e) for e in page.elements]
    for i, e in enumerate(page.elements[1:], 1):
        out[i] |= out[e.parent]
    if not comments and not any(t.split() and not n and not k and not out[o] for t, n, k, o in zip(page.texts, page.names, page.linked, page.of, strict=True)):
        return naive_unshown(page, comments=True)
    return out


def naive_features(page, i):
    """An element's features by walking through its tokens."""
    hidden = naive_unshown(page)
    unshown = hidden.__getitem__
    words = [0 if name or unshown(of) else len(t.split()) for t, name, of in zip(page.texts, page.names, page.of, strict=True)]
    linked = [n if link else 0 for n, link in zip(words, page.linked, strict=True)]
    e = page.elements[i]
    own = range(e.begin, e.end)
    n, links = sum(words[t] for t in own), sum(linked[t] for t in own)
    every = max(sum(words) - sum(linked), 1)
    before = sum(words[t] - linked[t] for t in range(e.begin)) / every
    after = 1 - (sum(words[t] - linked[t] for t in range(e.end))) / every
    stops = sum(len(re.findall(r"[.,;:!?](?:\s|$)", page.texts[t])) for t in own if words[t])
    steps = lambda x, *edges: sum(x > y for y in edges)
    out = set(htmltext._labels(e.name, e.attributes))
    out |= {f"links={steps(links / n, 0, 0.2, 0.5, 0.8)}", f"share={steps((n - links) / every, 0.02, 0.1, 0.25, 0.5, 0.75)}", f"size={steps(n, 5, 15, 40, 120)}", f"stops={steps(stops / n, 0, 0.04)}"}
    out |= {f"before={steps(before, 0.001, 0.05, 0.5, 0.95)}", f"after={steps(after, 0.001, 0.05, 0.5, 0.95)}"}
    if n - links <= 0.25 * every and e.name not in htmltext.TEXTUAL:
        out.add(f"small={e.name}")
    if any(page.names[t] in ("input", "button", "select", "textarea") for t in own):
        out.add("controls")
    if "h1" in (page.names[t] for t in own):
        out.add("titled")
    told = lambda ts: [page.texts[t].strip().lower() for t in ts if page.linked[t] and page.texts[t].strip() and not unshown(page.of[t])]
    every_link = Counter(told(range(len(page.texts))))
    often = max(every_link, key=lambda x: (every_link[x], x), default="")
    if 1 < (same := told(own).count(often)) > 0.6 * len(told(own)):
        out.add("repeated_link")
    up = e.parent
    while up > 0:
        if page.elements[up].name in ("article", "main"):
            out.add("in_article")
        up = page.elements[up].parent
    passed = 0
    for t in own:
        if words[t] and words[t] <= 40:
            for w in re.findall(r"©|[^\W\d_]+", html.unescape(page.texts[t]).lower()):
                if page.linked[t]:
                    out.add(f"linkword={w}")
                elif n <= 40 or passed < 6:
                    out.add(f"word={w}")
        passed += words[t]
    return out


def test_extraction_is_that_of_a_plain_version():
    known = htmltext.weights()
    for text in htmlpages.pages(16, seed=5) + ["<p>x<div class=ad>buy <b>this</b></div>y", "<a href=1>a</a> b <ul><li>c", "<div id=comments>only <a>these</a></div>"]:
        text = re.sub(f"[{htmlpages.IN}{htmlpages.OUT}]", "", text)
        page = htmltext.parse(text)
        judged = htmltext.Judged(page, known.lexicon)
        telling = lambda fs: {f for f in fs if f in known.features}
        hidden, gone = naive_unshown(page), [False] * len(page.elements)
        for i, e in enumerate(page.elements[1:], 1):
            gone[i] = gone[e.parent] or hidden[i]
            if not gone[i] and i in set(judged.candidates()):
                fs = naive_features(page, i)
                assert telling(fs) == telling(judged.features(i))
                plain = e.name in htmltext.TEXTUAL and not e.attributes
                if judged.share(i) > htmltext.ALWAYS:
                    continue
                if not plain or ("in_article" not in fs and any(f.startswith(("word=", "linkword=")) for f in telling(fs))):
                    gone[i] = known.features[""] + sum(known.features[f] for f in telling(fs)) > 0
        def link_list(i):
            words = [(len(page.texts[t].split()), page.linked[t]) for t in range(page.elements[i].begin, page.elements[i].end) if not page.names[t] and not hidden[page.of[t]]]
            return 2 * sum(n for n, k in words if k) > sum(n for n, _ in words)

        links = {i for i in set(page.listed) if i and link_list(i)}
        scores = [0.0 if gone[of] else known.tokens.get(htmltext._kind(page, t, links), -0.05) * (1 if page.names[t] else len(page.texts[t].split())) for t, of in enumerate(page.of)]
        sums = np.concatenate([[0], np.cumsum(scores)])
        out, begin, end = htmltext.region(judged, known)
        assert out == [gone[of] for of in page.of]
        assert math.isclose(sums[end] - sums[begin], max(0.0, (sums[None, :] - sums[:, None])[np.triu_indices(len(sums))].max()), abs_tol=1e-6)


SAID = [htmlpages.Maker(1000 + i).sentence(8, 14) for i in range(40)]
ITEMS = [" ".join(x.split()[:3]).strip(",") for x in SAID]


def by_hand(tag, name):
    """(page, its main text) of pages of another make than those that are learnt from: what an article may hold, and how short it may be beside other text."""
    def page(body):
        menu = "".join(f'<li><a href="/{x}">{x}</a></li>' for x in ("Home", "News", "About us", "Contact"))
        return f'<html><head><title>t</title></head><body><header class="site-header"><a href="/">The Daily</a></header><nav class="menu"><ul>{menu}</ul></nav>{body}<footer class="footer">© 2024 All rights reserved <a href=/p>Privacy</a></footer></body></html>'

    begin, end = f'<{tag}{name}>', f"</{tag}>"
    p, t = (lambda i: f"<p>{SAID[i]} {SAID[i + 1]}</p>"), (lambda i: f"{SAID[i]} {SAID[i + 1]}")
    listed = lambda of, items: f"<{of}>" + "".join(f"<li>{x}</li>" for x in items) + f"</{of}>"
    said = " ".join(" ".join(SAID).replace(",", "").replace(".", "").lower().split()[:300]).split()
    some = lambda n, at=0: " ".join(said[at : at + n])

    def comments(n, of, name="comment"):
        return f'<section{of}><h3>{n} Comments</h3>' + "".join(f'<div class="{name}"><b>Ann{i}</b> says <p>{some(24, 9 * i)}.</p> <a href=#r>Reply</a></div>' for i in range(n)) + "</section>"

    story, text = p(0) + p(2) + p(4), [t(0), t(2), t(4)]
    return [(page(body), "\n".join(want)) for body, want in (
        (f"{begin}<h1>A title here</h1>{p(0)}{listed('ul', ITEMS[:10])}{p(2)}{end}", ["A title here", t(0), *ITEMS[:10], t(2)]),
        (f"{begin}<h1>A title here</h1>{p(0)}{listed('ol', SAID[10:20])}{p(2)}{end}", ["A title here", t(0), *SAID[10:20], t(2)]),
        (f"{begin}<h1>A title here</h1>{p(0)}<dl>{''.join(f'<dt>{ITEMS[i]}</dt><dd>{SAID[20 + i]}</dd>' for i in range(10))}</dl>{p(2)}{end}", ["A title here", t(0), *(x for i in range(10) for x in (ITEMS[i], SAID[20 + i])), t(2)]),
        (f"{begin}<h1>A title here</h1>{p(0)}{''.join(f'<div>{x}</div>' for x in ITEMS[:30])}{p(2)}{end}", ["A title here", t(0), *ITEMS[:30], t(2)]),
        (f"{begin}<h1>A title here</h1><p>{some(25)}</p>{listed('ul', ITEMS)}{end}", ["A title here", some(25), *ITEMS]),
        (f"{begin}<h1>Steps to take</h1>{listed('ol', SAID[:8])}{end}", ["Steps to take", *SAID[:8]]),
        (f"{begin}<p>{some(12)}.</p>{end}{comments(2, ' class=comments')}", [some(12) + "."]),
        (f"{begin}<h1>A title</h1><p>{some(24)}.</p><p>{some(24, 30)}.</p>{end}{comments(6, ' id=comments')}", ["A title", some(24) + ".", some(24, 30) + "."]),
        (f"{begin}<h1>A title</h1>{p(0)}{p(2)}{comments(6, ' class=comment-list')}{end}", ["A title", t(0), t(2)]),
        (f"{begin}<h1>A title</h1>{p(0)}{end}{comments(9, ' class=discussion', 'item')}", ["A title", t(0)]),
        (f'{begin}<h1>A title</h1>{story}{end}<aside class="sidebar"><h3>About</h3><p>{SAID[30]} {SAID[31]} {SAID[32]}</p></aside>', ["A title", *text]),
        (f'<aside class="sidebar"><p>{SAID[30]} {SAID[31]}</p></aside>{begin}<h1>A title</h1>{story}{end}', ["A title", *text]),
        (f'{begin}<header><h1>A title of it</h1><p class="byline">By Ann Other</p></header>{story}{end}', ["A title of it", "By Ann Other", *text]),
        (f"{begin}<h1>A title</h1>{p(0)}<table>{''.join(f'<tr><td>{ITEMS[i]}</td><td>{i}</td></tr>' for i in range(10))}</table><pre>x = 1</pre>{p(2)}{end}", ["A title", t(0), *(f"{ITEMS[i]} {i}" for i in range(10)), "x = 1", t(2)]),
        (f"{begin}<p>{SAID[0]}</p>{end}", [SAID[0]]),
        (f'<div class="post comments-open has-comments">{begin}<h1>A title</h1>{story}{end}</div>', ["A title", *text]),
    )]


@pytest.mark.parametrize("tag", ["article", "div", "main"])
@pytest.mark.parametrize("name", ["", ' class="post"', ' id="story-body"'])
def test_pages_written_by_hand(tag, name):
    got = [(htmltext.main_text(page), want) for page, want in by_hand(tag, name)]
    counts = [(Counter(a.split()), Counter(b.split())) for a, b in got]
    both, found, wanted = (sum(x.total() for x in c) for c in ([a & b for a, b in counts], [a for a, _ in counts], [b for _, b in counts]))
    print(tag, name, f"exact {sum(a == b for a, b in got)} of {len(got)}, precision {both / found:.3f}, recall {both / wanted:.3f}")
    assert both / found > 0.97 and both / wanted > 0.97


STORY = [" ".join(htmlpages.Maker(i).sentence() for _ in range(4)) for i in range(10)]


@pytest.mark.parametrize("name", ["content with-sidebar", "has-sidebar", "page no-comments", "post share-enabled", "menu-page", "layout ad-free"])
def test_no_name_decides_alone(name):
    page = f'<html><body><nav><a href="/">Home</a> <a href="/b">News</a></nav><div class="{name}">{"".join(f"<p>{x}</p>" for x in STORY)}</div><footer>© us</footer></body></html>'
    assert htmltext.main_text(page) == "\n".join(" ".join(x.split()) for x in STORY)


def test_article_goes_on_after_a_list_of_links():
    links = "<ul>" + "".join(f'<li><a href="/x{i}">link number {i}</a></li>' for i in range(60)) + "</ul>"
    got = htmltext.main_text(f"<body><div>{''.join(f'<p>{x}</p>' for x in STORY[:5])}{links}{''.join(f'<p>{x}</p>' for x in STORY[5:])}</div></body>").split("\n")
    assert all(x in got for x in STORY)


def test_comments_and_copyright_without_names():
    tail = "<div>© 2023 Some Company. All rights reserved.</div><div><h3>3 Comments</h3><div><b>Anna</b> says<p>I liked this story.</p><a href=x>Reply</a></div></div>"
    assert htmltext.main_text(f"<body><div>{''.join(f'<p>{x}</p>' for x in STORY)}</div>{tail}</body>") == "\n".join(STORY)


def test_unclosed_elements_lose_nothing():
    page = f"<body><article><p>{STORY[0]}</p><div class='ad'>{'<b>' * 520}buy now</div>{''.join(f'<p>{x}</p>' for x in STORY[1:])}</article></body>"
    assert htmltext.main_text(page) == "\n".join(STORY)


@pytest.mark.parametrize("part", ["<![CDATA[", "<!--", "<a ", "<a '", "<a '>' ", "<p><b>", "<", "<a href='x", "<script>", "<div>", "</b>", "<li><p>", "</script <x"])
def test_time_in_proportion(part):
    def took(n):
        began = time.process_time()
        htmltext.main_text(part * n + '"')
        return time.process_time() - began

    htmltext.weights()
    assert took(40_000) < 12 * took(5_000) + 0.5


ARTICLE = "<article><h1>A &amp; B</h1><p>First  paragraph of the\nstory &lt;here&gt; goes on and on.</p>{}<p>Second one, with <b>bold</b>words, is the last of the story.</p></article>"


@pytest.mark.parametrize(
    "junk",
    [
        "", "<script>var x = '</p><p>no</p>';</script>", "<style>p { color: red }</style>", "<!-- <p>no</p> -->", "<aside>Side note</aside>", '<div class="ad">Buy now cheap cheap cheap</div>',
        '<div class="cookie-notice">We use cookies</div>', "<form><label>Mail</label><input><button>Go</button></form>", '<section id="comments"><p>Nice read, thanks for the story.</p></section>', "<nav><ul><li>Menu</li></ul></nav>",
        '<div role="complementary"><p>Related things</p></div>', "<noscript>Turn it on</noscript>", '<p class="newsletter-signup">Subscribe</p>', '<div hidden><p>secret</p></div>',
    ],
)
def test_parts_that_are_no_article(junk):
    page = f'<html><head><title>T</title></head><body><header>Site <a href="/">home</a></header><nav><a href="/a">One</a><a href="/b">Two</a></nav><div class="sidebar"><p>Popular now</p></div>{ARTICLE.format(junk)}<footer>&copy; us</footer></body></html>'
    assert htmltext.main_text(page) == "A & B\nFirst paragraph of the story <here> goes on and on.\nSecond one, with boldwords, is the last of the story."


@given(st.lists(st.floats(-5, 5).map(lambda x: round(x, 2)), max_size=40))
@settings(max_examples=200, deadline=None)
def test_best_run_has_the_highest_sum(scores):
    a, b = htmltext.best_run(scores)
    best = max([0.0, *(sum(scores[i:j]) for i in range(len(scores)) for j in range(i + 1, len(scores) + 1))])
    assert abs(sum(scores[a:b]) - best) < 1e-9


def test_main_text_odd_cases(spark):
    deep = "<div>" * 3000 + "deep down there are words" + "</div>" * 3000
    rows = [(1, "u", None), (2, None, ""), (3, "u", "   "), (4, "u", "no markup at all & < 5"), (5, "u", "<p>open <b>ended"), (6, "u", "<"), (7, "u", deep), (8, "u", "<p>" + "word " * 50_000), (8, "u", "<p>x"), (None, None, "<a href='x"), (9, "u", "<script>never closed <p>x")]
    got = htmltext.extract(spark.createDataFrame([(*r, 1) for r in rows], "page_id long, url string, html string, text int")).collect()
    assert len(got) == len(rows) and all(r["n_chars"] == len(r["text"]) for r in got)
    text = {i: r["text"] for i, r in enumerate(got)}
    assert text[0] == text[1] == text[2] == text[10] == "" and text[3] == "no markup at all & < 5" and text[4] == "open ended" and text[6] == "deep down there are words" and len(text[7].split()) == 50_000
    assert htmltext.extract(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


# --- 4 token counts


def brute_tokens(model, text):
    best = [(0, 0)]
    for j in range(1, len(text) + 1):
        n = len(text[j - 1].encode())
        ways = [(best[j - 1][0] + n * model.byte_cost, best[j - 1][1] + n)]
        ways += [(best[i][0] + model.cost[text[i:j]], best[i][1] + 1) for i in range(max(0, j - 40), j) if text[i:j] in model.cost]
        best.append(min(ways, key=lambda x: x[0]))
    return best[-1][1]


@given(st.lists(st.text(alphabet="abcé日😀", min_size=1, max_size=12), unique=True, max_size=12))
@settings(max_examples=80, deadline=None)
def test_trie_counts_are_the_cheapest_segmentations(texts):
    model = trietokens.Model(["a", "ab", "abc", "c", "bc", "cab", "é", "é日", "aa", "aaaa"])
    assert model.counts(texts).tolist() == [brute_tokens(model, t) for t in texts]


def brute_pieces(model, text):
    """The pieces of the cheapest segmentation."""
    best = [(0, [])]
    for j in range(1, len(text) + 1):
        ways = [(best[j - 1][0] + len(text[j - 1].encode()) * model.byte_cost, best[j - 1][1])]
        ways += [(best[i][0] + model.cost[text[i:j]], [*best[i][1], text[i:j]]) for i in range(max(0, j - 40), j) if text[i:j] in model.cost]
        best.append(min(ways, key=lambda x: x[0]))
    return best[-1][1]


@given(st.dictionaries(st.text(alphabet="abcé😀", min_size=1, max_size=12), st.integers(1, 9), max_size=12))
@settings(max_examples=60, deadline=None)
def test_pieces_are_counted_as_in_the_cheapest_segmentations(words):
    # unequal counts, so that no two segmentations cost the same
    model = trietokens.Model(["a", "ab", "abc", "c", "bc", "cab", "é", "aa", "aaaa"], np.array([131, 71, 17, 97, 37, 7, 53, 29, 11]))
    want = Counter()
    for text, n in words.items():
        for piece in brute_pieces(model, text):
            want[piece] += n
    got = model.piece_counts(list(words), np.array(list(words.values()), dtype=np.int64))
    long = "abcé😀cabaa" * 40
    assert model._alone(long) == (model._forward([long], None)[0][0], dict(Counter(brute_pieces(model, long))))
    assert dict(zip(model.pieces, got.tolist(), strict=True)) == {p: want[p] for p in model.pieces}


def test_token_counts(spark, odd, empty, clashing):
    path = vocabulary(trietokens.VOCABULARY)
    learnt, words = None, Counter(trietokens.MARK + w for _, t, *_ in odd_rows() for w in WORD.findall(t or ""))
    assert {r["word"]: r["n"] for r in trietokens.word_counts(clashing).collect()} == words
    for _ in range(trietokens.ROUNDS):
        model = trietokens.Model.of(path, learnt)
        learnt = model.piece_counts(list(words), np.array(list(words.values())))
    assert (trietokens.estimated(clashing, path) == learnt).all()
    model = trietokens.Model.of(path, learnt)
    got = sorted((r["doc_id"] or 0, r["n_words"], r["n_tokens"]) for r in trietokens.count(clashing, path).collect())
    tokens = {w: brute_tokens(model, w) for w in words if len(w) < 100}
    want = sorted((i or 0, len(WORD.findall(t or "")), sum(tokens[trietokens.MARK + w] for w in WORD.findall(t or ""))) for i, t, *_ in odd_rows() if i != 8)
    assert [x for x in got if x[0] != 8] == want
    assert trietokens.count(empty, path).count() == 0


def test_estimated_pieces_cost_less_than_equal_ones(spark):
    rng = random.Random(12)
    docs = spark.createDataFrame([(i, " ".join(rng.choice(("the", "theory", "there", "other", "bother", "them")) for _ in range(40))) for i in range(30)], "doc_id long, text string")
    path = vocabulary(trietokens.VOCABULARY)
    counts = trietokens.estimated(docs, path)
    share = (counts + trietokens.LEAST) / (counts + trietokens.LEAST).sum()
    cost = lambda p, c: -(c * np.log(p)).sum()
    first = trietokens.estimated(docs, path, rounds=1)
    assert cost(share, counts) < cost(np.full(len(share), 1 / len(share)), first) / 2 and counts.sum() <= first.sum() * 1.5


# --- 5 line dedup


def brute_lines(rows):
    seen, covered = {}, defaultdict(set)
    for i, t in sorted(rows):
        lines = t.split("\n")
        for p in range(len(lines) - 2):
            run = tuple(lines[p : p + 3])
            if WORD.search("".join(run)) and seen.setdefault(run, (i, p)) != (i, p):
                covered[i] |= {p, p + 1, p + 2}
    return {i: "\n".join(x for p, x in enumerate(t.split("\n")) if p not in covered[i]) for i, t in rows}


@given(st.lists(st.lists(st.sampled_from(["a", "b", "c", "", " "]), max_size=9).map("\n".join), max_size=6))
@settings(max_examples=12, deadline=None)
def test_line_dedup_is_that_of_a_plain_loop(spark, texts):
    rows = list(enumerate(texts))
    got = {r["doc_id"]: r["text"] for r in linededup.dedup_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == brute_lines(rows)


def test_line_dedup_odd_cases(spark, odd, empty, clashing):
    out = linededup.dedup_lines(odd)
    got = {}
    for r in out.collect():
        got.setdefault(r["doc_id"], []).append(r)
    assert out.count() == len(odd_rows()) and got[1][0]["text"] is None and got[1][0]["n_lines"] == 0 and got[9][0]["text"] == "same line" and got[9][0]["n_removed"] == 4
    assert [r["text"] for r in got[6]] == ["über straße 日本語 😀 naïve, é."] * 2 and got[None][0]["text"] == "no id at all"
    assert linededup.dedup_lines(empty).count() == 0 and linededup.stage(clashing).columns == clashing.columns
    again = spark.createDataFrame([(2, "a\nb\nc"), (1, "a\nb\nc"), (3, ""), (4, "a\nb\nc\nd")], "doc_id long, text string")
    assert {r["doc_id"]: r["text"] for r in linededup.stage(again).collect()} == {1: "a\nb\nc", 3: "", 4: "d"}


# --- 6 language model


def brute_model(train, order):
    """(counts of words, probability of a word after order - 1 others)."""
    words, grams = Counter(), {k: Counter() for k in range(1, order + 1)}
    for t in train:
        w = [*WORD.findall(fold(t or "")), "\0end"]
        words.update(w)
        padded = ["\0start"] * (order - 1) + w
        grams[order].update(tuple(padded[i : i + order]) for i in range(len(w)))
    for k in range(order - 1, 0, -1):
        grams[k].update(g[1:] for g in grams[k + 1])
    after, kinds = {k: Counter() for k in grams}, {k: defaultdict(lambda: [0, 0, 0]) for k in grams}
    for k, counted in grams.items():
        for g, n in counted.items():
            after[k][g[:-1]] += n
            kinds[k][g[:-1]][min(n, 3) - 1] += 1
    d = {k: lm.discounts([sum(v == i for v in c.values()) for i in (1, 2, 3, 4)]) for k, c in grams.items()}
    off = lambda n, x: 0 if not n else x[min(n, 3) - 1]

    def probability(gram):
        k = len(gram)
        low = probability(gram[1:]) if k > 1 else 1 / (len(words) + 1)
        total = after[k][gram[:-1]]
        if not total:
            return low
        return max(grams[k][gram] - off(grams[k][gram], d[k]), 0) / total + sum(x * n for x, n in zip(d[k], kinds[k][gram[:-1]], strict=True)) / total * low

    return words, probability


@pytest.mark.parametrize(("frequent", "order"), [(3, 2), (10**9, 2), (3, 3), (10**9, 4)])
def test_model_is_kneser_ney(spark, monkeypatch, frequent, order):
    monkeypatch.setattr(lm, "FREQUENT", frequent)
    monkeypatch.setattr(lm, "SHARD", 60)
    rng = random.Random(2)
    rows = [(i, prose(rng, rng.randrange(40), 6)) for i in range(60)] + [(60, "same " * 600), (61, None), (62, ""), (63, "Never SEEN words")]
    got = by_id(lm.perplexities(spark.createDataFrame(rows, "doc_id long, text string"), order))
    held = {i: zlib.crc32(str(i).encode()) % 10 == 0 for i, _ in rows}
    words, p = brute_model([t for i, t in rows if not held[i]], order)
    n, v = words.total(), len(words)
    for context in (["\0start"] * (order - 1), ["same"] * (order - 1)):
        assert abs(sum(p((*context, w)) for w in [*words, "\0unknown"]) - 1) < 1e-9
    for i, t in rows:
        w = [*WORD.findall(fold(t or "")), "\0end"]
        padded = ["\0start"] * (order - 1) + w
        r = got[i]
        assert (r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"]) == (held[i], len(w), sum(words[x] > 0 for x in w), n)
        assert math.isclose(r["base_score"], sum(math.log10((words[x] + 0.1) / (n + 0.1 * (v + 1))) for x in w), rel_tol=1e-9)
        assert math.isclose(r["score"], sum(math.log10(p(tuple(padded[j : j + order]))) for j in range(len(w))), rel_tol=1e-9, abs_tol=1e-12)


def test_a_model_without_one_of_its_files_does_not_score(spark):
    rng = random.Random(4)
    docs = spark.createDataFrame([(i, prose(rng, 60)) for i in range(40)], "doc_id long, text string")
    model = lm.fit(docs)
    folder = model.files.uri.removeprefix("file:").replace("///", "/")
    assert model.written == {x for x in os.listdir(folder) if not x.startswith(".")}
    assert lm.score(docs, model).count() == 40
    gone = sorted(model.written)[0]
    os.remove(f"{folder}/{gone}")
    with pytest.raises(Exception, match="a shard that was written is not there"):
        lm.score(docs, lm.Model(**{**model.__dict__, "files": Files(model.files.uri)})).collect()


def test_more_shards_than_files_may_be_open(tmp_path):
    """1500 shards in a process that may have 256 files open."""
    import resource

    files = Files(f"file://{tmp_path}/lm", most=100)
    keys = np.sort(W.mix(np.arange(20_000, dtype=np.uint64)))
    shard = (W.mix(keys) % W.U(1500)).astype(np.int64)
    for s in range(1500):
        mine = keys[shard == s]
        lm._write(files, f"known-{s}", mine, np.concatenate([(mine % W.U(1000)).astype(np.uint32), np.zeros(5 * len(mine), np.uint32)]))
    model = lm.Model(files, 2, 1500, np.zeros(1, W.U), 1, 1, 1, {2: (0.5, 0.5, 0.5)}, (0.5, 0.5, 0.5), 1.0, frozenset(f"{kind}-{s}" for kind in ("known", "grams2") for s in range(1500)))
    before = resource.getrlimit(resource.RLIMIT_NOFILE)
    resource.setrlimit(resource.RLIMIT_NOFILE, (256, before[1]))
    try:
        assert all((model.known(keys)[0] == (keys % W.U(1000)).astype(np.int64)).all() for _ in range(2)) and len(files.opened) <= 100
        assert files.read("nothing") is None
    finally:
        resource.setrlimit(resource.RLIMIT_NOFILE, before)


def test_model_odd_cases(spark, odd, empty, clashing):
    assert lm.perplexities(clashing).count() == len(odd_rows()) and lm.perplexities(empty).count() == 0
    held = next(i for i in range(1000) if zlib.crc32(str(i).encode()) % 10 == 0)
    only = lm.perplexities(spark.createDataFrame([(held, "nothing to learn from")], "doc_id long, text string")).first()
    assert only["train_tokens"] == only["n_known"] == 0 and only["base_score"] == 0 and only["score"] == 0


# --- 7 outliers


def brute_statistics(text):
    text = text or ""
    w = WORD.findall(text)
    where = defaultdict(list)
    for i in range(len(w) - 7):
        where[tuple(w[i : i + 8])].append(i)
    repeated = {j for v in where.values() if len(v) > 1 for i in v for j in range(i, i + 8)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated)


def test_statistics_and_verdicts(spark, odd, empty, clashing):
    rng = random.Random(4)
    rows = [(100 + i, prose(rng, rng.randrange(60, 90)), "en", "big", 0) for i in range(150)]
    rows += [(300, " ".join(f"***{w}$$$" for w in prose(rng, 70).split()), "en", "big", 0), (301, "ab cd " * 90, "en", "big", 0), (302, prose(rng, 25) + "\n" + prose(rng, 25), "en", "tiny", 0), (303, "word " * 12, "en", "big", 0)]
    every = spark.createDataFrame(odd_rows() + rows, SCHEMA)
    got = outliers.quality_verdicts(every).collect()
    texts = Counter((i, brute_statistics(t)) for i, t, *_ in odd_rows() + rows)
    assert Counter((r["doc_id"], (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"])) for r in got) == texts
    for r in got:
        assert r["base_failed"] == (r["n_words"] < 20 or 100 * r["n_repeat_words"] > 30 * r["n_words"]) and not (r["kept"] and r["base_failed"])
    one = by_id(outliers.quality_verdicts(every))
    assert all(one[100 + i]["kept"] for i in range(150)) and not one[300]["kept"] and one[301]["base_failed"]
    assert outliers.quality_verdicts(empty).count() == 0 and outliers.quality_verdicts(clashing).count() == len(odd_rows())


def numpy_mcd(x):
    """Squared distances by the same estimator in numpy, with exact halves."""
    n, p = x.shape
    least = np.array(outliers.LEAST_VARIANCE)
    q = np.quantile(x, (0.25, 0.5, 0.75), axis=0)
    scale = np.maximum((q[2] - q[0]) / 1.349, np.sqrt(least))
    u = (x - q[1]) / scale
    u = u / np.linalg.norm(u, axis=1)[:, None]
    distance = lambda m, c: np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
    found = []
    for m, c in ((q[1], np.diag(scale**2)), (x.mean(0), np.cov(x.T, bias=True) + np.diag(least)), (q[1], p * (u.T @ u) / n * np.outer(scale, scale) + np.diag(least))):
        for _ in range(outliers.STEPS):
            near = x[np.argsort(distance(m, c))[: (n + p + 1) // 2]]
            m, c = near.mean(0), outliers.HALF_FACTOR * np.cov(near.T, bias=True) + np.diag(least)
        found.append((np.linalg.slogdet(c)[1], m, c))
    _, m, c = min(found, key=lambda f: f[0])
    inside = x[distance(m, c) <= outliers.REWEIGHT]
    return distance(inside.mean(0), outliers.REWEIGHT_FACTOR * np.cov(inside.T, bias=True) + np.diag(least))


@pytest.mark.parametrize("junk", [0, 170])
def test_distances_are_those_of_numpy(spark, junk):
    rng = np.random.default_rng(0)
    x = rng.normal(size=(400, 5)) @ rng.normal(size=(5, 5))
    x[:junk] += 30  # up to 42 % of the rows lie apart
    vectors = spark.createDataFrame([("g", *map(float, r)) for r in x], "g string, x0 double, x1 double, x2 double, x3 double, x4 double")
    got = vectors.join(outliers.estimates(vectors, 5), "g").selectExpr("x0", f"{outliers._distance(5)} AS d").collect()
    want = dict(zip(x[:, 0].tolist(), numpy_mcd(x), strict=True))
    assert all(math.isclose(r["d"], want[r["x0"]], rel_tol=0.2, abs_tol=0.3) for r in got)
    assert all(want[v] > outliers.CUTOFF for v in x[:junk, 0].tolist()) and sum(r["d"] > outliers.CUTOFF for r in got) <= junk + 4


# --- 8 decontamination


def test_decontamination_is_that_of_brute_force(spark):
    rng = random.Random(9)
    items = [(i, prose(rng, n)) for i, n in enumerate((5, 6, 7, 9, 12, 20, 33, 60, 130, 4, 0))] + [(20, None), (None, "a b c d e f")]
    docs = []
    for i in range(60):
        w = prose(rng, rng.randrange(900)).split()
        item = items[rng.randrange(9)][1].split()
        for _ in range(rng.choice((0, 0, 1, 2, 4))):
            item[rng.randrange(len(item))] = "changed"
        at = rng.randrange(len(w) + 1)
        docs.append((i, " ".join(w[:at] + item + w[at:])))
    docs.append((60, " ".join(t for _, t in items if t)))
    docs += [(61 + j, f"{x} and {y}" if x else y) for j, (x, y) in enumerate(itertools.product(("", "before"), ("lone", "Two words", "three SHORT words", "three short", items[9][1], items[9][1].upper() + " after")))]
    items += [(30, "lone"), (31, "two words"), (32, "three short words")]
    runs = lambda t, k: {tuple(w[i : i + k]) for w in [WORD.findall(fold(t or ""))] for i in range(len(w) - k + 1)}
    size = lambda t: min(5, len(WORD.findall(t or "")))
    sh = lambda t: runs(t, size(t)) if size(t) else set()
    want = {d: sorted(i for i, t in items if i is not None and sh(t) and len(sh(t) & runs(x, size(t))) / len(sh(t)) >= 0.8) for d, x in docs}
    got = by_id(decontam.report(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")))
    assert {d: r["item_ids"] for d, r in got.items()} == want and sum(map(len, want.values())) > 20
    assert all(r["contaminated"] == bool(r["item_ids"]) for r in got.values())


def test_blocks_give_what_one_block_gives(spark, monkeypatch):
    rng = random.Random(1)
    items = spark.createDataFrame([(i, prose(rng, 30)) for i in range(40)], "item_id long, text string")
    docs = spark.createDataFrame([(i, prose(rng, 50) + " " + r["text"]) for i, r in enumerate(items.collect())], "doc_id long, text string")
    one = sorted(map(str, decontam.report(docs, items).collect()))
    monkeypatch.setattr(decontam, "BLOCK", 400)
    assert sorted(map(str, decontam.report(docs, items).collect())) == one
    monkeypatch.setattr(decontam, "BLOCK", 100)  # more blocks than are broadcast
    assert sorted(map(str, decontam.report(docs, items).collect())) == one


def test_decontamination_odd_cases(spark, odd, empty, clashing):
    items = spark.createDataFrame([(1, "same line same line same"), (1, "same line same line same")], "item_id long, text string")
    assert decontam.report(odd, items).where("contaminated").select("doc_id").collect()[0][0] == 9
    assert decontam.report(odd, items.limit(0)).where("contaminated").count() == 0 and decontam.report(empty, items).count() == 0
    staged = decontam.stage(clashing, items)
    assert staged.columns == clashing.columns and staged.count() == len(odd_rows()) - 1


# --- 9 secrets

ASSIGN = re.compile(r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)


def base_spans(text):
    found = [(m.start(), 0, m.end(), "assign") for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    found += [(m.start(), 1, m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    found += [(m.start(), 2, m.end(), "hex") for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32]
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(found)]


def secret_texts():
    rng = random.Random(8)
    parts = ["Token: ", 'api_key="', "PASSWD =", "apikey:'", "secret", "ſecret=abcdefghij", " ", "\n", "é😀", "AKIA", "AKIA" + "Z9" * 9, "deadbeef" * 4, "abc", "0123456789abcdef", "=", ":", '"', "token=ab secret: zzzzzzzzzz", "x" * 9, "password=short token:longenough1"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(1, 14))) for _ in range(300)]


def test_base_secrets_are_those_of_the_patterns(spark):
    rows = list(enumerate(secret_texts()))
    got = by_id(secrets.scan(spark.createDataFrame(rows, "doc_id long, text string")))
    for i, t in rows:
        want = base_spans(t)
        r = got[i]
        assert [x for x in r["spans"].split(",") if x and not x.startswith("random")] == want
        assert r["base_sha256"] == hashlib.sha256(",".join(want).encode()).hexdigest()
        assert (r["n_assign"], r["n_access"], r["n_hex"]) == tuple(sum(x.startswith(k) for x in want) for k in ("assign", "access", "hex"))


B62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"


def brute_battery(encoding, token):
    """(p_chi, p_runs, p_serial) of a string, straight from the tests' definitions."""
    alphabet = secrets.ENCODINGS[encoding][0]
    bare = token.rstrip("=")
    x = [alphabet.index(c) for c in (bare.lower() if encoding in secrets.FOLDED else bare.replace("-", "+").replace("_", "/"))]
    n, size = len(x), len(alphabet)
    tail = lambda z: 1 / (1 + math.exp(min(700, 1.5976 * z + 0.07056 * z**3)))
    k = 8 if n >= 40 else 4
    expected = [n * sum(s * k // size == c for s in range(size)) / size for c in range(k)]
    chi = sum((sum(v * k // size == c for v in x) - e) ** 2 / e for c, e in enumerate(expected))
    f = k - 1
    p_chi = tail(((chi / f) ** (1 / 3) - (1 - 2 / (9 * f))) / math.sqrt(2 / (9 * f)))
    high = [v >= size / 2 for v in x]
    ones, zeros = sum(high), n - sum(high)
    spread = 2 * ones * zeros * (2 * ones * zeros - n) / (n * n * (n - 1))
    z = (1 + sum(a != b for a, b in zip(high, high[1:], strict=False)) - 1 - 2 * ones * zeros / n) / math.sqrt(spread) if spread > 0 else 9
    mean = sum(x) / n
    power = sum((v - mean) ** 2 for v in x)
    r = (sum((a - mean) * (b - mean) for a, b in zip(x, x[1:], strict=False)) / power + 1 / n) * math.sqrt(n) if power else 9
    return p_chi, min(1, 2 * tail(abs(z))), min(1, 2 * tail(abs(r)))


def test_battery_is_that_of_the_definitions(spark):
    rng = random.Random(3)
    rows = [(e, "".join(rng.choice({"base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"}.get(e, a)) for _ in range(rng.randrange(16, 120)))) for e, (a, _) in secrets.ENCODINGS.items() for _ in range(6)]
    rows += [("base64", "a" * 20), ("base36", "internationalization2024"), ("base32", "ABCDEFGHIJKLMNOPQR==")]
    for r in secrets.battery(spark.createDataFrame(rows, "encoding string, token string")).collect():
        want = brute_battery(r["encoding"], r["token"])
        assert all(math.isclose(r[c], w, rel_tol=1e-6, abs_tol=1e-12) for c, w in zip(("p_chi", "p_runs", "p_serial"), want, strict=True)) and math.isclose(r["p"], min(1, 3 * min(want)), rel_tol=1e-6, abs_tol=1e-12)


def test_thresholds_are_those_of_the_step_up(spark):
    rng = random.Random(4)
    tested = [("hex", c, rng.random() ** rng.choice((1, 1, 12))) for c in (0, 1, 2) for _ in range(60)]
    null = [("hex", c, rng.random() ** 90) for c in (0, 1) for _ in range(400)] + [("hex", 2, 1e-9)] * 10
    make = lambda rows: spark.createDataFrame(rows, "encoding string, length_class int, p double")
    got = {r["length_class"]: r["least"] for r in secrets.thresholds(make(tested), make(null)).collect()}
    want = {}
    of_bin = lambda p: math.floor(math.log2(max(p, 1e-12)) * secrets.BINS)
    for c in (0, 1, 2):
        mine, other = ([of_bin(p) for _, k, p in rows if k == c] for rows in (tested, null))
        p = sorted(((1 + sum(o >= b for o in other)) / (1 + len(other)), b) for b in mine)
        kept = [b for i, (q, b) in enumerate(p, 1) if q <= secrets.RATE * max(j for j, (v, _) in enumerate(p, 1) if v == q) / len(p)]
        if kept:
            want[c] = min(kept)
    assert got == want and set(got) == {0, 1}


def test_random_strings_are_found_and_others_not(spark):
    """Keys outside the base patterns, in prose: those of 32 symbols and more are found, names and long words are left alone."""
    rng = random.Random(6)
    words = [("".join(rng.choice(("ba", "co", "di", "el", "fo", "ga", "he", "in", "jo", "ka", "li", "mo", "ne", "or", "pa")) for _ in range(rng.randrange(1, 6)))) for _ in range(500)]
    text = lambda n: " ".join(rng.choice(words) for _ in range(n))
    draw = lambda alphabet, n: "".join(rng.choice(alphabet) for _ in range(n))
    plain = ["internationalization_of_everything_2024", "aaaaaaaaaaaaaaaaaaaaaaaaaaaaaa1", "11111111112222222222333333333344444a", "x" * 200 + "1", "getAllElementsByTagNameAndClass2"]
    rows = []
    for i in range(1200):
        key = draw((B62, B62 + "+/", B62[:10] + B62[36:])[i % 3], rng.choice((32, 40, 64))) if i % 8 == 0 else plain[i // 8 % len(plain)] if i % 8 == 4 else None
        rows.append((i, text(30) + (f" {key} " if key else " ") + text(30), key))
    got = by_id(secrets.scan(spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string"), each=4))
    reported = {i: [t[int(a) : int(b)] for x in got[i]["spans"].split(",") if x for _, a, b in [x.split(":")]] for i, t, _ in rows}
    planted = {i: k for i, _, k in rows if i % 8 == 0}
    hits = sum(planted[i] in reported[i] for i in planted)
    false = {t for i, v in reported.items() for t in v if t != planted.get(i)}
    assert hits >= 0.85 * len(planted) and len(false) <= 0.1 * hits


def test_candidates_do_not_touch_base_spans(spark):
    key = "0123456789abcdef" * 3
    rows = [(i, f"token = {key}zz{key[:9]}QRS and more words here {i}") for i in range(3)]
    out = secrets.scan(spark.createDataFrame(rows, "doc_id long, text string"), rate=1.0, each=40).collect()
    assert all("random" not in r["spans"] and r["n_assign"] == 1 for r in out)


def test_secrets_odd_cases(spark, odd, empty, clashing):
    got = secrets.scan(clashing).collect()
    assert len(got) == len(odd_rows()) and secrets.scan(empty).count() == 0
    for i in (1, 2):
        r = next(r for r in got if r["doc_id"] == i)
        assert r["spans"] == "" and r["base_sha256"] == hashlib.sha256(b"").hexdigest()
    many = spark.createDataFrame([(1, "token=abcdefgh1 " * 20_000)], "doc_id long, text string")
    assert secrets.scan(many).first()["n_assign"] == 20_000


# --- 10 packing


def test_best_fit_decreasing_is_that_of_a_plain_loop():
    rng = random.Random(7)
    for _ in range(20):
        lengths = sorted((rng.randrange(1, 65) for _ in range(200)), reverse=True)
        where, offset = packing.best_fit_decreasing(lengths, 64)
        rooms = []
        for n, w, o in zip(lengths, where, offset, strict=True):
            fits = [r for r in rooms if r >= n]
            room = min(fits) if fits else 64
            assert 64 - o == room and w <= len(rooms)
            if fits:
                rooms.remove(room)
            rooms.append(room - n) if room - n or not fits else rooms.append(0)
        used = Counter()
        for n, w, o in zip(lengths, where, offset, strict=True):
            assert used[w] == o
            used[w] += n
        assert max(used.values()) <= 64


def test_packing_round_trip(spark, odd, empty, clashing):
    from tokenizers import Tokenizer

    path = vocabulary(packing.VOCABULARY)
    tokenizer = Tokenizer.from_file(path)
    rng = random.Random(11)
    rows = [(i, t) for i, t, *_ in odd_rows()] + [(100 + i, "It's " + prose(rng, rng.randrange(1200)) + ", don't. X.Y., 3.5, ...") for i in range(40)]
    want = Counter((i, tuple([*tokenizer.encode(t or "", add_special_tokens=False).ids, 2])) for i, t in rows)
    packed = packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), path, with_ids=True).collect()
    for r in packed:
        ids = np.array(r["ids"], dtype="<u4")
        assert r["length"] == len(ids) <= 4096 and r["ids_crc32"] == zlib.crc32(ids.tobytes())
    by_doc = defaultdict(list)
    for r in packed:
        by_doc[r["doc_id"], r["doc_tokens"]].append(r)
    for (i, n), pieces in by_doc.items():
        copies = sum(c for (j, ids), c in want.items() if j == i and len(ids) == n)
        assert sum(r["length"] for r in pieces) == n * copies
        if copies == 1:
            pieces.sort(key=lambda r: r["start"])
            assert (i, tuple(x for r in pieces for x in r["ids"])) in want and [r["start"] for r in pieces] == [sum(q["length"] for q in pieces[:k]) for k in range(len(pieces))]
    in_sequence = defaultdict(list)
    for r in packed:
        in_sequence[r["sequence_id"]].append((r["offset"], r["length"]))
    for parts in in_sequence.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 4096
    assert packing.pack(empty, path).count() == 0 and packing.pack(clashing, path).count() >= len(odd_rows())
    filled = packing.sequences(packing.pack(spark.createDataFrame(rows, "doc_id long, text string"), path)).collect()
    assert all(r["padding"] == (0 if r["n_tokens"] & (r["n_tokens"] - 1) == 0 else 4096 - r["n_tokens"]) for r in filled)
