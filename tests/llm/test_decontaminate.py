import random
import re

import numpy as np
import pytest

from pathloom.llm import decontaminate as dc
from pathloom.llm.common import table
from tests.llm.cases import DOCS, clashing, odd_rows

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
BENCH = "item_id long, text string"


def brute(texts, items, size=13):
    windows = {}
    for i, t in items:
        w = WORD.findall((t or "").translate(LOWER))
        n = min(size, len(w))
        for a in range(len(w) - n + 1 if w else 0):
            windows.setdefault(tuple(w[a:a + n]), set()).update(() if i is None else (str(i),))
    out = []
    for d, t in texts:
        w = WORD.findall((t or "").translate(LOWER))
        hit, found = set(), set()
        for n in {len(p) for p in windows}:
            for a in range(len(w) - n + 1):
                if tuple(w[a:a + n]) in windows:
                    hit |= set(range(a, a + n))
                    found |= windows[tuple(w[a:a + n])]
        out.append((d, len(w), tuple(sorted(hit)), tuple(sorted(found))))
    return sorted(out, key=str)


def got(df):
    return sorted(((r.doc_id, r.n_words, tuple(h.word for h in r.hits), tuple(r.items)) for r in df.collect()), key=str)


def random_case(seed):
    rng = random.Random(seed)
    vocabulary = ["a", "B", "c", "dé", "日本", "z9", "É"][:rng.randint(2, 7)]

    def text(n):
        return "".join(rng.choice(vocabulary) + rng.choice([" ", ", ", "\n", "-"]) for _ in range(n))

    items = [(i, text(rng.choice([0, 1, 2, 5, 13, 14, 20]))) for i in range(rng.randint(0, 5))] + [(99, None)]
    texts = [(i, text(rng.choice([0, 1, 3, 20, 60])) + rng.choice(["", "xx "]) + (rng.choice(items)[1] or ""))
             for i in range(rng.randint(1, 8))] + [(77, None)]
    return texts, items


def test_index_finds_all_places():
    rng = np.random.default_rng(1)
    for _ in range(30):
        top = int(rng.integers(1, 6))
        seq = rng.integers(0, top + 1, 80)
        seq = seq[np.concatenate([[seq[0] != 0], (seq[1:] != 0) | (seq[:-1] != 0)])]
        seq = np.append(seq[seq.argmax():] if seq.any() else [1], 0)
        index = dc.FMIndex(seq, top)
        for size in (1, 2, 3):
            phrases = rng.integers(1, top + 1, (5, size))
            for p, a, b in zip(phrases, *index.search(phrases)):
                want = [i for i in range(len(seq) - size + 1) if (seq[i:i + size] == p).all()]
                assert sorted(index.locate(np.arange(a, b)).tolist()) == want


@pytest.mark.parametrize("seed", range(4))
def test_random_texts(make, seed):
    texts, items = random_case(seed)
    found = dc.find_contamination(make("doc_id long, text string", texts), make(BENCH, items))
    assert got(found) == brute(texts, items)


def test_many_blocks_give_the_same(make):
    texts, items = random_case(11)
    items = [*items, (5, "a B c"), (6, "c c")]
    docs, bench = make("doc_id long, text string", texts + texts[:2]), make(BENCH, items + items[:1])
    assert got(dc.find_contamination(docs, bench, block_bytes=20)) == brute(texts + texts[:2], items)


def test_spans_are_code_points_and_the_verdict_a_twentieth(make):
    bench = make(BENCH, [(1, "eins zwei dréi vier")])
    docs = make("doc_id long, text string", [(1, "é😀 eins, ZWEI dréi; vier eins zwei dréi vier! ende"),
                                             (2, "x " * 76 + "eins zwei dréi vier"), (3, "x " * 77 + "eins zwei dréi vier")])
    found = dc.judged(dc.find_contamination(docs, bench)).withColumn("spans", dc.removal_spans("hits"))
    rows = {r.doc_id: r for r in found.collect()}
    text = "é😀 eins, ZWEI dréi; vier eins zwei dréi vier! ende"
    assert [text[s.start:s.end] for s in rows[1].spans] == ["eins, ZWEI dréi; vier eins zwei dréi vier"]
    assert [rows[i].contaminated for i in (1, 2, 3)] == [True, True, False]


def test_whole_table(spark):
    sf = "/root/testdata/sf0.001"
    docs, bench = table(spark, sf, "documents"), table(spark, sf, "benchmark")
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in bench.collect()])
    assert got(dc.find_contamination(docs, bench)) == want


def test_odd_rows(make):
    rows = odd_rows()
    docs, none = make(DOCS, rows), make(DOCS, [])
    items = [(1, "same text of a few words here"), (None, "a"), (2, ""), (3, None), (1, "x")]
    bench = make(BENCH, items)
    want = brute([r[:2] for r in rows], items)
    for t in (docs, clashing(docs)):
        assert got(dc.find_contamination(t, clashing(bench))) == want
    assert dc.find_contamination(none, bench).count() == 0
    assert got(dc.find_contamination(docs, make(BENCH, []))) == brute([r[:2] for r in rows], [])


def test_items_without_a_name_make_hits(make):
    passage = " ".join(f"word{i}x" for i in range(20))
    docs = [(1, passage), (2, "none of it"), (3, passage + " and more " + "y " * 400)]
    items = [(None, passage), (5, "a passage of its own that nobody has"), (None, None)]
    found = dc.find_contamination(make("doc_id long, text string", docs), make(BENCH, items))
    assert got(found) == brute(docs, items)
    assert {r.doc_id: (r.n_hit, r.contaminated, r.items) for r in dc.judged(found).collect()} == {
        1: (20, True, []), 2: (0, False, []), 3: (20, False, [])}
    blocks = dc.find_contamination(make("doc_id long, text string", docs), make(BENCH, items), block_bytes=10)
    assert got(blocks) == brute(docs, items)
