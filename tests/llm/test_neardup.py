import itertools
import random
import re

import pytest

from pathloom.llm import neardup
from pathloom.llm.neardup import Rule
from tests.llm.cases import DOCS, clashing, odd_rows, words

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOWER))
    if not w:
        return frozenset()
    return frozenset(tuple(w[i:i + k]) for i in range(len(w) - k + 1)) if len(w) >= k else frozenset([tuple(w)])


def brute(rows, rule):
    """(id, size, least id reachable) by comparing all pairs; rows with one id are one document."""
    sets = [(i, shingles(t, rule.words)) for i, t in rows]
    root = {i: i for i, _ in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (i, a), (j, b) in itertools.combinations([s for s in sets if s[0] is not None and s[1]], 2):
        if 100 * len(a & b) >= rule.percent * len(a | b):
            x, y = find(i), find(j)
            root[max(x, y)] = min(x, y)
    return sorted(((i, len(s), i if i is None or not s else find(i)) for i, s in sets), key=str)


def edited(rng, text, n):
    w = text.split(" ")
    for _ in range(n):
        w[rng.randrange(len(w))] = f"e{rng.randrange(10**6)}"
    return " ".join(w)


def corpus(seed=0):
    rng = random.Random(seed)
    texts = []
    for _ in range(12):  # families of near copies, some of them chains
        base = words(rng, rng.choice([3, 40, 120, 300]))
        texts += [base, base.upper(), "  " + base.replace(" ", "\n", 1)]
        now = base
        for _ in range(rng.randrange(8)):
            now = edited(rng, now, max(1, len(now.split(" ")) // 80))
            texts.append(now)
        texts += [edited(rng, base, max(1, len(base.split(" ")) // k)) for k in (200, 60, 25, 10)]
    common = words(rng, 60)  # a passage many share
    texts += [common + " " + words(rng, rng.choice([5, 20, 60, 200])) for _ in range(40)]
    texts += ["a", "A", "a b", "a  B", "b a", "", None, " "]
    rng.shuffle(texts)
    return list(enumerate(texts))


def got(df):
    out = df.collect()
    assert all(r.kept == (r.doc_id == r.component_id) for r in out)
    return sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=str)


@pytest.mark.parametrize("rule", [Rule(3, 85), Rule()])
def test_equals_all_pairs(make, rule):
    rows = corpus()
    assert got(neardup.near_duplicates(make("doc_id long, text string", rows), rule)) == brute(rows, rule)


def test_small_slices_and_blocks_lose_no_link(make, monkeypatch):
    for name, value in (("SLICE", 2), ("BLOCK", 3), ("QUERY", 2), ("CELL", 2), ("CALL", 5)):
        monkeypatch.setattr(neardup, name, value)
    rng = random.Random(9)
    base = words(rng, 150)
    rows = [(i, edited(rng, base, rng.choice([0, 1, 2, 3, 4, 6]))) for i in range(60)]
    rule = Rule(3, 85)
    assert got(neardup.near_duplicates(make("doc_id long, text string", rows), rule)) == brute(rows, rule)


def test_components_of_paths_stars_and_random_graphs(make):
    rng = random.Random(1)
    edges = [(i, i + 1) for i in range(100, 160)] + [(7, i) for i in range(200, 260)] \
        + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)] + [(5, 5)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    found = {r.node: r.component for r in neardup.components(make("a long, b long", edges)).collect()}
    assert found == {x: find(x) for x in root if find(x) != x}


def test_odd_rows(make):
    rows = odd_rows()
    docs = make(DOCS, rows)
    for t in (docs, clashing(docs)):
        out = neardup.near_duplicates(t, Rule(3, 85)).collect()
        want = brute([r[:2] for r in rows], Rule(3, 85))
        assert sorted(((r.doc_id, r.n_shingles, r.component_id) for r in out), key=str) == want
        assert all(r.kept for r in out if r.doc_id is None)
    assert neardup.near_duplicates(make(DOCS, [])).count() == 0


def test_one_id_with_two_texts_links_both(make):
    rng = random.Random(2)
    a, b = words(rng, 50), words(rng, 50, 5000)
    rows = [(1, a), (4, b), (9, a), (9, b)]
    out = neardup.near_duplicates(make("doc_id long, text string", rows), Rule()).collect()
    assert {r.component_id for r in out} == {1}


def test_only_texts_of_candidates_are_moved(spark, make, monkeypatch):
    rows = spark.range(20_000).selectExpr("id AS node", "concat('text ', id) AS text")
    ids = spark.range(0, 20_000, 40).toDF("node")
    for words, others in ((neardup.SIEVE, 600), (1, 20_000)):
        monkeypatch.setattr(neardup, "SIEVE", words)
        passed = neardup.sieved(rows, ids)
        found = {r.node for r in passed.collect()}
        assert found >= set(range(0, 20_000, 40)) and len(found) <= 500 + others
        assert passed.columns == ["node", "text"] and passed.count() == len(found)
    texts = make("doc_id long, text string", [(1, "a"), (1, "a"), (1, "b"), (2, "c"), (None, "d")])
    out = neardup.texts_of(make("node long", [(1,), (3,)]), texts, "doc_id", "text")
    assert sorted(map(tuple, out.collect())) == [(1, "a"), (1, "b")]
    assert neardup.sieved(rows, ids.where("node < 0")).count() == 0


def test_the_filter_comes_before_the_exchange_of_texts(make, monkeypatch):
    plans = []
    staged = neardup.staged

    def watched(df, name):
        if name == "dup_texts":
            plans.append(df._jdf.queryExecution().optimizedPlan().toString())
        return staged(df, name)

    monkeypatch.setattr(neardup, "staged", watched)
    text = " ".join(map(str, range(40)))
    docs = make("doc_id long, text string", [(1, text), (2, text + " z"), (3, "another one of a few words")])
    pairs = make("a long, b long", [(1, 2)])
    assert list(map(tuple, neardup.confirmed(pairs, docs, Rule(3, 85), "doc_id", "text").collect())) == [(1, 2)]
    outer, inner = [line for line in plans[0].splitlines() if "Join " in line]
    assert "strategy=broadcast" in inner and "strategy=broadcast" not in outer
