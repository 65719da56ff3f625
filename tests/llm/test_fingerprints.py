import hashlib
import random
import struct
from collections import Counter

import xxhash

from pathloom.llm import fingerprints as fp
from pathloom.llm.common import table
from tests.llm.cases import DOCS, clashing, odd_rows, words


def signed(x):
    return struct.unpack("<q", struct.pack("<Q", x & (2**64 - 1)))[0]


def of_text(s):
    return signed(xxhash.xxh64(s.encode(), seed=42).intdigest())


def of_longs(values):
    h = 42
    for v in values:
        h = xxhash.xxh64(struct.pack("<q", v), seed=h & (2**64 - 1)).intdigest()
    return signed(h)


def split(text):
    import re

    return [w for w in re.split(r"[ \t\n\x0b\f\r]+", text or "") if w]


def anchors(text):
    w = [of_text(x) for x in split(text)]
    s = [of_longs(w[i:i + fp.S]) for i in range(len(w) - fp.S + 1)]
    inner = fp.K - fp.S + 1
    out = []
    for i in range(len(s) - inner + 1):
        part = s[i:i + inner]
        if min(part) in (part[0], part[-1]):
            out.append((i, of_longs(part)))
    if not out and w:
        h = 42
        for x in w:
            h = xxhash.xxh64(struct.pack("<q", x), seed=h & (2**64 - 1)).intdigest()
        out = [(0, signed(h))]
    return out


def printed(found):
    return ",".join(f"{pos}:{h & (2**64 - 1):x}" for pos, h in found)


def placed(a, b):
    places = [{}, {}]
    for side, anchors_ in enumerate((a, b)):
        for pos, h in anchors_:
            places[side].setdefault(h, []).append(pos)
    pairs = Counter(y - x for h, xs in places[0].items() for x, y in zip(xs, places[1].get(h, [])))
    votes = sorted((-n, o) for o, n in pairs.items() if n >= min(fp.AGREE, len(a), len(b)))
    n = -sum(v for v, _ in votes)
    whole = len(a) + len(b) - n
    return n, votes[0][1] if votes else None, n / whole if whole else 1.0


def brute(rows):
    rows = sorted(rows, key=lambda r: r[0])
    out = {}
    for i, (d, t) in enumerate(rows):
        t, nxt = t or "", rows[(i + 1) % len(rows)][1] or ""
        half = len(t) // 2
        e = t[:len(t) - half] + nxt[:half]
        out[d] = (len(t), hashlib.sha256(e.encode()).hexdigest(), printed(anchors(t)), printed(anchors(e)),
                  placed(anchors(t), anchors(e))[2], placed(anchors(t), anchors(nxt))[2])
    return out


def got(df):
    return {r.doc_id: (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint, r.near_edited, r.near_next)
            for r in df.collect()}


def test_equals_a_plain_reading(make):
    rng = random.Random(3)
    rows = [(rng.randrange(10**9), words(rng, rng.randrange(120)) + rng.choice(["", "\n", " é日"])) for _ in range(200)]
    rows += [(10**10 + i, t) for i, t in enumerate(["", None, "a", "a b c d", "a b c d e", "a b c d e f g h i j"])]
    assert got(fp.fingerprint_edits(make("doc_id long, text string", rows))) == brute(rows)


def test_whole_table(spark):
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    assert got(fp.fingerprint_edits(docs)) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_anchors_do_not_depend_on_their_surroundings(make):
    rng = random.Random(4)
    middle = words(rng, 60)
    rows = [(i, f"{words(rng, i)} {middle} {words(rng, 5)}") for i in range(5)]
    df = fp.with_anchors(make("doc_id long, text string", rows), "text", "anchors")
    want = {h for _, h in anchors(middle)}
    for r in df.collect():
        there = {(a.pos - r.doc_id, a.hash) for a in r.anchors}
        assert want <= {h for _, h in there} and {(p, h) for p, h in anchors(middle)} <= there


def test_next_over_many_ranges(make):
    rows = [(i * 7 % 101, f"t{i}") for i in range(101)]
    for parts in (1, 2, 40, 400):
        df = fp.with_next(make("doc_id long, text string", rows), "doc_id", ["text"], parts)
        text = dict(rows)
        assert {r.doc_id: r.next_text for r in df.collect()} == {d: text[(d + 1) % 101] for d in text}


def test_odd_rows(make):
    rows = odd_rows()
    docs = make(DOCS, rows)
    for t in (docs, clashing(docs)):
        out = fp.fingerprint_edits(t).collect()
        assert len(out) == len(rows)
        byid = {}
        for r in out:
            byid.setdefault(r.doc_id, set()).add(r.fingerprint)
        for r in rows:
            assert printed(anchors(r[1])) in byid[r[0]]
    assert fp.fingerprint_edits(make(DOCS, [])).count() == 0
    one = fp.fingerprint_edits(make(DOCS, [(1, "a b c d e f g", None, None, None)])).first()
    assert one.near_next == 1.0


def test_all_anchors_match_by_place(make):
    rng = random.Random(5)
    passage = words(rng, 60, 10**6)
    rows = [(i, f"{words(rng, rng.randrange(90), 30)} {passage if i % 2 else ''}") for i in range(60)]
    rows += [(100 + i, t) for i, t in enumerate(["", None, "a", "a b", "a b", "a " * 300, "a " * 250, "b " + "a " * 99])]
    text = [t or "" for _, t in rows]
    for i, r in enumerate(fp.fingerprint_edits(make("doc_id long, text string", rows)).orderBy("doc_id").collect()):
        nxt = text[(i + 1) % len(text)]
        half = len(text[i]) // 2
        edited = text[i][:len(text[i]) - half] + nxt[:half]
        assert [tuple(a) for a in r.anchors] == anchors(text[i])
        assert [tuple(a) for a in r.edited_anchors] == anchors(edited)
        assert tuple(r.placed_edited) == placed(anchors(text[i]), anchors(edited)), text[i]
        assert tuple(r.placed_next) == placed(anchors(text[i]), anchors(nxt)), text[i]


def test_a_passage_shared_by_long_texts_is_found_at_its_offset(make):
    rng = random.Random(6)
    passage = words(rng, 300, 10**6)
    rows = [(1, f"{words(rng, 5000, 10**6)} {passage} {words(rng, 14700, 10**6)}"),
            (2, f"{words(rng, 12000, 10**6)} {passage} {words(rng, 7700, 10**6)}")]
    r = fp.fingerprint_edits(make("doc_id long, text string", rows)).where("doc_id = 1").first()
    assert len(r.anchors) > 5000 and r.placed_next.offset == 7000 and r.placed_next.matched >= len(anchors(passage))
    assert r.placed_next.likeness > 0
