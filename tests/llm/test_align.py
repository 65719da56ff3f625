import hashlib
import random
from collections import Counter
from itertools import accumulate

import public_tokenizers
import pyarrow as pa
import pytest

from pathloom.llm import align, queries
from tests.llm.cases import DOCS, clashing, odd_rows, words
from tests.llm.test_tokens import mixed_texts

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def plain():
    """text -> (ids of A, ids of B, token bytes of each) of the whole text, by the libraries"""
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(A)
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=B)

    def bytes_of_b(i):
        p = b.id_to_piece(i)
        return bytes([int(p[3:-1], 16)]) if p.startswith("<0x") and b.is_byte(i) else p.replace("\u2581", " ").encode()

    def run(text):
        if not text:
            return [], [], [], []
        enc = a.encode(" " + text, add_special_tokens=False)
        letters = align.byte_of_letter()
        own = [bytes(letters[c] for c in t) for t in enc.tokens]
        ids = b.encode(text)
        other = [bytes_of_b(i) for i in ids]
        raw = (" " + text).encode()
        return (enc.ids, ids, own, other) if b"".join(own) == raw == b"".join(other) else ([], [], [], [])

    return run


def ends(raw):
    return [*accumulate(map(len, raw))]


def texts_of(own, texts):
    """(tokens of A and of B, groups, links) of each text, None without tokens"""
    n_a, n_b, groups, links, sizes = own.texts(pa.array(texts, pa.string()))
    stops = sizes.cumsum().tolist()
    return [(int(a), int(b), g, links[e - n:e].tolist()) if a else None
            for a, b, g, n, e in zip(n_a, n_b, groups.to_pylist(), sizes.tolist(), stops)]


def brute(texts, plain):
    """Every link by comparing the end of each token with the end of each other token."""
    parts = []
    for t in texts:
        ids_a, ids_b, raw_a, raw_b = plain(t)
        end_a = [sum(map(len, raw_a[:i + 1])) for i in range(len(raw_a))] if len(raw_a) < 400 else ends(raw_a)
        end_b = [sum(map(len, raw_b[:i + 1])) for i in range(len(raw_b))] if len(raw_b) < 400 else ends(raw_b)
        at_b = {e: j for j, e in enumerate(end_b)}
        links = [(i, at_b[e]) for i, e in enumerate(end_a) if e in at_b]
        cuts = [(-1, -1), *links]
        groups = ";".join(",".join(map(str, ids_a[i + 1:k + 1])) + "|" + ",".join(map(str, ids_b[j + 1:m + 1]))
                          for (i, j), (k, m) in zip(cuts, links))
        parts.append((len(ids_a), len(ids_b), groups, [(ids_a[i], ids_b[j]) for i, j in links]))
    count = Counter(p for *_, links in parts for p in links)
    best = {}
    for (_, b), n in count.items():
        best[b] = max(best.get(b, 0), n)
    return [(a, b, len(links), len(links), sum(count[p] == best[p[1]] for p in links), sum(count[p] for p in links),
             hashlib.sha256(g.encode()).hexdigest() if links else "") for a, b, g, links in parts]


def test_letters_cover_all_bytes():
    assert sorted(align.byte_of_letter().values()) == list(range(256))


def test_words_are_encoded_as_in_the_text(plain):
    own = align.aligner(A, B)
    rng = random.Random(3)
    odd = ["a b", "x  y", " lead", "trail ", "a\tb c", "n\n m", "\u3000 x", "a \u200b b", "x \u180e y", "\x1c a \x1f b",
           "\u2581 a", "a\u2581b c", "<s> </s> <unk> <0x41>", "<|endoftext|> a <|endoftext|>", "\u00a0 a \u00a0b", "a \u0301b",
           "\U0001f600 x \U0001f600", "I'll we 're it's", "a 's b", "1 2 33 444", "\u65e5\u672c \u8a9e", "\u0e01 \u0e33 a", "\ufeffa b"]
    pieces = ["a", " ", "  ", "The", "'s", "\n", "12", "\u00e9", "\u65e5", ".", "\u00d7", "zq", "\t", "\u2003"]
    made = ["".join(rng.choice(pieces) for _ in range(rng.randrange(40))) for _ in range(1500)]
    more = ["foo,bar.\nBaz (x1y2) don't 'tis", "a.\n\nB", "a\nb", "a \n b", "x\n\n", "\nfoo", "foo\n", "a.\nb\n\nc", "12ab34 5", "a' b",
            "a'b'c", "(a) [b] {c}", "a,, b", "!a", "a!", "caf\u00e9s,\u03b1b", "\u03b1,b c", "a\u03b1", "na\u00efve.\n\tx", "...\n(x", " ", "  ", "\n",
            "a \u00d7 b", "1.5e-7 2", "x" * 3000, "ab, " * 500]
    texts = [*odd, *more, *mixed_texts(300), *made, words(rng, 3000)]
    for batch in (texts, [t for i, t in enumerate(reversed(texts)) if i % 2], texts[:50]):
        for t, found in zip(batch, texts_of(own, batch)):
            ids_a, ids_b, *_ = plain(t)
            assert (found or (0, 0))[:2] == (len(ids_a), len(ids_b)), repr(t)
            if found:
                flat = [g.split("|") for g in found[2].split(";")]
                assert [int(i) for g in flat for i in g[0].split(",")] == ids_a, repr(t)
                assert [int(i) for g in flat for i in g[1].split(",")] == ids_b, repr(t)


def test_every_sign_between_letters(plain):
    own = align.aligner(A, B)
    points = [c for c in map(chr, [*range(1, 0x3000), *range(0xFE00, 0x10000), *range(0x1F600, 0x1F650)]) if not 0xD800 <= ord(c) < 0xE000]
    texts = [f"ab{c}cd {c}{c} ef{c} gh {c}ij 1{c}2 .{c}. \u00e9{c}\u00f1 {c}" for c in points]
    for t, found in zip(texts, texts_of(own, texts)):
        ids_a, ids_b, *_ = plain(t)
        assert (found is not None) == bool(ids_a), repr(t)
        if found:
            flat = [g.split("|") for g in found[2].split(";")]
            assert [int(i) for g in flat for i in g[0].split(",")] == ids_a, repr(t)
            assert [int(i) for g in flat for i in g[1].split(",")] == ids_b, repr(t)


def test_tables_equal_brute_force(make, plain):
    rng = random.Random(8)
    extra = [(100 + i, t, "en", "s", len(t)) for i, t in enumerate(
        [words(rng, 200), words(rng, 900), "of the the of", "un\u2581der", "of the", *mixed_texts(40)])]
    rows = odd_rows() + extra
    want = sorted(brute([r[1] for r in rows], plain))
    names = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum")
    docs = make(DOCS, rows)
    clash = clashing(docs)
    for c in ("row", "a", "b", "links", "count", "best", "groups", "n_links"):
        clash = clash.withColumn(c, clash.text)
    for table in (docs, clash):
        for heavy in (align.HEAVY, 3):  # with 3 most pairs go the way of the rare ones
            found = align.with_counts(align.align_texts(table, A, B), heavy=heavy).collect()
            assert sorted((*[r[c] for c in names], hashlib.sha256(r.groups.encode()).hexdigest() if r.groups else "")
                          for r in found) == want
    assert align.with_counts(align.align_texts(make(DOCS, []), A, B)).count() == 0


def test_units_kept_are_bounded(plain):
    own = align.Aligner(A, B, cache=50)
    rng = random.Random(1)
    for _ in range(20):
        texts = [words(rng, 60, 10_000) + ", of the " + "y" * 100 for _ in range(3)]
        for t, found in zip(texts, texts_of(own, texts)):
            ids_a, ids_b, *_ = plain(t)
            assert found[:2] == (len(ids_a), len(ids_b))
        kept = own.units
        assert len(kept.index) <= 50 and len(kept.index) == len(kept.groups) == len(kept.n_a) == len(kept.uses)
        assert len(kept.links) == kept.n_links.sum()
    assert "of" in own.units.index


def test_query_equals_brute_force(spark, plain):
    sf = "/root/testdata/sf0.001"
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").orderBy("doc_id").collect()
    want = [(r.doc_id, *x) for r, x in zip(rows, brute([r.text for r in rows], plain))]
    got = queries.op12_alignment(spark, sf)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert [tuple(r) for r in got.orderBy("doc_id").collect()] == want
