import base64
import random

import numpy as np
import public_tokenizers
import pytest

from pathloom.llm import bpe, tokencount
from tests.llm.cases import DOCS, clashing, odd_rows

RANKS = public_tokenizers.path("byte_bpe_50k.tiktoken")
PIECES = public_tokenizers.path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def library():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def mixed_texts(n=400, seed=5):
    rng = random.Random(seed)
    parts = ["'", "s", "t", "re", "ve", "ll", "d", " ", "  ", "\n", "\t", "a", "Word", "19", "!", "é", "　", "日本",
             "😀", "\x00", "ﬁ", "́", "<|endoftext|>", "zqxj", "²", "ª"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(60))) for _ in range(n)]


def test_words_are_cut_as_the_pattern_cuts():
    import regex

    pattern = regex.compile(public_tokenizers.PATTERN)
    texts = mixed_texts()
    joined = "".join(texts)
    ends = np.cumsum([len(t) for t in texts])
    firsts = np.unique(np.concatenate([[0], ends[:-1]]))
    got = bpe.word_starts(np.frombuffer(joined.encode("utf-32-le"), np.uint32), firsts[firsts < len(joined)])
    want = [e - len(t) + m.start() for t, e in zip(texts, ends) for m in pattern.finditer(t)]
    assert got.tolist() == want


def test_ids_equal_the_library_and_decode_to_the_text(library):
    texts = [*mixed_texts(), "a" * 300, "ab" * 200, "Zq9" * 100, "é" * 300, " " * 400 + "x", "\n" * 100, ""]
    ids, at, raw, raw_at = bpe.coder(RANKS).encode(texts)
    for i, t in enumerate(texts):
        assert ids[at[i]:at[i + 1]].tolist() == library.encode_ordinary(t)
        assert raw[raw_at[i]:raw_at[i + 1]].tobytes() == t.encode()


def test_every_code_point(library):
    points = [chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000]
    texts = ["".join(c + after for c in points[i:i + 4000]) for i in range(0, len(points), 16_000) for after in "a\n"]
    ids, at, _, _ = bpe.coder(RANKS).encode(texts)
    assert all(ids[at[i]:at[i + 1]].tolist() == library.encode_ordinary(t) for i, t in enumerate(texts))


def test_long_texts_are_cut_where_a_word_begins(library):
    for t in [*mixed_texts(50), "ab  cd\n e 's f  g' 'll  " * 50, "x" * 500]:
        parts = bpe.cut(t, 7)
        assert "".join(parts) == t
        assert [i for p in parts for i in library.encode_ordinary(p)] == library.encode_ordinary(t)


def test_memory_of_words_is_bounded(library, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE", 50)
    monkeypatch.setattr(bpe, "WORDS", 7)
    coder = bpe.Coder(RANKS)
    for seed in range(5):
        texts = mixed_texts(30, seed)
        ids, at, _, _ = coder.encode(texts)
        assert all(ids[at[i]:at[i + 1]].tolist() == library.encode_ordinary(t) for i, t in enumerate(texts))
        assert len(coder.young) <= 50 + 400


def test_encode_and_decode_tables(make, library):
    docs = make(DOCS, odd_rows())
    for table in (docs, clashing(docs)):
        rows = bpe.encode_texts(table, RANKS, keep=("doc_id", "text")).collect()
        assert len(rows) == len(odd_rows())
        for r in rows:
            assert r.ids == library.encode_ordinary(r.text or "") and bytes(r.decoded) == (r.text or "").encode()
    coded = bpe.encode_texts(docs.where("length(text) < 6000 or text is null"), RANKS, keep=("doc_id", "text"))
    for r in bpe.decode_ids(coded, RANKS, keep=("doc_id", "text")).collect():
        assert bytes(r.decoded) == (r.text or "").encode()
    assert bpe.encode_texts(make(DOCS, []), RANKS).count() == 0


def test_spliced_counts_equal_whole_ones():
    c = tokencount.Counter(PIECES, 50, 4)
    texts = [*mixed_texts(200), "a" * 1000, "  " * 300, " \n" * 200, "日本語" * 200, "😀 x" * 200, "▁ ▁" * 200, "<s>" * 100,
             "=\t=" * 200, " " * 999, "龘" * 200]
    for t in texts:
        assert c.spliced(t) == len(c.model.encode(t)), t[:40]


def test_count_tables(make):
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    docs = make(DOCS, odd_rows())
    for table in (docs, clashing(docs)):
        rows = tokencount.count_tokens(table, PIECES, keep=("doc_id", "text"), chunk=4096, overlap=64).collect()
        assert len(rows) == len(odd_rows())
        for r in rows:
            n = len(model.encode(r.text or ""))
            assert (r.n_bytes, r.n_tokens, r.over_limit) == (len((r.text or "").encode()), n, n > 4096)
    assert tokencount.count_tokens(make(DOCS, []), PIECES).count() == 0


def test_a_worker_needs_little_memory_for_a_part(monkeypatch):
    import tracemalloc

    import pyarrow as pa

    monkeypatch.setattr(bpe, "map_texts", lambda docs, text_col, fields, make, keep: make)
    run = bpe.encode_texts(None, RANKS)()
    texts = pa.array(["a part of texts with few words " * 3300] * 40)  # some 4 MB, as ``parts`` hands them on
    run(texts[:1])
    tracemalloc.start()
    try:
        ids, raw = run(texts)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert raw.to_pylist() == [t.encode() for t in texts.to_pylist()]
    assert peak < 80e6


def test_a_remembered_word_takes_few_bytes(library):
    import tracemalloc

    rng = random.Random(7)
    words = list(dict.fromkeys(" " + "".join(rng.choice("abcdefghij") for _ in range(9)) for _ in range(5000)))
    coder = bpe.Coder(RANKS)
    coder.encode(["warm up"])
    tracemalloc.start()
    try:
        ids, at, raw, _ = coder.encode(["".join(words)])
        assert ids.tolist() == library.encode_ordinary("".join(words)) and raw.tobytes() == "".join(words).encode()
        del ids, at, raw
        held = tracemalloc.get_traced_memory()[0]
    finally:
        tracemalloc.stop()
    assert len(coder.young) >= len(words) and held < 160 * len(words)


def test_ids_decode_across_blocks_without_what_is_no_id(library):
    import pyarrow as pa

    texts = ["".join(mixed_texts(300, s)) for s in range(3)]
    lists = [[], library.encode_ordinary(texts[0]), [10**8, -7, None], *map(library.encode_ordinary, texts[1:]), []]
    assert sum(map(len, lists)) > 3 * 4096
    got = bpe.coder(RANKS).decode(pa.array(lists, pa.list_(pa.int32()))).to_pylist()
    assert got == [b"", texts[0].encode(), b"", *(t.encode() for t in texts[1:]), b""]
    assert bpe.coder(RANKS).decode(pa.array([[], []], pa.list_(pa.int32()))).to_pylist() == [b"", b""]


def test_ids_that_do_not_decode_to_their_word_are_reported(monkeypatch):
    import pyarrow as pa

    coder = bpe.Coder(RANKS)
    decode = coder.decode
    other = {b" zqxj": b"?"}
    monkeypatch.setattr(coder, "decode", lambda ids: pa.array([other.get(d, d) for d in decode(ids).to_pylist()]))
    for _ in range(2):  # from DuckDB, then from memory
        _, _, raw, at = coder.encode(["a zqxj b", "Word zqxj"])
        assert [raw[a:b].tobytes() for a, b in zip(at, at[1:])] == [b"a? b", b"Word?"]
