import base64
import itertools

import public_tokenizers
from pyspark.sql import functions as F

import corpus_pipeline
from pathloom.llm import pii, quality
from pathloom.llm.common import DOCUMENT_COLUMNS, staged, table
from pathloom.llm.neardup import Rule
from tests.llm.cases import DOCS, clashing, odd_rows
from tests.llm.test_decontaminate import brute as contamination
from tests.llm.test_neardup import brute as groups

SF = "/root/testdata/sf0.001"


def test_every_stage_against_a_plain_reading(spark):
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in
             map(bytes.split, open(public_tokenizers.path("byte_bpe_50k.tiktoken"), "rb"))}
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    docs = table(spark, SF, "documents")
    before = {r.doc_id: r for r in docs.collect()}
    model = quality.fit(docs, table(spark, SF, "labels"))
    good = {i for i, r in before.items() if model.score(quality.statistics([r.text]))[0] >= quality.THRESHOLD}
    bench = [(r.item_id, r.text) for r in table(spark, SF, "benchmark").collect()]
    for name, stage in corpus_pipeline.STAGES:
        docs = staged(stage(spark, docs, SF), f"test_{name}")
        now = {r.doc_id: r for r in docs.collect()}
        if name == "quality":
            assert set(now) == good and 0 < len(good) < len(before)
        elif name == "near_duplicates":
            want = groups([(i, r.text) for i, r in before.items()], Rule())
            assert set(now) == {i for i, _, root in want if i == root} and len(now) < len(before)
        elif name == "decontamination":
            found = contamination([(i, r.text) for i, r in before.items()], bench)
            assert set(now) == {i for i, n, hit, _ in found if not (hit and 20 * len(hit) >= n)}
            assert len(now) < len(before)
        elif name == "pii":
            assert {i: r.text for i, r in now.items()} == {i: pii.mask(r.text) for i, r in before.items()}
            assert all(r.n_chars == len(r.text) for r in now.values())
        else:
            assert {i: r.ids for i, r in now.items()} == {
                i: " ".join(map(str, library.encode_ordinary(r.text))) for i, r in before.items()}
            assert all(r.round_trip and r.n_tokens == len(r.ids.split()) for r in now.values())
        if name != "bpe":
            assert docs.columns == DOCUMENT_COLUMNS
            same = [c for c in ("lang", "source")]
            assert all(getattr(r, c) == getattr(before[i], c) for i, r in now.items() for c in same)
        before = now
    run = corpus_pipeline.run(spark, SF)
    assert run.exceptAll(docs).isEmpty() and docs.exceptAll(run).isEmpty()


def test_odd_rows_and_empty_tables(spark, make):
    docs = make(DOCS, odd_rows())
    for t, (name, stage) in itertools.product((clashing(docs), make(DOCS, [])), corpus_pipeline.STAGES):
        out = stage(spark, t, SF)
        n, most = out.count(), t.count()
        assert n <= most and (n > 0 or most == 0 or name in ("quality", "decontamination")), name
    one = corpus_pipeline.one_of_each(spark, docs, SF)
    assert one.where("doc_id IS NULL").count() == 2
    assert one.where("doc_id IS NOT NULL").groupBy("doc_id", "text").agg(F.count("*").alias("n")).where("n > 1").isEmpty()
    assert {r.doc_id for r in one.collect()} >= {0, 1, 5, 7} and 6 not in {r.doc_id for r in one.collect()}


def test_texts_of_one_id_are_documents_of_their_own(spark, make):
    a, b, c = ("one text of seven words or so", "another text that shares nothing at all", "third of them with its own words here")
    rows = [(1, a), (1, b), (1, b), (2, b), (3, c), (None, a), (4, None), (4, c), (2**50, c + " and more of it too"), (2**50, a)]
    docs = make(DOCS, [(i, t, "en", "s", len(t or "")) for i, t in rows])
    kept = sorted(((r.doc_id, r.text) for r in corpus_pipeline.one_of_each(spark, docs, SF).collect()), key=str)
    assert kept == sorted([(1, a), (1, b), (3, c), (4, None), (2**50, c + " and more of it too"), (None, a)], key=str)
