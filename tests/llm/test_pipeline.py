"""The pipeline against its stages' parts in plain Python, and on odd and empty tables."""

import hashlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline
from tests.llm.edge import empty, labels, odd
from tests.llm.test_models import WORD, brute_base
from tests.llm.test_pairs import brute_groups
from tests.llm.test_tokens import TIK

SF = "/root/testdata/sf0.001"


def test_stages_do_their_work(spark):
    """Each stage is judged on its own input."""
    from quern.llm.common import staged
    from quern.llm.line_dedup import line_report
    from quern.llm.mixing import mix_report
    from quern.llm.registry import queries

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = [docs]
    for name, stage in corpus_pipeline.STAGES:
        out.append(staged(stage(spark, out[-1], SF), name))
        assert name == corpus_pipeline.STAGES[-1][0] or out[-1].columns == docs.columns
    kept = {r.doc_id for r in queries()["op8_quality_rules"](spark, SF).where("kept").collect()}
    assert sorted(r.doc_id for r in out[1].collect()) == sorted(kept)
    assert all(brute_base(r.text)[0] >= 50 for r in out[1].collect())
    lost = {r.doc_id: set(r.removed) for r in line_report(out[1]).collect()}
    want = {r.doc_id: "\n".join(x for i, x in enumerate(r.text.split("\n")) if i not in lost[r.doc_id]) for r in out[1].collect()}
    after = {r.doc_id: (r.text, r.n_chars) for r in out[2].collect()}
    assert after == {i: (t, len(t)) for i, t in want.items() if WORD.search(t)}
    groups = brute_groups([(i, t) for i, (t, _) in after.items()], 5, 80, 100)
    assert sorted(r.doc_id for r in out[3].collect()) == sorted(i for i, (_, g) in groups.items() if g == i)
    copies = {r.doc_id: r.copies for r in mix_report(out[3]).collect()}
    assert Counter(r.doc_id for r in out[4].collect()) == Counter({i: n for i, n in copies.items() if n})
    texts = {r.doc_id: r.text for r in out[4].collect()}
    for r in out[5].collect():
        ids = TIK.encode_ordinary(texts[r.doc_id])
        assert (r.n_tokens, r.decoded_sha256) == (len(ids), hashlib.sha256(texts[r.doc_id].encode()).hexdigest())
        assert r.ids_sha256 == hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest()
    assert sorted(map(tuple, corpus_pipeline.run(spark, SF).collect())) == sorted(map(tuple, out[5].collect()))


@pytest.mark.parametrize("make", [odd, empty])
def test_odd_tables(spark, tmp_path, make):
    make(spark).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    labels(spark).coalesce(1).write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
    assert docs.count() == 0 or make is odd


def test_line_stage_joins_long_words_with_one_edit(spark):
    """Similar lines whose few long words make their chosen runs differ are not left to the next stage."""
    rng = np.random.default_rng(22)
    letters = lambda n: "".join(rng.choice(list("abcdefghinorst"), n))
    rows = []
    for i in range(0, 300, 2):
        words = [letters(9) for _ in range(16)]
        rows += [(i, " ".join(words)), (i + 1, " ".join([*words[:8], words[8][:4] + "Z" + words[8][5:], *words[9:]]))]
    left = {r.doc_id for r in corpus_pipeline.line_dedup(spark, spark.createDataFrame(rows, "doc_id long, text string"), SF).collect()}
    assert set(range(0, 300, 2)) <= left and len(left) <= 165
