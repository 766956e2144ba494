"""Each stage of the pipeline against a brute-force version of its decision."""

from __future__ import annotations

import hashlib
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
import tiktoken

from ledgerloom.llm import bpe
from ledgerloom.llm.queries import rank_file
from ledgerloom.session import written

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def steps(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    found = [docs]
    for name, stage in corpus_pipeline.STAGES:
        found.append(written(stage(spark, found[-1], SF), f"test-{name}"))
    return found


def test_filters_keep_whole_rows(steps):
    docs, clean, good = steps[:3]
    rows = {r.doc_id: r for r in docs.collect()}
    for out in (clean, good):
        assert out.columns == docs.columns and all(r == rows[r.doc_id] for r in out.collect())
    labels = {r.doc_id: r for r in docs.sparkSession.read.parquet(f"{SF}/labels.parquet").collect()}
    kept, fine = {r.doc_id for r in clean.collect()}, {r.doc_id for r in good.collect()}
    harmless = [i for i, r in labels.items() if not r.toxic]
    assert sum(i in kept for i in harmless) / len(harmless) >= 0.95
    proper = [i for i, r in labels.items() if r.quality and i in kept]
    poor = [i for i, r in labels.items() if not r.quality and i in kept]
    assert sum(i in fine for i in proper) / len(proper) >= 0.97 and sum(i in fine for i in poor) / len(poor) <= 0.2


def test_one_of_each_group_stays(steps):
    before, after = ({r.doc_id: r for r in s.collect()} for s in steps[2:4])
    shingles = {}
    for i, r in before.items():
        words = (r.text or "").lower().split()
        shingles[i] = {tuple(words[k : k + 5]) for k in range(len(words) - 4)} or {tuple(words)}
    assert after.items() <= before.items() and steps[3].columns == steps[2].columns
    assert len({r.text for r in after.values()}) == len(after)
    ids, lost, near = sorted(before), 0, 0
    for n, a in enumerate(ids):
        for b in ids[n + 1 :]:
            small, large = sorted((len(shingles[a]), len(shingles[b])))
            if small >= 0.85 * large and len(shingles[a] & shingles[b]) >= 0.85 * len(shingles[a] | shingles[b]):
                near += 1
                lost += a in after and b in after
    assert near and lost / near <= 0.1
    # Nothing goes that has no like: every dropped text shares shingles with a kept or dropped one.
    for i in set(before) - set(after):
        assert any(len(shingles[i] & shingles[j]) >= 0.5 * min(len(shingles[i]), len(shingles[j])) for j in before if j != i)


def test_mix_and_tokens(steps):
    before, after, tokens = steps[3], steps[4], steps[5].collect()
    assert after.columns == before.columns
    times = Counter(r.doc_id for r in after.collect())
    texts = {r.doc_id: r.text for r in before.collect()}
    assert set(times) <= set(texts) and max(times.values()) <= 3
    public = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.read_ranks(rank_file()), special_tokens={})
    assert Counter(r.doc_id for r in tokens) == times
    for r in tokens:
        ids = np.array(public.encode_ordinary(texts[r.doc_id]), "<u4").tobytes()
        assert bytes(r.ids) == ids and r.n_tokens == len(ids) // 4 and r.ids_sha256 == hashlib.sha256(ids).hexdigest()


def test_run_gives_what_the_stages_give(spark, steps):
    key = lambda df: Counter((r.doc_id, r.ids_sha256) for r in df.collect())
    assert key(corpus_pipeline.run(spark, SF)) == key(steps[5])
