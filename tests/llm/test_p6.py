"""p6_ids against a public library's encoder over the same vocabulary."""

from __future__ import annotations

import os

import __spark_entry__ as e
from tessera.llm import bpe

SF = "/root/testdata/sf0.01"


def test_every_document_has_its_ids(spark) -> None:  # noqa: ANN001
    import tiktoken

    ranks = bpe.read_ranks(os.path.join(bpe.VOCABULARIES, bpe.BYTE_BPE_50K))
    public = tiktoken.Encoding("own", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
    want = sorted((r.doc_id, public.encode_ordinary(r.text or "")) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    df = e.queries()["p6_ids"](spark, SF)
    assert df.dtypes == [("doc_id", "bigint"), ("ids", "array<int>")]
    got = sorted((r.doc_id, r.ids) for r in df.collect())
    assert got == want
    assert any(not ids for _, ids in got)
