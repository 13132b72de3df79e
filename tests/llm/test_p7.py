"""p7_mix and p7_shares: shares, repeats and the curriculum, counted again here."""

from __future__ import annotations

from collections import Counter

import __spark_entry__ as e
from tessera.llm import bpe, mix

SF = "/root/testdata/sf0.01"


def test_mix_holds_shares_repeats_and_schedule(spark) -> None:  # noqa: ANN001
    docs = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    target = {r.source: r for r in spark.read.parquet(f"{SF}/mix_target.parquet").collect()}
    own = bpe.load(f"{bpe.VOCABULARIES}/{bpe.BYTE_BPE_50K}")
    size = {k: len(own.encode([r.text])[0]) for k, r in docs.items()}
    rows = e.queries()["p7_mix"](spark, SF).collect()
    assert [r.position for r in rows] == sorted(r.position for r in rows)
    assert all(0 <= r.position <= 1 and r.n_tokens == size[r.doc_id] > 0 and r.source == docs[r.doc_id].source for r in rows)
    times = Counter((docs[r.doc_id].sitting_no, docs[r.doc_id].speech_no, r.source) for r in rows)
    assert all(n <= target[s].max_repeat for (_, _, s), n in times.items())
    assert len({(r.doc_id, r.copy) for r in rows}) == len(rows)

    total, here = sum(r.n_tokens for r in rows), {r.source for r in rows}
    assert here == {d.source for d in docs.values()} & set(target)
    reachable = sum(target[s].target_share for s in here)
    longest = {s: max(r.n_tokens for r in rows if r.source == s) for s in here}
    plan = {r["source"]: r for r in mix.plan(mix.speeches(spark.read.parquet(f"{SF}/documents.parquet")), spark.read.parquet(f"{SF}/mix_target.parquet"))}
    for s in here:
        g, b, size_all = target[s].target_share / reachable, plan[s]["bend"], plan[s]["demand"] / plan[s]["planned_share"]
        for t in (0.1, 0.25, 0.5, 0.75, 1.0):
            got = sum(r.n_tokens for r in rows if r.source == s and r.position <= t)
            assert abs(got - size_all * (g * t + b * (t - t * t))) <= longest[s] / 2 + 1
    assert any(abs(plan[s]["bend"]) > 0.01 for s in here)

    report = {r.source: r for r in e.queries()["p7_shares"](spark, SF).collect()}
    assert set(report) == {d.source for d in docs.values()} | set(target)
    for s, r in report.items():
        mine = [x for x in rows if x.source == s]
        assert (r.taken, r.tokens, r.most_taken) == (len(mine), sum(x.n_tokens for x in mine), max([0, *(x.copy for x in mine)]))
        assert abs(r.share - r.tokens / total) < 1e-9
    assert report["overseas_council"].share == 0 and report["overseas_council"].available == 0
