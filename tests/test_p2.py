"""p2_ledger and p2_as_of at full recorded times, against a plain replay of the updates."""

from __future__ import annotations

from datetime import date, datetime, timedelta
from random import Random

import __spark_entry__ as e
from tessera.operators import ledger
from tessera.plans import tables

UPDATE = "update_id bigint, ebl_id string, op string, effective_date date, received_at timestamp, owned string, renewal_date string, sent_by string"


def _replay(points: list[tuple]) -> set[tuple]:
    """Ledger rows of (entity, attr, valid, recorded, seq, value): what is held after each recorded time, compared."""
    far, out = datetime(9999, 12, 31), set()
    for line in {p[:2] for p in points}:
        own = sorted((p for p in points if p[:2] == line), key=lambda p: (p[3], p[4]))
        held: dict[tuple, datetime] = {}
        state: dict = {}
        for t in sorted({p[3] for p in own}):
            for p in own:
                if p[3] == t:
                    state[p[2]] = p[5]
            days = sorted(state)
            now = {(state[d], d, n) for d, n in zip(days, [*days[1:], date(9999, 12, 31)], strict=True)}
            out |= {(*line, *row, since, t) for row, since in held.items() if row not in now}
            held = {row: held.get(row, t) for row in now}
        out |= {(*line, *row, since, far) for row, since in held.items()}
    return out


def test_ledger_of_late_points_over_many_ranges(spark) -> None:  # noqa: ANN001
    r = Random(3)
    points = [
        (k % 3, "a", date(2020, 1, 1) + timedelta(r.randrange(0, 900, 3)), datetime(2021, 1, 1) + timedelta(minutes=r.randrange(3000)), k, r.choice(["x", "y", None])) for k in range(900)
    ]
    df = spark.createDataFrame(points, "entity bigint, attr string, valid date, recorded timestamp_ntz, seq bigint, value string")
    got = [tuple(x) for x in ledger.ledger(df, None).collect()]
    assert len(got) == len(set(got))
    assert set(got) == _replay(points)


def test_updates_of_one_day_are_superseded_and_later_ones_unknown(spark, tmp_path) -> None:  # noqa: ANN001
    day, at = date(2018, 5, 7), datetime.fromisoformat(tables.AS_OF)
    rows = [
        (1, "285798", "U", day, datetime(2018, 5, 7, 14, 42), "false", None, ""),
        (2, "285798", "U", day, datetime(2018, 5, 7, 16, 10), "true", None, ""),
        (3, "1", "U", day, at, "true", None, ""),
        (4, "2", "U", day, at + timedelta(hours=9), "true", None, ""),
    ]
    spark.createDataFrame(rows, UPDATE).write.parquet(f"{tmp_path}/title_update.parquet")
    held = {(r.ebl_id, r.value, r.recorded_from, r.recorded_to) for r in e.queries()["p2_ledger"](spark, str(tmp_path)).collect() if r.attr == "owned"}
    far = datetime(9999, 12, 31)
    assert held == {(285798, "false", rows[0][4], rows[1][4]), (285798, "true", rows[1][4], far), (1, "true", at, far), (2, "true", rows[3][4], far)}
    assert sorted(r.ebl_id for r in e.queries()["p2_as_of"](spark, str(tmp_path)).collect()) == [1, 285798]


def test_as_of_knows_what_was_received_by_then(spark) -> None:  # noqa: ANN001
    from oracle import compare

    assert compare(spark, "p2_as_of", "/root/testdata/sf0.01") == ""
