import datetime

from parlance.operators import entities

DAY = datetime.date(2024, 1, 1)


def test_which_entities_go(spark):
    """Thresholds follow each entity's own sampled days; preserved, merged-into, alias and young ones stay."""
    days = [(DAY + datetime.timedelta(i),) for i in range(0, 100, 2)] * 2  # 50 sampled days
    rows = [
        (1, "old, rare", None, None), (2, "old, mentioned enough", None, None), (3, "young", None, None), (4, "preserved", None, '{"preserve": true}'), (5, "target", None, None),
        (6, "alias", 5, None), (7, "never seen", None, '{"preserve": false}'), (8, "recent threshold", None, "no json"), (9, "at its threshold", None, None),
    ]
    seen = {1: (0, 3), 2: (0, 9), 3: (95, 1), 4: (0, 1), 5: (0, 1), 6: (0, 1), 8: (80, 3), 9: (80, 2)}
    mentions = [(e, DAY + datetime.timedelta(first if k == 0 else 99)) for e, (first, n) in seen.items() for k in range(n)]
    found = entities.prune_candidates(
        spark.createDataFrame(mentions, "raw_id long, publish_date date"), spark.createDataFrame(rows, "id long, name string, canonical_id long, metadata string"),
        spark.createDataFrame(days, "day date"), "2024-04-10",
    )
    # 50 days give ceil(50 / 7) = 8; from day 80 on there are 10, so 2; entity 3 is six days old
    assert sorted((r["id"], r["mentions"], r["threshold"]) for r in found.collect()) == [(1, 3, 8), (7, 0, 8), (9, 2, 2)]
    without = entities.prune_candidates(
        spark.createDataFrame(mentions, "raw_id long, publish_date date"), spark.createDataFrame([r[:3] for r in rows], "id long, name string, canonical_id long"), spark.createDataFrame(days, "day date"), "2024-04-10", most_threshold=2,
    )
    assert sorted(r["id"] for r in without.collect()) == [4, 7, 9]
