"""Path payoffs by running sums against a sum over hours."""

import random
from datetime import UTC, date, datetime, timedelta
from zoneinfo import ZoneInfo

import pytest

from wattline.plans.paths import span_payoff


def test_payoffs_with_gaps_equal_a_sum_over_hours(spark):
    rng, start, ny = random.Random(8), datetime(2024, 3, 1, 5, tzinfo=UTC), ZoneInfo("America/New_York")
    price = {}
    for p in range(6):
        for h in range(24 * 40):
            day = h // 24
            if p == 5 and 10 <= day < 20:                   # a point without any price for ten days
                continue
            if p in (2, 3) and rng.random() < 0.02 or day == 25 or (p == 4 and day > 33):
                continue
            price[p, start + timedelta(hours=h)] = None if rng.random() < 0.002 else round(rng.normalvariate(0, 5), 2)
    cong = spark.createDataFrame([(p, t.replace(tzinfo=None), v) for (p, t), v in price.items()], "ptid long, ts_utc timestamp_ntz, cong double")
    cong = cong.withColumn("ts_utc", cong["ts_utc"].cast("timestamp"))
    asks = []
    for i in range(80):
        a = date(2024, 2, 20) + timedelta(days=rng.randint(0, 60))
        asks.append((i, rng.randint(0, 6), rng.randint(0, 6), a, a + timedelta(days=rng.randint(-2, 30))))
    got = {r["ask"]: (r["payoff"], r["hours"]) for r in span_payoff(cong, spark.createDataFrame(asks, "ask long, poi long, pow long, a date, b date")).collect()}
    assert len(got) == len(asks)
    for i, poi, snk, a, b in asks:
        hours = [t for (p, t), v in price.items() if p == poi and v is not None and price.get((snk, t)) is not None and a <= t.astimezone(ny).date() <= b]
        want = sum(price[snk, t] - price[poi, t] for t in hours)
        assert got[i][1] == len(hours), (i, poi, snk, a, b)
        assert got[i][0] is None if not hours else got[i][0] == pytest.approx(want, abs=1e-6)
