"""Property test: next cron fire in Spark equals a plain-Python brute force
for random expressions over the supported grammar (values, ranges, steps,
lists, stars; either-day rule when both day fields are restricted)."""

import datetime as dt

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from assay.operators import schedule as SC

FIELDS = [(0, 59), (0, 23), (1, 31), (1, 12), (0, 7)]


@st.composite
def field(draw, lo, hi):
    kind = draw(st.sampled_from(["star", "step", "value", "range", "list", "rangestep"]))
    a = draw(st.integers(lo, hi))
    b = draw(st.integers(a, hi))
    k = draw(st.integers(1, max(1, (hi - lo) // 2)))
    return {"star": "*", "step": f"*/{k}", "value": str(a), "range": f"{a}-{b}",
            "list": f"{a},{b}", "rangestep": f"{a}-{b}/{k}"}[kind]


def expand(text, lo, hi):
    out = set()
    for part in text.split(","):
        base, _, step = part.partition("/")
        step = int(step) if step else 1
        if base == "*":
            a, b = lo, hi
        elif "-" in base:
            a, b = (int(x) for x in base.split("-"))
        else:
            a = int(base)
            b = hi if "/" in part else a
        out.update(range(a, b + 1, step))
    return out


def brute(cron, t):
    f = cron.split()
    mins, hours, doms, months = (expand(f[i], *FIELDS[i]) for i in range(4))
    dows = {d % 7 for d in expand(f[4], *FIELDS[4])}
    either = f[2] != "*" and f[4] != "*"
    start = t.replace(second=0, microsecond=0) + dt.timedelta(minutes=1)
    day = start.replace(hour=0, minute=0)
    for _ in range(1500):
        dom_ok, dow_ok = day.day in doms, (day.isoweekday() % 7) in dows
        if day.month in months and ((dom_ok or dow_ok) if either else (dom_ok and dow_ok)):
            for h in sorted(hours):
                for m in sorted(mins):
                    c = day.replace(hour=h, minute=m)
                    if c >= start:
                        return c
        day += dt.timedelta(days=1)
    return None


cron_st = st.tuples(*[field(lo, hi) for lo, hi in FIELDS]).map(" ".join)
time_st = st.datetimes(min_value=dt.datetime(2023, 1, 1), max_value=dt.datetime(2025, 12, 31))


@settings(max_examples=4, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(cron_st, time_st), min_size=20, max_size=20))
def test_next_fire_property(spark, cases):
    df = spark.createDataFrame([(c, t) for c, t in cases], "cron string, t timestamp_ntz")
    got = [(r["cron"], r["t"], r["n"]) for r in SC.with_next_fire(df, F.col("cron"), F.col("t"), "n").collect()]
    for cron, t, n in got:
        assert n == brute(cron, t), (cron, t, n)
