"""Schedules and the task queue as data.

Cron expressions are compiled per row into Spark arrays (minutes, hours,
days, months, weekdays) with higher-order functions, and the next fire time
is found arithmetically: the first matching minute later the same day, else
the first matching day at its first matching minute. Month and weekday names,
``@hourly`` and its like and ``L`` (last day of the month) are understood.
Texts that are no cron expression, or name a day that never comes, have no
next fire and are listed by ``bad_crons``. Nothing is exploded per minute and
no cron library runs in Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import expressions as X

#: Any day that ever comes again does so within eight years and a day: Feb 29 skips at most one
#: leap year (2096 to 2104), every other (month, day) comes yearly.
SEARCH_DAYS = 8 * 366 + 1

MACROS = {"@yearly": "0 0 1 1 *", "@annually": "0 0 1 1 *", "@monthly": "0 0 1 * *", "@weekly": "0 0 * * 0",
          "@daily": "0 0 * * *", "@midnight": "0 0 * * *", "@hourly": "0 * * * *"}
MONTHS = {n: i for i, n in enumerate("jan feb mar apr may jun jul aug sep oct nov dec".split(), 1)}
WEEKDAYS = {n: i for i, n in enumerate("sun mon tue wed thu fri sat".split())}


def _ival(s: Column) -> Column:
    return F.trim(s).try_cast("int")


def _numbered(text: Column, names: dict[str, int]) -> Column:
    """Names of months or weekdays turned to their numbers."""
    for name, number in names.items():
        text = F.regexp_replace(text, rf"\b{name}\b", str(number))
    return text


def _field_values(text: Column, lo: int, hi: int) -> Column:
    """Values of one cron field: ``*``, ``a``, ``a-b``, ``*/n``, ``a-b/n``, ``a/n`` and lists;
    null if any part of the list is none of these or out of bounds."""
    def one(p: Column) -> Column:
        has_step = p.contains("/")
        base = F.split(p, "/").getItem(0)
        step = F.when(has_step, _ival(F.try_element_at(F.split(p, "/"), F.lit(2)))).otherwise(F.lit(1))
        star = (base == "*") | (base == "?")
        rng = base.contains("-")
        start = (F.when(star, F.lit(lo)).when(rng, _ival(F.try_element_at(F.split(base, "-"), F.lit(1))))
                 .otherwise(_ival(base)))
        end = (F.when(star, F.lit(hi)).when(rng, _ival(F.try_element_at(F.split(base, "-"), F.lit(2))))
               .when(has_step, F.lit(hi)).otherwise(_ival(base)))
        ok = (start.isNotNull() & end.isNotNull() & step.isNotNull() & (step > 0) & (start <= end)
              & (start >= lo) & (end <= hi))
        return F.when(ok, F.sequence(start, end, step))
    vals = F.flatten(F.transform(F.split(F.trim(text), ","), one))  # null if one part is
    return F.array_sort(F.array_distinct(vals))


def cron_fields(cron: Column) -> Column:
    """Compile a five-field cron text to a struct of value arrays."""
    text = F.lower(F.trim(cron))
    for macro, fields in MACROS.items():
        text = F.when(text == macro, F.lit(fields)).otherwise(text)
    f = F.split(text, r"\s+")

    def part(i):
        return F.try_element_at(f, F.lit(i))
    dow = _field_values(_numbered(part(5), WEEKDAYS), 0, 7)
    # L: the last day of the month, alone or among days
    last = F.array_contains(F.split(part(3), ","), "l")
    doms = F.array_join(F.filter(F.split(part(3), ","), lambda p: p != "l"), ",")
    return F.struct(
        _field_values(part(1), 0, 59).alias("minutes"),
        _field_values(part(2), 0, 23).alias("hours"),
        F.when(doms == "", F.array().cast("array<int>")).otherwise(_field_values(doms, 1, 31)).alias("doms"),
        last.alias("last_dom"),
        _field_values(_numbered(part(4), MONTHS), 1, 12).alias("months"),
        F.array_distinct(F.transform(dow, lambda d: d % 7)).alias("dows"),
        part(3).isin("*", "?").alias("dom_star"),
        part(5).isin("*", "?").alias("dow_star"),
        (F.size(f) == 5).alias("well_formed"))


def _day_matches(c: Column, d: Column) -> Column:
    dom = F.array_contains(c["doms"], F.dayofmonth(d)) | (c["last_dom"] & (d == F.last_day(d)))
    dow = F.array_contains(c["dows"], F.dayofweek(d) - 1)
    # both day fields restricted: either may match (the common cron rule)
    day = F.when(c["dom_star"] | c["dow_star"], dom & dow).otherwise(dom | dow)
    return F.array_contains(c["months"], F.month(d)) & day


def _compiled(df: DataFrame) -> DataFrame:
    """Attach ``_cf`` (compiled fields of ``_cron_text``): each distinct
    expression is compiled once and joined back by its text."""
    d = df.select("_cron_text").distinct().withColumn("_cf", cron_fields(F.col("_cron_text")))
    return df.join(d, df["_cron_text"].eqNullSafe(d["_cron_text"]), "left").drop(d["_cron_text"])


def with_next_fire(df: DataFrame, cron: Column, after: Column, out: str) -> DataFrame:
    """Add ``out``: the first cron time strictly after ``after`` (minute
    resolution, seconds zero). Each cron text is compiled once into arrays;
    the day search looks at the next month first, then at four years, and
    only then at the rest of the eight that cover every day."""
    df = df.withColumn("_cron_text", cron).withColumn(
        "_after", F.date_trunc("minute", after).cast("timestamp_ntz"))
    df = _compiled(df)
    c = F.col("_cf")
    t = F.col("_after")
    d0 = F.to_date(t)
    hrs, mins = c["hours"], c["minutes"]
    first_min = F.try_element_at(mins, F.lit(1))
    first_hour = F.try_element_at(hrs, F.lit(1))

    def first_day(lo: int, hi: int) -> Column:
        return F.try_element_at(F.filter(F.sequence(F.date_add(d0, lo), F.date_add(d0, hi)),
                                         lambda d: _day_matches(c, d)), F.lit(1))

    def day(k: int) -> Column:
        d = F.date_add(d0, k)
        return F.when(_day_matches(c, d), d)
    # later the same day: next minute of this hour, else the next listed hour at its first minute
    next_min = F.try_element_at(F.filter(mins, lambda x: x > F.minute(t)), F.lit(1))
    next_hour = F.try_element_at(F.filter(hrs, lambda x: x > F.hour(t)), F.lit(1))
    later_today = (F.when(F.array_contains(hrs, F.hour(t)) & next_min.isNotNull(), F.hour(t) * 60 + next_min)
                   .when(next_hour.isNotNull(), next_hour * 60 + first_min))
    same_day = F.when(_day_matches(c, d0), later_today)
    # most expressions fire again within a day or two: test those dates before building ranges
    later = F.coalesce(day(1), day(2), first_day(3, 31), first_day(32, 1461), first_day(1462, SEARCH_DAYS))
    at = lambda d, m: F.timestamp_add("MINUTE", m, d.cast("timestamp_ntz"))
    nxt = (F.when(t.isNull() | ~well_formed(c), F.lit(None).cast("timestamp_ntz"))
           .when(same_day.isNotNull(), at(d0, same_day))
           .otherwise(at(later, first_hour * 60 + first_min)))
    return df.withColumn(out, nxt).drop("_cf", "_after", "_cron_text")


def well_formed(c: Column) -> Column:
    """Whether the compiled fields are those of a cron expression."""
    whole = c.isNotNull() & c["well_formed"]
    for name in ("minutes", "hours", "doms", "months", "dows"):
        whole = whole & c[name].isNotNull()
    return F.coalesce(whole, F.lit(False))


def bad_crons(rules: DataFrame, rule_col: str = "entity_sample_to_dq_rule_id", settings_col: str = "rule_settings") -> DataFrame:
    """Scheduled rules that can never fire, as rejects: ``(rule_id, crontab, reason)``."""
    r = rules.select(F.col(rule_col).alias("rule_id"), F.get_json_object(F.col(settings_col), "$.crontab").alias("crontab")) \
        .filter(F.col("crontab").isNotNull()).distinct()
    j = with_next_fire(r, F.col("crontab"), F.lit("2000-01-01 00:00:00").cast("timestamp_ntz"), "_next")
    formed = well_formed(cron_fields(F.col("crontab")))
    return j.filter(F.col("_next").isNull()).select(
        "rule_id", "crontab", F.when(formed, "names a day that never comes").otherwise("not a cron expression").alias("reason"))


def latest_task(tasks: DataFrame) -> DataFrame:
    """The newest task per rule (ties: larger id)."""
    return tasks.groupBy("rule_id").agg(F.max_by(F.struct("time", "id", "state"), F.struct("time", "id")).alias("t")) \
                .select("rule_id", "t.id", "t.time", "t.state")


def due_tasks(rules: DataFrame, tasks: DataFrame, now: str | Column,
              rule_col: str = "entity_sample_to_dq_rule_id", settings_col: str = "rule_settings") -> DataFrame:
    """L1: for each scheduled rule, the next fire after its last task if it is
    due by ``now``; a rule without tasks is due ``now`` (seconds zero). One fire
    per rule per pass. Returns ``(id, time, rule_id, state)`` rows to append."""
    now_c = now if isinstance(now, Column) else F.to_timestamp_ntz(F.lit(now))
    cron = F.get_json_object(F.col(settings_col), "$.crontab")
    r = (rules.select(F.col(rule_col).alias("rule_id"), cron.alias("crontab"))
         .filter(F.col("crontab").isNotNull()).dropDuplicates(["rule_id"]))
    last = tasks.groupBy("rule_id").agg(F.max("time").alias("last_time"))
    j = with_next_fire(r.join(last, "rule_id", "left"), F.col("crontab"), F.col("last_time"), "_next")
    nxt = F.when(F.col("last_time").isNull(), F.date_trunc("minute", now_c).cast("timestamp_ntz")) \
           .otherwise(F.col("_next"))
    due = j.select("rule_id", nxt.alias("time")).filter(F.col("time") <= now_c)
    return due.select(X.deterministic_id(F.col("rule_id"), F.col("time")).alias("id"), "time", "rule_id",
                      F.lit(0).alias("state"))


def upsert(target: DataFrame, source: DataFrame, keys: list[str]) -> DataFrame:
    """Insert, or on key conflict take all columns from the source.

    One shuffle on the keys (anti join) plus a union; with a table format
    that supports it, ``MERGE INTO`` does the same in place."""
    return target.join(source.select(*keys), keys, "left_anti").unionByName(source.select(*target.columns))


def upsert_partitions(path: str, source: DataFrame, keys: list[str], part: str) -> None:
    """A12 in place for a Parquet table partitioned by ``part``: only partitions that ``source`` has rows for are
    read and written anew (dynamic partition overwrite); the files of all others stay as they are.

    ``part`` must follow from the key, so that no key changes its partition. The driver reads the distinct values
    of ``part`` in ``source``, at most one for each partition folder of the result, which it lists in any case;
    they become a partition filter of the scan. A job that fails leaves the table as it was; a retry gives the
    same rows. Null is a partition of its own; an empty ``source`` changes nothing."""
    spark = source.sparkSession
    source = source.persist()  # read for its partitions, its keys and its rows
    try:
        touched = [r[0] for r in source.select(part).distinct().collect()]
        if not touched:
            return
        target = spark.read.parquet(path)
        mine = F.col(part).isin([v for v in touched if v is not None])
        if None in touched:
            mine = F.coalesce(mine, F.lit(True))
        rows = upsert(target.filter(mine), source, keys)
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(part).parquet(path)
    finally:
        source.unpersist()


def set_task_state(tasks: DataFrame, task_ids: DataFrame, state: int, id_col: str = "id") -> DataFrame:
    """Tasks named in ``task_ids`` move to ``state`` (0 pending, 1 running, 2 done).

    Moving to running counts an attempt (``attempts``, added when missing), so
    a task that keeps failing in state 1 is visible instead of retried silently."""
    if state == 1 and "attempts" not in tasks.columns:
        tasks = tasks.withColumn("attempts", F.lit(0))
    ids = task_ids.select(F.col(id_col).alias("id")).distinct()
    changed = tasks.join(ids, "id", "left_semi").withColumn("state", F.lit(state).cast(tasks.schema["state"].dataType))
    if state == 1:
        changed = changed.withColumn("attempts", F.coalesce(F.col("attempts"), F.lit(0)) + 1)
    return upsert(tasks, changed, ["id"])


def scheduled_run_events(selected: DataFrame, now: str) -> DataFrame:
    """K6: per selected task a START event (carrying the check's assertions in
    the real run) and a COMPLETE event of one run; nominal window now .. now+1
    minute; the input dataset namespace is the rule's asset, else the asset
    found by system and entity (H24)."""
    now_c = F.to_timestamp_ntz(F.lit(now))
    base = selected.select(
        F.col("dq_tasks_id").alias("task_id"),
        X.deterministic_uuid(F.lit("run"), F.col("dq_tasks_id")).alias("run_id"),
        now_c.alias("nominal_start_time"),
        F.timestamp_add("MINUTE", F.lit(1), now_c).alias("nominal_end_time"),
        F.coalesce(F.col("data_asset_id"), F.col("data_asset_id1")).cast("string").alias("input_ns")).distinct()
    ev = F.explode(F.array(F.lit("START"), F.lit("COMPLETE"))).alias("event_type")
    out = base.select("task_id", "run_id", ev, "nominal_start_time", "nominal_end_time", "input_ns")
    return out.withColumn("input_ns", F.when(F.col("event_type") == "START", F.col("input_ns")))
