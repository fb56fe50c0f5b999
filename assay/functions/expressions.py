"""Scalar column helpers (section H of the survey): labels, messages, ids, time."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Assertion state codes.
STATE_ERROR = "0"
STATE_WARNING = "1"
STATE_OK = "2"

# State labels of the monitoring views (error, warning, ok,
# failed run, unfinished run).
LABEL_ERROR = "Ошибка"
LABEL_WARNING = "Предупреждение"
LABEL_OK = "Успешно"
LABEL_RUN_FAILED = "Ошибка выполнения"
LABEL_RUN_UNFINISHED = "Незавершен"

# Message templates of the checks, in their original wording.
MSG_DUPLICATE = 'Значение "{value}" повторяется {count} раз(а) в колонке {column};'
MSG_DUPLICATES_FOUND = "В таблице {table} найдены дубликаты: {message}"
MSG_NO_DUPLICATES = "Ошибок нет. Колонки {columns} не содержат дубликаты."
MSG_NULLS = "В колонке {column} {count} пустых значений;"
MSG_NULLS_FOUND = "В таблице {table} найдены пустые значения: {message}"
MSG_NO_NULLS = "Ошибок нет. Колонки {columns} не пустые."
MSG_RANGE = "В колонке {column} {count} значений вне диапазона {range};"
MSG_RANGE_FOUND = "В таблице {table} найдены записи вне диапазона: {message}"
MSG_RANGE_OK = "Ошибок нет. Колонки {columns} не содержат ошибок."
MSG_COUNT_NE = "В файле {path} к-во записей не равно {count}"
MSG_COUNT_EQ = "В файле {path} к-во записей  равно {count}"
MSG_RECORD_ID = "Идентификатор записи {id}"
MSG_FIELD_MISSING = "Поле {field} не заполнено(key - {key})"
MSG_FIELDS_MISSING = "Не заполнены обязательные поля: {message}"
MSG_FIELDS_OK = "Ошибок нет. Поля {fields} не пустые."
MSG_AVG_DEVIATION = "Поле {field} значительно отличается от среднего ({pct}%, key - {key})"
MSG_AVG_FOUND = "Поле значительно отличается от среднего: {message}"
MSG_AVG_OK = "Ошибок нет. Поля {fields} не отличаются от среднего."
MSG_TIME_EXPIRED = "Превышено время выполнения на {seconds} секунд"

#: Of a range check that met values it cannot be applied to.
MSG_UNREADABLE = "{count} values of {column} cannot be compared with {range}"

# Fixed value: rule id of the timeliness assertion.
TIMELINESS_RULE_ID = "389df21d-5294-4cd5-ad61-63b62ee07b54"

# Run event types.
EVENT_TYPES = ("START", "RUNNING", "COMPLETE", "ABORT", "FAIL", "OTHER")

UUID_PARTS = r"^(.{8})(.{4})(.{4})(.{4})(.{12})$"
ZONE_PATTERN = r"(Z|[+-]\d{2}(?::?\d{2})?)$"
# The forms that the library itself writes; they need no further work.
PLAIN_UUID = r"\A[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\z"
PLAIN_EVENT_TIME = r"\A\d{4}-\d{2}-\d{2}T\d{2}:\d{2}:\d{2}(?:\.\d{1,6})?\z"
EVENT_TIME_PATTERN = r"^\d{4}-\d{2}-\d{2}T\d{2}:\d{2}(?::\d{2}(?:\.\d{1,9})?)?(?:Z|[+-]\d{2}(?::?\d{2})?)?$"


def template(tpl: str, **parts) -> Column:
    """Fill a ``{name}`` template with columns or literals; JVM-side ``concat``.

    Null parts render as empty text (PostgreSQL ``concat`` semantics, H11).
    """
    pieces: list[Column] = []
    for i, chunk in enumerate(re.split(r"\{(\w+)\}", tpl)):
        if i % 2 == 0:
            if chunk:
                pieces.append(F.lit(chunk))
        else:
            v = parts[chunk]
            c = v if isinstance(v, Column) else F.lit(v)
            pieces.append(F.coalesce(c.cast("string"), F.lit("")))
    return F.concat(*pieces) if pieces else F.lit("")


def _bound(value: Column, f: Callable[[Column], Column]) -> Column:
    """``f`` of a value that it uses several times. As the variable of a lambda the value is computed once, and the code that
    Spark generates for a row of many such values stays small enough for the JVM to compile."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def concat_null_empty(*cols: Column) -> Column:
    """``concat`` where null parts are empty (Spark's concat is null-strict)."""
    return F.concat(*[F.coalesce(c.cast("string"), F.lit("")) for c in cols])


def state_label(state: Column) -> Column:
    """0 error, 1 warning, anything else (null too) ok."""
    return (F.when(state == STATE_ERROR, LABEL_ERROR)
            .when(state == STATE_WARNING, LABEL_WARNING)
            .otherwise(LABEL_OK))


def run_label(has_fail: Column, has_complete: Column, state: Column) -> Column:
    """Failed run, unfinished run, then the worst assertion state."""
    return (F.when(F.coalesce(has_fail, F.lit(False)), LABEL_RUN_FAILED)
            .when(~F.coalesce(has_complete, F.lit(False)), LABEL_RUN_UNFINISHED)
            .otherwise(state_label(state)))


def deviation_pct(value: Column, avg: Column) -> Column:
    """H4 with H7: ``100 * |avg - v| / |avg|``; null for a zero average."""
    return F.try_divide(F.lit(100.0) * F.abs(avg - value), F.abs(avg))


def threshold_state(pct: Column, warning: Column, error: Column) -> Column:
    """H5: above error -> 0, above warning -> 1, else 2; null pct -> null."""
    return (F.when(pct.isNull(), F.lit(None).cast("string"))
            .when(pct > error, STATE_ERROR)
            .when(pct > warning, STATE_WARNING)
            .otherwise(STATE_OK))


def iso_timestamp(ts: Column) -> Column:
    """ISO-8601 text with microseconds."""
    return F.date_format(ts, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")


def parse_event_time(s: Column) -> Column:
    """ISO-8601 with ``T``; seconds, fraction (to nanoseconds, kept to
    microseconds) and zone optional. Times with a zone are turned to UTC. A plain time is only cast."""
    def parse(t: Column) -> Column:
        zone = F.regexp_extract(t, ZONE_PATTERN, 1)  # empty without a zone
        wall = F.substring(F.regexp_replace(t, ZONE_PATTERN, ""), 1, 26)
        hhmm = F.rpad(F.regexp_replace(zone, r"[^0-9+-]", ""), 5, "0").try_cast("int")
        minutes = hhmm - 40 * (hhmm / F.lit(100)).cast("int")
        return F.when(t.rlike(EVENT_TIME_PATTERN), F.timestamp_add("MINUTE", -minutes, wall.try_cast("timestamp_ntz")))

    return F.when(s.rlike(PLAIN_EVENT_TIME), s.try_cast("timestamp_ntz")).otherwise(_bound(s, parse))


def seconds_between(start: Column, end: Column) -> Column:
    """``(end - start)`` in seconds as a double."""
    return F.timestamp_diff("MICROSECOND", start, end) / F.lit(1e6)


def float_text(x: Column) -> Column:
    """Plain decimal text of a double with at least one fractional digit and
    no exponent (``100224000.0``, ``0.5``), as Python prints such seconds."""
    t = F.regexp_replace(x.cast("decimal(38,6)").cast("string"), "0+$", "")
    return F.when(x.isNull(), F.lit(None)).otherwise(
        F.when(t.endswith("."), F.concat(t, F.lit("0"))).otherwise(t))


def uuid_text(s: Column) -> Column:
    """The canonical form of a UUID text (with or without dashes, braces and
    ``urn:uuid:``, any case); null if it is none. A text in that form is taken as it is."""
    plain = F.lower(F.regexp_replace(F.regexp_replace(s, "urn:|uuid:", ""), r"^[{}]+|[{}]+$|-", ""))
    other = _bound(plain, lambda p: F.when(p.rlike("^[0-9a-f]{32}$"), F.regexp_replace(p, UUID_PARTS, "$1-$2-$3-$4-$5")))
    return F.when(s.rlike(PLAIN_UUID), s).otherwise(other)


def is_uuid(s: Column) -> Column:
    return uuid_text(s).isNotNull()


def deterministic_uuid(*parts: Column) -> Column:
    """A stable run id in UUID form: the first 32 digits of the stable id."""
    return F.regexp_replace(F.substring(deterministic_id(*parts), 1, 32), UUID_PARTS, "$1-$2-$3-$4-$5")


def deterministic_id(*parts: Column) -> Column:
    """A stable id from the parts (replay gives the same id, no duplicates)."""
    return F.sha2(F.concat_ws(":", *[F.coalesce(p.cast("string"), F.lit("\u0000")) for p in parts]), 256)
