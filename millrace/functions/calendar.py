"""Cron expressions as columns: fields are bit sets, and the next fire is a search over them.

Both functions are Arrow functions: a batch's distinct expressions are parsed once each, and the fires of a batch's rows
are searched side by side, month by month, only those rows going on that have found none.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# Macros, names, and the bounds of the five fields.
MACROS = {"@yearly": "0 0 1 1 *", "@annually": "0 0 1 1 *", "@monthly": "0 0 1 * *", "@weekly": "0 0 * * 0", "@daily": "0 0 * * *", "@midnight": "0 0 * * *", "@hourly": "0 * * * *"}
MONTHS = ("jan", "feb", "mar", "apr", "may", "jun", "jul", "aug", "sep", "oct", "nov", "dec")
DAYS = ("sun", "mon", "tue", "wed", "thu", "fri", "sat")
FIELDS = (("minute", 0, 59, ()), ("hour", 0, 23, ()), ("dom", 1, 31, ()), ("month", 1, 12, MONTHS), ("dow", 0, 7, DAYS))
#: Months to search: a 29 February may be eight years away, and nothing is farther, since a weekday beside a day adds to it.
HORIZON_MONTHS = 12 * 8 + 2

SPEC = "struct<minute:bigint,hour:bigint,dom:bigint,month:bigint,dow:bigint,dom_any:boolean,dow_any:boolean>"
_SPEC = pa.struct([*((name, pa.int64()) for name, *_ in FIELDS), ("dom_any", pa.bool_()), ("dow_any", pa.bool_())])
#: The days of a month that are k weekdays behind its first one, as bits.
_WEEKLY = [sum(1 << d for d in range(1, 32) if (d - 1) % 7 == k) for k in range(7)]
_MINUTE = 60_000_000  # microseconds


def _field(text: str, lo: int, hi: int, names: tuple[str, ...]) -> int | None:
    """A field's values as bits; None where one of its items is no value, range or step, or out of bounds."""
    known = {n: lo + k for k, n in enumerate(names)}

    def number(x: str) -> int | None:
        return int(x) if re.fullmatch("[0-9]{1,9}", x) else known.get(x.lower())

    bits = 0
    for item in text.split(","):
        base, stepped, step_text = item.partition("/")
        step = 1 if not stepped else int(step_text) if re.fullmatch("[0-9]{1,9}", step_text) else None
        start, ranged, end = base.partition("-")
        first = lo if base == "*" else number(start if ranged else base)
        if step is None or step < 1 or first is None:
            return None
        last = hi if base == "*" else number(end) if ranged else max(hi, first) if stepped else first
        if last is None or not lo <= first <= last:
            return None
        # the values are what counts: a range may end beyond the bound if its step never gets there
        top = first + (last - first) // step * step
        if top > hi:
            return None
        bits |= sum(1 << v for v in range(first, top + 1, step))
    return bits


def _spec(expr: str | None) -> dict | None:
    if expr is None:
        return None
    text = re.sub(r"[ \t\n\x0b\f\r]+", " ", expr).strip(" ")
    parts = MACROS.get(text, text).split(" ")
    if len(parts) != len(FIELDS):
        return None
    bits = {name: _field(part, lo, hi, names) for part, (name, lo, hi, names) in zip(parts, FIELDS, strict=True)}
    if None in bits.values():
        return None
    bits["dow"] = (bits["dow"] | bits["dow"] >> 7) & 127
    return bits | {"dom_any": parts[2] == "*", "dow_any": parts[4] == "*"}


def parse_cron(expr: Column) -> Column:
    """Struct of minute, hour, dom, month and dow (bits; Sunday is bit 0) and of dom_any and dow_any (the field is ``*``);
    null for what is no expression of five fields or a macro.
    """

    def parsed(texts: pa.Array) -> pa.Array:
        coded = texts.dictionary_encode()
        known = pa.array([_spec(x) for x in coded.dictionary.to_pylist()], _SPEC)
        return known.take(coded.indices)

    return F.arrow_udf(parsed, SPEC)(expr.cast("string"))


def _from(bits: np.ndarray, least: np.ndarray | int) -> np.ndarray:
    """The smallest bit from ``least`` on; -1 for none."""
    rest = bits & (np.int64(-1) << np.asarray(least, np.int64))
    return np.where(rest != 0, np.frexp((rest & -rest).astype(float))[1] - 1, -1).astype(np.int64)


def _days(spec: dict[str, np.ndarray], month: np.ndarray) -> np.ndarray:
    """The days of a month (counted from January 1970) on which a spec fires, as bits. Day and weekday both count where
    both are given: one of them is enough.
    """
    first, after = (m.astype("datetime64[M]").astype("datetime64[D]").astype(np.int64) for m in (month, month + 1))
    by_week = np.zeros(len(month), np.int64)
    for k, days in enumerate(_WEEKLY):
        by_week |= np.where(spec["dow"] >> ((first + 4 + k) % 7) & 1, days, 0)  # 1 January 1970 was a Thursday
    days = np.where(spec["dom_any"], by_week, np.where(spec["dow_any"], spec["dom"], spec["dom"] | by_week))
    return np.where(spec["month"] >> (month % 12 + 1) & 1, days & ((np.int64(1) << (after - first + 1)) - 2), 0)


def _in_day(spec: dict[str, np.ndarray], minute: np.ndarray) -> np.ndarray:
    """The first minute of a day, from ``minute`` on, at which a spec fires; -1 for none."""
    hour = minute // 60
    same = np.where(spec["hour"] >> hour & 1, _from(spec["minute"], minute % 60), -1)
    later, start = _from(spec["hour"], hour + 1), _from(spec["minute"], 0)
    return np.where(same >= 0, hour * 60 + same, np.where((later >= 0) & (start >= 0), later * 60 + start, -1))


def _next_fires(spec: dict[str, np.ndarray], after: np.ndarray) -> np.ndarray:
    """The minutes since 1970 at which specs fire next behind the minutes ``after``; the smallest number where none comes."""
    day, minute = np.divmod(after + 1, 1440)
    month = day.astype("datetime64[D]").astype("datetime64[M]")
    of_month = day - month.astype("datetime64[D]").astype(np.int64) + 1
    month = month.astype(np.int64)
    now = np.where(_days(spec, month) >> of_month & 1, _in_day(spec, minute), -1)
    out = np.where(now >= 0, day * 1440 + now, np.iinfo(np.int64).min)
    left = np.flatnonzero(now < 0)
    for n in range(HORIZON_MONTHS):
        some = {name: x[left] for name, x in spec.items()}
        at = _from(_days(some, month[left] + n), of_month[left] + 1 if n == 0 else 1)
        first = (month[left] + n).astype("datetime64[M]").astype("datetime64[D]").astype(np.int64)
        fires = (first + at - 1) * 1440 + _in_day(some, np.zeros(len(left), np.int64))
        out[left[at >= 0]] = fires[at >= 0]
        left = left[at < 0]
        if not len(left):
            break
    return out


def next_fire(spec: Column, after: Column) -> Column:
    """The first time behind ``after`` (whole minutes, without zone) at which a ``parse_cron`` fires; null where none comes.

    The rest of today is searched by bits of hours and minutes; else the months ahead are, by bits of their days.
    """

    def fires(specs: pa.Array, times: pa.Array) -> pa.Array:
        good = pc.and_(specs.is_valid(), times.is_valid())
        some, at = specs.filter(good), times.filter(good).cast(pa.timestamp("us")).cast(pa.int64()).to_numpy()
        bits = {f.name: column.to_numpy(zero_copy_only=False) for f, column in zip(some.type, some.flatten(), strict=True)}
        out = np.full(len(specs), np.iinfo(np.int64).min)
        out[good.to_numpy(zero_copy_only=False)] = _next_fires(bits, at // _MINUTE)
        none = out == np.iinfo(np.int64).min
        return pa.array(np.where(none, 0, out) * _MINUTE, pa.int64(), mask=none).cast(pa.timestamp("us"))

    return F.arrow_udf(fires, "timestamp_ntz")(spec, after.cast("timestamp_ntz"))
