"""Dates, datetimes and times: spans, comparison at a precision, arithmetic, durations and differences."""

from __future__ import annotations

import datetime as dt
import re

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import SemanticFault
from ..plans.types import DATE, DT, INT, SPAN, TIME, UNC, Type, Val, let, span_of

PRECISION = {"year": 1, "month": 2, "day": 3, "hour": 4, "minute": 5, "second": 6, "millisecond": 7}
#: Milliseconds of the units that have a fixed length.
MILLIS = {"week": 604_800_000, "day": 86_400_000, "hour": 3_600_000, "minute": 60_000, "second": 1000, "millisecond": 1}
#: UCUM time units and the calendar units they stand for.
UCUM = {"wk": "week", "d": "day", "h": "hour", "min": "minute", "s": "second", "ms": "millisecond"}
_TEXT = re.compile(r"@?(\d{4})?(?:-(\d\d))?(?:-(\d\d))?(T)?(?:(\d\d)(?::(\d\d)(?::(\d\d)(?:\.(\d+))?)?)?)?(Z|[+-]\d\d:\d\d)?$")
EPOCH = dt.datetime(1970, 1, 1)


def unit_of(text: str) -> str:
    """The calendar unit of a quantity's unit text, or the text itself."""
    unit = UCUM.get(text, text)
    return unit[:-1] if unit.endswith("s") and unit[:-1] in (*PRECISION, "week") else unit


def _ntz(value: dt.datetime) -> Column:
    return F.lit(value.isoformat(sep=" ")).cast("timestamp_ntz")


def literal(text: str, kind: Type) -> Val:
    """A literal as a native column if all its digits are there, else as a span."""
    m = _TEXT.match(text)
    if not m:
        raise SemanticFault(f"{text} is no {kind.name}")
    y, mo, d, _, h, mi, s, ms, off = m.groups()
    parts = [x for x in ([y, mo, d] if kind.name == "Date" else [y, mo, d, h, mi, s, ms] if kind.name == "DateTime" else ["1970", "01", "01", h, mi, s, ms]) if x is not None]
    prec = len(parts)
    full = {"Date": 3, "DateTime": 7, "Time": 7}[kind.name]
    lo = [1970, 1, 1, 0, 0, 0, 0]
    hi = [9999, 12, 31, 23, 59, 59, 999]
    for k, x in enumerate(parts):
        lo[k] = hi[k] = int((x + "00")[:3]) if k == 6 else int(x)
    if prec < 3:
        nxt = dt.date(hi[0] + (hi[1] == 12), hi[1] % 12 + 1, 1) if hi[0] < 9999 else dt.date(9999, 12, 31)
        hi[2] = (nxt - dt.timedelta(days=1)).day if hi[0] < 9999 else 31
    try:
        at = [dt.datetime(*x[:6], x[6] * 1000) for x in (lo, hi)]
    except ValueError as e:
        raise SemanticFault(f"{text}: {e}") from None
    if prec == full and off is None:
        if kind == DATE:
            return Val(F.lit(at[0].date()), DATE, at[0].date())
        if kind == TIME:
            ms_of_day = (at[0] - EPOCH) // dt.timedelta(milliseconds=1)
            return Val(F.lit(ms_of_day).cast("bigint"), TIME, ms_of_day)
        return Val(_ntz(at[0]), DT, at[0])
    minutes = None if off is None else 0 if off == "Z" else (1 if off[0] == "+" else -1) * (int(off[1:3]) * 60 + int(off[4:]))
    col = F.struct(_ntz(at[0]).alias("lo"), _ntz(at[1]).alias("hi"), F.lit(prec).alias("prec"), F.lit(minutes).cast("int").alias("off"))
    return Val(col, span_of(kind))


def millis(col: Column) -> Column:
    """Milliseconds since 1970 of a timestamp_ntz."""
    return F.unix_millis(col.cast("timestamp"))


def from_millis(col: Column) -> Column:
    return F.timestamp_millis(col).cast("timestamp_ntz")


def to_span(v: Val) -> Val:
    """Any temporal value as a span."""
    t = v.type
    if t.span:
        return v
    if t == DATE:
        lo = v.col.cast("timestamp_ntz")
        hi, prec = lo + F.expr("INTERVAL '23:59:59.999' HOUR TO SECOND"), 3
    elif t == TIME:
        lo = hi = from_millis(v.col)
        prec = 7
    else:
        lo = hi = v.col
        prec = 7
    col = F.when(v.col.isNotNull(), F.struct(lo.alias("lo"), hi.alias("hi"), F.lit(prec).alias("prec"), F.lit(None).cast("int").alias("off")))
    return Val(col.cast(SPAN), span_of(t))


def as_type(v: Val, t: Type) -> Val:
    """A date as a datetime and the reverse; spans stay spans."""
    if v.type == t:
        return v
    if t.span:
        return Val(to_span(v).col, t)
    if v.type.span:
        return Val({"Date": v["lo"].cast("date"), "DateTime": v["lo"], "Time": millis(v["lo"])}[t.name], t)
    return Val(v.col.cast(t.ddl), t)


def _end(lo: Column, prec: Column | int) -> Column:
    """Last millisecond of the unit that begins at lo."""
    out = lo
    for unit, p in PRECISION.items():
        if p < 7:
            out = F.when(F.lit(prec) == p if isinstance(prec, int) else prec == p, lo + F.expr(f"INTERVAL 1 {unit.upper()}") - F.expr("INTERVAL '0.001' SECOND")).otherwise(out)
    return out


def truncated(v: Val, unit: str) -> Val:
    """A value without the digits below a unit."""
    p = PRECISION.get(unit, 3)
    if not v.type.span:
        if v.type == DATE:
            return Val(F.trunc(v.col, unit) if p < 3 or unit == "week" else v.col, DATE)
        if v.type == TIME:
            return Val(v.col - v.col % MILLIS[unit], TIME)
        return Val(F.date_trunc(unit, v.col.cast("timestamp")).cast("timestamp_ntz") if unit != "millisecond" else v.col, DT)

    def cut(c):
        lo = F.date_trunc(unit, c["lo"].cast("timestamp")).cast("timestamp_ntz") if unit != "millisecond" else c["lo"]
        return F.when(c["prec"] > p, F.struct(lo.alias("lo"), _end(lo, p).alias("hi"), F.lit(p).alias("prec"), c["off"].alias("off"))).otherwise(c)

    return Val(let({"c": v.col}, cut), v.type)


def compare(a: Val, b: Val, unit: str | None = None) -> Column:
    """-1, 0 or 1; null if an operand is null or the digits don't tell."""
    if unit:
        a, b = truncated(a, unit), truncated(b, unit)
    if a.type == b.type and not a.type.span:
        return F.when(a.col < b.col, -1).when(a.col > b.col, 1).when(a.col == b.col, 0)
    x, y = to_span(a), to_span(b)
    return let({"a": x.col, "b": y.col}, lambda p, q: _compare_spans(Val(p, x.type), Val(q, y.type)))


def _compare_spans(a: Val, b: Val) -> Column:
    one = a["off"].isNull() != b["off"].isNull()
    shift = lambda v, c: F.when(a["off"].isNotNull() & b["off"].isNotNull(), v[c] - F.make_dt_interval(mins=v["off"])).otherwise(v[c])
    hours = lambda v, early, late: (F.when(one & v["off"].isNull(), v["lo"] - F.expr(f"INTERVAL {early} HOUR")).when(one, v["lo"] - F.make_dt_interval(mins=v["off"])).otherwise(shift(v, "lo")), F.when(one & v["off"].isNull(), v["hi"] + F.expr(f"INTERVAL {late} HOUR")).when(one, v["hi"] - F.make_dt_interval(mins=v["off"])).otherwise(shift(v, "hi")))
    (alo, ahi), (blo, bhi) = hours(a, 14, 12), hours(b, 14, 12)
    same = ~one & (a["prec"] == b["prec"]) & (alo == blo)
    return F.when(a.null | b.null, F.lit(None)).when(ahi < blo, -1).when(alo > bhi, 1).when(same, 0)


def component(v: Val, unit: str) -> Val:
    """A component as an Integer, or the date or time part."""
    if unit == "week":
        raise SemanticFault("there is no week component")
    if unit in ("timezone", "timezoneoffset"):
        return Val((to_span(v)["off"] / 60).cast("decimal(28,8)"), Type("Decimal"))
    if unit == "date":
        if v.type.span:
            s = v if v.type.name == "DateTime" else to_span(v)
            return Val(F.when(s["prec"] >= 3, truncated(s, "day").col).otherwise(s.col), span_of(DATE))
        return Val(v.col.cast("date"), DATE)
    if unit == "time":
        s = v if not v.type.span else Val(v["lo"], DT)
        return Val(millis(s.col) % MILLIS["day"], TIME)
    p = PRECISION[unit]
    at = v.col if not v.type.span else v["lo"]
    if v.type == TIME:
        at = from_millis(v.col)
    if v.type.name == "Date" and p > 3 and not v.type.span:
        return Val(F.lit(None).cast("bigint"), INT)
    get = {"year": F.year, "month": F.month, "day": F.dayofmonth, "hour": F.hour, "minute": F.minute, "second": F.second}
    out = (get[unit](at) if unit in get else millis(at) % 1000).cast("bigint")
    return Val(F.when(v["prec"] >= p, out) if v.type.span else out, INT)


def shifted(at: Column, amount: Column, unit: str) -> Column:
    """A timestamp moved by whole units; months and years end on the last day there is."""
    n = amount.cast("int")
    if unit == "year":
        return at + F.make_ym_interval(n, F.lit(0))
    if unit == "month":
        return at + F.make_ym_interval(F.lit(0), n)
    return from_millis(millis(at) + amount.cast("bigint") * MILLIS[unit])


def add(v: Val, amount: Column, unit: str, sign: int = 1) -> Val:
    """A temporal value plus or minus a quantity; the fraction of the amount is cut off."""
    unit = unit_of(unit)
    if unit not in (*PRECISION, "week"):
        raise SemanticFault(f"{unit!r} is no calendar unit")
    if v.type.span:
        return Val(let({"v": v.col, "n": amount}, lambda c, n: _add_span(Val(c, v.type), n, unit, sign)), v.type)
    n = F.when(amount < 0, F.ceil(amount)).otherwise(F.floor(amount)).cast("bigint") * sign
    if v.type == TIME:
        if unit not in ("hour", "minute", "second", "millisecond"):
            raise SemanticFault(f"a time has no {unit}")
        return Val(F.pmod(v.col + n * MILLIS[unit], F.lit(MILLIS["day"])), TIME)
    if v.type == DATE and unit in ("hour", "minute", "second", "millisecond"):
        n, unit = (n * MILLIS[unit] / MILLIS["day"]).cast("bigint"), "day"
    return Val(shifted(v.col.cast("timestamp_ntz"), n, unit).cast(v.type.ddl), v.type)


def _add_span(v: Val, amount: Column, unit: str, sign: int) -> Column:
    n = F.when(amount < 0, F.ceil(amount)).otherwise(F.floor(amount)).cast("bigint") * sign
    # finer than what is written: whole units of the written precision
    prec, out = v["prec"], None
    steps = {"year": 365 * MILLIS["day"], "month": 30 * MILLIS["day"], **MILLIS}
    for name, p in PRECISION.items():
        if unit == "week":
            fine, k, u = p < 3, n * 7, "day"
        else:
            fine, k, u = p < PRECISION[unit], n, unit
        if fine:
            k, u = ((k / 12) if (u, name) == ("month", "year") else (k * steps[u] / steps[name])).cast("bigint"), name
        lo = shifted(v["lo"], k, u)
        one = F.struct(lo.alias("lo"), _end(lo, p).alias("hi"), prec.alias("prec"), v["off"].alias("off"))
        out = F.when(prec == p, one) if out is None else out.when(prec == p, one)
    return out


def _whole(a: Column, b: Column, unit: str) -> Column:
    """Whole units from one timestamp to another; months and years by the calendar day, the time of day set aside."""
    months = (F.year(b) - F.year(a)) * 12 + F.month(b) - F.month(a)
    if unit in ("month", "year"):
        day = (F.dayofmonth(b) - F.dayofmonth(a)).cast("bigint")
        m = months.cast("bigint")
        m = F.when((m > 0) & (day < 0), m - 1).when((m < 0) & (day > 0), m + 1).otherwise(m)
        return m if unit == "month" else _div(m, 12)
    return _div(millis(b) - millis(a), MILLIS[unit])


def _div(a: Column, n: int) -> Column:
    """Integer division towards zero."""
    return ((a - a % n) / n).cast("bigint")


def _boundaries(a: Column, b: Column, unit: str) -> Column:
    """Boundaries crossed between two timestamps; weeks begin on Sunday."""
    if unit in ("year", "month"):
        y = (F.year(b) - F.year(a)).cast("bigint")
        return y if unit == "year" else y * 12 + (F.month(b) - F.month(a)).cast("bigint")
    if unit in ("week", "day"):
        day = lambda c: F.datediff(c.cast("date"), F.lit(dt.date(1970, 1, 4))).cast("bigint")
        return day(b) - day(a) if unit == "day" else F.floor(day(b) / 7) - F.floor(day(a) / 7)
    cut = lambda c: F.floor(millis(c) / MILLIS[unit])
    return (cut(b) - cut(a)).cast("bigint")


def between(a: Val, b: Val, unit: str, boundaries: bool) -> Val:
    """Duration or difference in units; an Uncertainty if the digits leave it open."""
    count = _boundaries if boundaries else _whole
    if not a.type.span and not b.type.span:
        at = lambda v: from_millis(v.col) if v.type == TIME else v.col.cast("timestamp_ntz")
        return Val(count(at(a), at(b), unit), INT)

    def bounds(p, q):
        return let({"x": count(p["hi"], q["lo"], unit), "y": count(p["lo"], q["hi"], unit)}, lambda x, y: F.when(p.isNull() | q.isNull(), F.lit(None)).otherwise(F.struct(F.least(x, y).alias("low"), F.greatest(x, y).alias("high"))))

    return Val(let({"p": to_span(a).col, "q": to_span(b).col}, bounds), UNC)


def parse(text: Column, kind: Type) -> Val:
    """A string as a span; null if it is none."""
    rx = {"Date": r"^(\d{4})(?:-(\d\d))?(?:-(\d\d))?$", "DateTime": r"^(\d{4})(?:-(\d\d))?(?:-(\d\d))?T?(?:(\d\d))?(?::(\d\d))?(?::(\d\d))?(?:\.(\d{1,3})\d*)?(Z|[+-]\d\d:\d\d)?$", "Time": r"^T?()()()(\d\d)(?::(\d\d))?(?::(\d\d))?(?:\.(\d{1,3})\d*)?(?:Z|[+-]\d\d:\d\d)?$"}[kind.name]
    n = 3 if kind.name == "Date" else 7
    found = F.array(*(F.nullif(F.regexp_extract(text, rx, k + 1), F.lit("")) for k in range(8 if kind.name == "DateTime" else n)))
    return Val(F.when(text.rlike(rx), let({"g": found}, lambda g: _build(g, kind, n))), span_of(kind))


def _build(g: Column, kind: Type, n: int) -> Column:
    """A span from the texts of the components."""
    got = [g[k] for k in range(n)] + [F.lit(None).cast("string")] * (7 - n)
    if kind.name == "Time":
        got[:3] = [F.lit("1970"), F.lit("01"), F.lit("01")]
    prec = sum((x.isNotNull().cast("int") for x in got[1:]), got[0].isNotNull().cast("int"))
    num = lambda k, d: F.coalesce(got[k].cast("int"), F.lit(d))
    day = F.try_to_date(F.format_string("%04d-%02d-%02d", num(0, 1), num(1, 1), num(2, 1)))
    ms = F.coalesce(F.rpad(got[6], 3, "0").cast("bigint"), F.lit(0))
    ok = (num(3, 0) < 24) & (num(4, 0) < 60) & (num(5, 0) < 60)
    lo = from_millis(millis(day.cast("timestamp_ntz")) + num(3, 0).cast("bigint") * MILLIS["hour"] + num(4, 0).cast("bigint") * MILLIS["minute"] + num(5, 0).cast("bigint") * 1000 + ms)
    off = F.lit(None).cast("int")
    if kind.name == "DateTime":
        o = g[7]
        off = F.when(o == "Z", 0).when(o.isNotNull(), F.when(F.substring(o, 1, 1) == "-", -1).otherwise(1) * (F.substring(o, 2, 2).cast("int") * 60 + F.substring(o, 5, 2).cast("int")))
    span = lambda lo, prec: F.struct(lo.alias("lo"), _end(lo, prec).alias("hi"), prec.alias("prec"), off.alias("off"))
    return F.when((prec > 0) & ok & day.isNotNull(), let({"lo": lo, "prec": prec}, span))


def text_of(v: Val) -> Column:
    """The written form."""
    if v.type.span:
        s = v
        full = F.date_format(s["lo"], "yyyy-MM-dd'T'HH:mm:ss.SSS")
        length = F.element_at(F.array(*(F.lit(n) for n in (4, 7, 10, 13, 16, 19, 23))), s["prec"])
        out = F.substring(full, F.lit(1), length)
        if v.type.name == "Time":
            return F.substring(out, 12, 30)
        off = s["off"]
        zone = F.when(off.isNull(), "").when(off == 0, "Z").otherwise(F.concat(F.when(off < 0, "-").otherwise("+"), F.format_string("%02d:%02d", F.floor(F.abs(off) / 60).cast("int"), F.abs(off) % 60)))
        return F.concat(out, zone) if v.type.name == "DateTime" else out
    if v.type == DATE:
        return F.date_format(v.col, "yyyy-MM-dd")
    at = from_millis(v.col) if v.type == TIME else v.col
    return F.date_format(at, "HH:mm:ss.SSS" if v.type == TIME else "yyyy-MM-dd'T'HH:mm:ss.SSS")
