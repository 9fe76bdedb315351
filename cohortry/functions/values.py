"""Conversion, equality, order and arithmetic over typed columns."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import SemanticFault
from ..plans.types import ANY, BOOL, CODE, CONCEPT, DEC, DECIMAL, INT, QTY, REAL, STR, UNC, Type, Val, common, interval_of, let, none
from . import temporal as T

#: Units with their dimension and the factor to its base unit.
UNITS = {
    "1": ("1", "1"), "": ("1", "1"), "%": ("1", "0.01"),
    "g": ("g", "1"), "kg": ("g", "1000"), "mg": ("g", "0.001"), "ug": ("g", "0.000001"), "[lb_av]": ("g", "453.59237"),
    "m": ("m", "1"), "km": ("m", "1000"), "cm": ("m", "0.01"), "mm": ("m", "0.001"), "[in_i]": ("m", "0.0254"), "[ft_i]": ("m", "0.3048"),
    "L": ("L", "1"), "dL": ("L", "0.1"), "mL": ("L", "0.001"), "l": ("L", "1"), "ml": ("L", "0.001"),
    "wk": ("s", "604800"), "d": ("s", "86400"), "h": ("s", "3600"), "min": ("s", "60"), "s": ("s", "1"), "ms": ("s", "0.001"),
    "week": ("s", "604800"), "weeks": ("s", "604800"), "day": ("s", "86400"), "days": ("s", "86400"), "hour": ("s", "3600"), "hours": ("s", "3600"), "minute": ("s", "60"), "minutes": ("s", "60"), "second": ("s", "1"), "seconds": ("s", "1"), "millisecond": ("s", "0.001"), "milliseconds": ("s", "0.001"),
    "year": ("month", "12"), "years": ("month", "12"), "month": ("month", "1"), "months": ("month", "1"), "a": ("mo", "12"), "mo": ("mo", "1"),
    "cm2": ("m2", "0.0001"), "m2": ("m2", "1"), "mg/dL": ("g/L", "0.01"), "g/dL": ("g/L", "10"), "g/L": ("g/L", "1"), "mg/mL": ("g/L", "1"),
}


def dec(value) -> Column:
    return F.lit(Decimal(value)).cast(DECIMAL) if not isinstance(value, Column) else value.cast(DECIMAL)


def _lookup(unit: Column, k: int) -> Column:
    groups: dict[str, list[str]] = {}
    for name, entry in UNITS.items():
        groups.setdefault(entry[k], []).append(name)
    out = None
    for value, names in groups.items():
        got = F.lit(value) if k == 0 else F.lit(Decimal(value)).cast("decimal(20,8)")
        out = F.when(unit.isin(names), got) if out is None else out.when(unit.isin(names), got)
    return out.otherwise(unit if k == 0 else F.lit(Decimal(1)).cast("decimal(20,8)"))


def dimension(q: Column) -> Column:
    return _lookup(F.coalesce(q["unit"], F.lit("1")), 0)


def base(q: Column) -> Column:
    """The value in the base unit of its dimension."""
    return q["value"].cast("decimal(28,8)") * _lookup(F.coalesce(q["unit"], F.lit("1")), 1)


def converted(q: Column, unit: Column) -> Column:
    """A quantity in another unit; null if the dimensions differ."""
    value = F.when(q["unit"] == unit, q["value"]).when(dimension(q) == _lookup(unit, 0), (base(q).cast("decimal(38,16)") / _lookup(unit, 1)).cast(DECIMAL))
    return F.when(value.isNotNull(), quantity(value, unit))


def quantity(value: Column, unit: Column) -> Column:
    return F.struct(value.cast(DECIMAL).alias("value"), unit.alias("unit"))


def convert(v: Val, t: Type) -> Val:
    """The value as another type, where the language converts without being asked."""
    s = v.type
    if s == t:
        return v
    if s == ANY or t == ANY:
        return Val(v.col.cast(t.ddl), t) if s == ANY else v
    if s.number and t.number:
        return Val(v.col.cast(t.ddl), t, v.literal)
    if s.number and t == QTY:
        return Val(F.when(v.col.isNotNull(), quantity(v.col, F.lit("1"))), QTY)
    if s.temporal and t.temporal:
        return T.as_type(v, t)
    if s == CODE and t == CONCEPT:
        return Val(F.when(v.col.isNotNull(), F.struct(F.array(v.col).alias("codes"), v["display"].alias("display"))), CONCEPT)
    if s.name == t.name == "List":
        return Val(F.transform(v.col, lambda x: convert(Val(x, s.item), t.item).col), t)
    if s.name == t.name == "Interval":
        low, high = (convert(Val(v[c], s.item), t.item).col for c in ("low", "high"))
        return Val(F.when(v.col.isNotNull(), F.struct(low.alias("low"), high.alias("high"), v["lowClosed"].alias("lowClosed"), v["highClosed"].alias("highClosed"))), t)
    if s.name == t.name == "Tuple":
        parts = [convert(Val(v[n], x), t.field(n)).col.alias(n) for n, x in s.args]
        return Val(F.when(v.col.isNotNull(), F.struct(*parts)), t)
    if t.name == "Interval" and common(s, t.item):
        x = convert(v, t.item).col
        return Val(F.when(v.col.isNotNull(), F.struct(x.alias("low"), x.alias("high"), F.lit(True).alias("lowClosed"), F.lit(True).alias("highClosed"))), t)
    raise SemanticFault(f"{s} doesn't convert to {t}")


def unify(*vals: Val) -> tuple[list[Val], Type]:
    """All values as one type."""
    t = ANY
    for v in vals:
        u = common(t, v.type)
        if u is None:
            raise SemanticFault(f"{t} and {v.type} have no common type")
        t = u
    return [convert(v, t) for v in vals], t


_PLAIN = {"Boolean", "Integer", "Long", "Decimal", "Real", "String", "Any", "Vocabulary"}


def bound(f):
    """Operands that aren't plain columns are computed once."""

    def run(a: Val, b: Val) -> Column:
        if a.type.name in _PLAIN or b.type.name in _PLAIN or (a.type.temporal and b.type.temporal):
            return f(a, b)
        return let({"a": a.col, "b": b.col}, lambda x, y: f(Val(x, a.type), Val(y, b.type)))

    return run


@bound
def equal(a: Val, b: Val) -> Column:
    """`=`: null where an operand is, or where it can't be told."""
    if UNC in (a.type, b.type):
        a, b = (x if x.type == UNC else Val(F.struct(x.col.alias("low"), x.col.alias("high")), UNC) for x in (a, b))
        return F.when(a.null | b.null, F.lit(None)).when((a["high"] < b["low"]) | (a["low"] > b["high"]), False).when((a["low"] == a["high"]) & (b["low"] == b["high"]), True)
    if common(a.type, b.type) is None:
        return F.lit(False) if not (a.type == ANY or b.type == ANY) else F.lit(None).cast("boolean")
    if a.type.temporal and b.type.temporal:
        c = T.compare(a, b)
        return c == 0
    if "Real" in (a.type.name, b.type.name) and a.type.number and b.type.number:
        return a.col.cast("double") == b.col.cast("double")
    (a, b), t = unify(a, b)
    if t == QTY:
        cal = {"month", "mo"}
        da, db = dimension(a.col), dimension(b.col)
        return F.when(da.isin(*cal) & db.isin(*cal) & (da != db), F.lit(None)).otherwise(F.when(da == db, base(a.col) == base(b.col)).otherwise(F.when(a.null | b.null, F.lit(None)).otherwise(False)))
    if t == CODE:
        return F.when(a.null | b.null, F.lit(None)).otherwise(a["code"].eqNullSafe(b["code"]) & a["system"].eqNullSafe(b["system"]))
    if t == CONCEPT:
        key = lambda v: F.transform(v["codes"], lambda c: F.struct(c["system"], c["code"]))
        return F.when(a.null | b.null, F.lit(None)).otherwise(key(a) == key(b))
    if t.name == "Tuple":
        out = F.lit(True)
        for n, x in reversed(t.args):  # the first decisive field wins
            p, q = Val(a[n], x), Val(b[n], x)
            out = F.when(p.null & q.null, out).otherwise(F.when(equal(p, q) == F.lit(True), out).otherwise(equal(p, q)))
        return F.when(a.null | b.null, F.lit(None)).otherwise(out)
    if t.name == "Interval":
        return F.when(a.null | b.null, F.lit(None)).otherwise(equal(start(a), start(b)) & equal(end(a), end(b)))
    if t.name == "List":
        both = F.zip_with(a.col, b.col, lambda x, y: F.coalesce(same(Val(x, t.item), Val(y, t.item)), F.lit(False)))
        return F.when(a.null | b.null, F.lit(None)).otherwise((F.size(a.col) == F.size(b.col)) & F.forall(both, lambda x: x))
    return a.col == b.col


def same(a: Val, b: Val) -> Column:
    """Equality of elements: nulls equal each other, unknown counts as different."""
    return (a.null & b.null) | F.coalesce(equal(a, b), F.lit(False))


@bound
def equivalent(a: Val, b: Val) -> Column:
    """`~`: never null."""
    both = a.null & b.null
    if common(a.type, b.type) is None:
        return both
    (a, b), t = unify(a, b)
    if t == STR:
        fold = lambda c: F.lower(F.regexp_replace(c, r"\s+", " "))
        out = fold(a.col) == fold(b.col)
    elif t == DEC or t == REAL:
        scale = lambda c: F.length(F.regexp_extract(c.cast(DECIMAL).cast("string"), r"\.(\d*?)0*$", 1))
        n = F.least(scale(a.col), scale(b.col))
        out = F.floor(F.abs(a.col.cast(DECIMAL)) * F.pow(F.lit(10), n) + 0.5) * F.signum(a.col) == F.floor(F.abs(b.col.cast(DECIMAL)) * F.pow(F.lit(10), n) + 0.5) * F.signum(b.col)
    elif t == CODE:
        out = (F.lower(a["code"]) == F.lower(b["code"])) & F.lower(a["system"]).eqNullSafe(F.lower(b["system"]))
    elif t == CONCEPT:
        key = lambda v: F.transform(v["codes"], lambda c: F.lower(F.concat_ws("|", F.coalesce(c["system"], F.lit("")), c["code"])))
        out = F.arrays_overlap(key(a), key(b))
    elif t == QTY:
        cal = lambda v: F.regexp_replace(dimension(v.col), "^month$", "mo")
        out = (cal(a) == cal(b)) & (base(a.col) == base(b.col))
    elif t.name == "List":
        count = lambda xs, x: F.size(F.filter(xs, lambda y: equivalent(Val(x, t.item), Val(y, t.item))))
        out = (F.size(a.col) == F.size(b.col)) & F.forall(a.col, lambda x: count(a.col, x) == count(b.col, x))
    elif t.name == "Tuple":
        out = F.lit(True)
        for n, x in t.args:
            out = out & equivalent(Val(a[n], x), Val(b[n], x))
    elif t.name == "Interval":
        out = equivalent(start(a), start(b)) & equivalent(end(a), end(b))
    else:
        out = equal(a, b)
    return both | F.coalesce(~a.null & ~b.null & out, F.lit(False))


def order(a: Val, b: Val, unit: str | None = None) -> Column:
    """-1, 0 or 1; null where it can't be told."""
    if UNC in (a.type, b.type):
        a, b = (x if x.type == UNC else Val(F.struct(x.col.alias("low"), x.col.alias("high")), UNC) for x in (a, b))
        return F.when(a["high"] < b["low"], -1).when(a["low"] > b["high"], 1).when((a["low"] == b["high"]) & (a["high"] == b["low"]), 0)
    if a.type.temporal and b.type.temporal:
        return T.compare(a, b, unit)
    (a, b), t = unify(a, b)
    x, y = a.col, b.col
    if t == QTY:
        x, y = F.when(dimension(a.col) == dimension(b.col), base(a.col)), base(b.col)
    elif not (t.number or t in (STR, ANY, BOOL)):
        raise SemanticFault(f"{t} has no order")
    return F.when(x < y, -1).when(x > y, 1).when(x == y, 0)


def relation(op: str, a: Val, b: Val, unit: str | None = None) -> Column:
    """< <= > >=; a plain comparison where both are native, so that it can reach the scan."""
    if UNC in (a.type, b.type):
        a, b = (x if x.type == UNC else Val(F.struct(x.col.alias("low"), x.col.alias("high")), UNC) for x in (a, b))
        yes, no = {"<": (a["high"] < b["low"], a["low"] >= b["high"]), "<=": (a["high"] <= b["low"], a["low"] > b["high"]), ">": (a["low"] > b["high"], a["high"] <= b["low"]), ">=": (a["low"] >= b["high"], a["high"] < b["low"])}[op]
        return F.when(yes, True).when(no, False)
    plain = {"<": lambda x, y: x < y, "<=": lambda x, y: x <= y, ">": lambda x, y: x > y, ">=": lambda x, y: x >= y}[op]
    if "Real" in (a.type.name, b.type.name) and a.type.number and b.type.number:
        return plain(a.col.cast("double"), b.col.cast("double"))
    if unit is None and a.type == b.type and not a.type.span and (a.type.temporal or a.type.number or a.type == STR):
        return plain(a.col, b.col)
    c = order(a, b, unit)
    return {"<": c < 0, "<=": c <= 0, ">": c > 0, ">=": c >= 0}[op]


# arithmetic

_INVERSE = {"+": "-", "-": "+"}


def arithmetic(op: str, a: Val, b: Val) -> Val:
    """+ - * / div mod ^ and &."""
    if "Quantity" in (a.type.name, b.type.name) and not (a.type.temporal or b.type.temporal) and ANY not in (a.type, b.type):
        return Val(let({"a": a.col, "b": b.col}, lambda x, y: _arithmetic(op, Val(x, a.type), Val(y, b.type)).col), QTY)
    return _arithmetic(op, a, b)


def _arithmetic(op: str, a: Val, b: Val) -> Val:
    if op == "&":
        return Val(F.concat(*(F.coalesce(text(x), F.lit("")) for x in (a, b))), STR)
    if a.type == ANY and b.type == ANY:
        return none(INT)
    if a.type == ANY or b.type == ANY:
        other = b if a.type == ANY else a
        if other.type.temporal:
            return none(other.type)
        a, b = (convert(x, other.type) for x in (a, b))
    if a.type == STR and b.type == STR and op == "+":
        return Val(F.concat(a.col, b.col), STR)
    if a.type.temporal and b.type == QTY and op in "+-":
        sign = 1 if op == "+" else -1
        if b.literal:
            return T.add(a, F.lit(Decimal(b.literal[0])), b.literal[1], sign)
        out = None
        for unit in ("year", "month", "week", "day", "hour", "minute", "second", "millisecond"):
            if a.type == T.TIME and unit in ("year", "month", "week", "day"):
                continue
            names = [n for n in UNITS if T.unit_of(n) == unit]
            one = T.add(a, b["value"], unit, sign).col
            out = F.when(b["unit"].isin(names), one) if out is None else out.when(b["unit"].isin(names), one)
        return Val(out, a.type)
    if UNC in (a.type, b.type) and op in "+-*":
        a, b = (x if x.type == UNC else Val(F.struct(x.col.alias("low"), x.col.alias("high")), UNC) for x in (a, b))
        f = {"+": lambda x, y: x + y, "-": lambda x, y: x - y, "*": lambda x, y: x * y}[op]
        four = [f(a[i], b[j]) for i in ("low", "high") for j in ("low", "high")]
        return Val(F.when(~a.null & ~b.null, F.struct(F.least(*four).alias("low"), F.greatest(*four).alias("high"))), UNC)
    if a.type.name == b.type.name == "Interval" and op in "+-*/":
        four = [arithmetic(op, Val(a[i], a.type.item), Val(b[j], b.type.item)) for i in ("low", "high") for j in ("low", "high")]
        low, high = F.least(*(x.col for x in four)), F.greatest(*(x.col for x in four))
        return Val(F.when(~a.null & ~b.null, F.struct(low.alias("low"), high.alias("high"), F.lit(True).alias("lowClosed"), F.lit(True).alias("highClosed"))), interval_of(four[0].type))
    if QTY in (a.type, b.type):
        if op in "*/" and not (a.type == QTY and b.type == QTY):
            q, n = (a, b) if a.type == QTY else (b, a)
            if op == "/" and a.type != QTY:
                a, b = convert(a, QTY), b
            else:
                value = dec(q["value"]) * dec(n.col) if op == "*" else F.try_divide(dec(q["value"]), dec(n.col))
                return Val(F.when(value.isNotNull(), quantity(value, q["unit"])), QTY)
        a, b = convert(a, QTY), convert(b, QTY)
        if op in "+-":
            other = F.when(b["unit"] == a["unit"], b["value"]).otherwise(converted(b.col, a["unit"])["value"])
            value = a["value"] + other if op == "+" else a["value"] - other
            return Val(F.when(value.isNotNull(), quantity(value, a["unit"])), QTY)
        ua, ub = F.coalesce(a["unit"], F.lit("1")), F.coalesce(b["unit"], F.lit("1"))
        if op == "*":
            unit = F.when(ua == "1", ub).when(ub == "1", ua).when(ua == ub, F.concat(ua, F.lit("2"))).otherwise(F.concat(ua, F.lit("."), ub))
            value = dec(a["value"]) * dec(b["value"])
        else:
            unit = F.when(ua == ub, "1").when(ub == "1", ua).otherwise(F.concat(ua, F.lit("/"), ub))
            value = F.try_divide(dec(a["value"]), dec(b["value"]))
        return Val(F.when(value.isNotNull(), quantity(value, unit)), QTY)
    if not (a.type.number and b.type.number):
        raise SemanticFault(f"{op} isn't defined for {a.type} and {b.type}")
    whole = a.type.name in ("Integer", "Long") and b.type.name in ("Integer", "Long")
    t = (a.type if RANKED[a.type.name] >= RANKED[b.type.name] else b.type) if whole else DEC
    x, y = (a.col, b.col) if whole else (dec(a.col), dec(b.col))
    if op in "+-*" and len(op) == 1:
        out = x + y if op == "+" else x - y if op == "-" else x * y
        return Val(out.cast(t.ddl), t)
    if op == "/":
        return Val(F.try_divide(dec(a.col), dec(b.col)).cast(DECIMAL), DEC)
    safe = F.nullif(y, F.lit(0).cast(t.ddl))
    if op == "div":
        q = x / safe if not whole else (x - x % safe) / safe
        return Val(F.when(q < 0, F.ceil(q)).otherwise(F.floor(q)).cast("bigint").cast(t.ddl), t)
    if op == "mod":
        return Val((x % safe).cast(t.ddl), t)
    if op == "^":
        return power(a, b)
    raise SemanticFault(f"unknown operator {op}")


RANKED = {"Integer": 1, "Long": 2}


def power(a: Val, b: Val) -> Val:
    """An Integer only where the exponent is known not to be negative: a literal."""
    whole = a.type.name in ("Integer", "Long") and b.type.name in ("Integer", "Long") and isinstance(b.literal, str) and not b.literal.startswith("-")
    p = F.pow(a.col.cast("double"), b.col.cast("double"))
    p = F.when(F.isnan(p) | (F.abs(p) > 1e19), F.lit(None)).otherwise(p)
    return Val(F.round(p, 8).cast("bigint"), INT) if whole else Val(F.round(p, 8).cast(DECIMAL), DEC)


def negate(v: Val) -> Val:
    if v.type == QTY:
        return Val(F.when(~v.null, quantity(-v["value"], v["unit"])), QTY, (f"-{v.literal[0]}", v.literal[1]) if v.literal else None)
    if not v.type.number and v.type != ANY:
        raise SemanticFault(f"{v.type} has no negative")
    return Val(-v.col, v.type) if v.type != ANY else none(INT)


def step(v: Val, sign: int) -> Val:
    """successor (1) and predecessor (-1)."""
    t = v.type
    if t.name in ("Integer", "Long"):
        edge = (2**31 - 1 if sign > 0 else -(2**31)) if t == INT else (2**63 - 1 if sign > 0 else -(2**63))
        return Val(F.when(v.col == F.lit(edge).cast("bigint"), F.raise_error("the value has no " + ("successor" if sign > 0 else "predecessor")).cast("bigint")).otherwise(v.col + sign), t)
    if t.name in ("Decimal", "Real"):
        return Val((dec(v.col) + dec("0.00000001") * sign).cast(DECIMAL), DEC)
    if t == QTY:
        return Val(F.when(~v.null, quantity(v["value"] + dec("0.00000001") * sign, v["unit"])), QTY)
    if t.temporal and not t.span:
        return T.add(v, F.lit(1), "day" if t.name == "Date" else "millisecond", sign)
    if t.temporal:
        out = None
        for unit, p in T.PRECISION.items():
            one = T.add(v, F.lit(1), unit, sign).col
            out = F.when(v["prec"] == p, one) if out is None else out.when(v["prec"] == p, one)
        return Val(out, t)
    if t == ANY:
        return v
    raise SemanticFault(f"{t} has no successor or predecessor")


def extent(t: Type, which: str) -> Val:
    lo = which == "minimum"
    if t.name in ("Integer", "Long"):
        n = (2**31 if t == INT else 2**63) - (0 if lo else 1)
        return Val(F.lit(-n if lo else n).cast("bigint"), t)
    if t == DEC:
        return Val(dec(("-" if lo else "") + "9" * 20 + "." + "9" * 8), DEC)
    text_ = {"Date": ("@0001-01-01", "@9999-12-31"), "DateTime": ("@0001-01-01T00:00:00.000", "@9999-12-31T23:59:59.999"), "Time": ("@T00:00:00.000", "@T23:59:59.999")}
    if t.name in text_:
        return T.literal(text_[t.name][0 if lo else 1].replace("@T", "T") if t.name == "Time" else text_[t.name][0 if lo else 1], t)
    raise SemanticFault(f"{t} has no {which}")


def text(v: Val) -> Column:
    """ToString."""
    t = v.type
    if t.temporal:
        return T.text_of(v)
    if t == QTY:
        return F.concat(number_text(v["value"]), F.lit(" '"), F.coalesce(v["unit"], F.lit("1")), F.lit("'"))
    if t in (DEC, REAL):
        return number_text(dec(v.col))
    return v.col.cast("string")


def number_text(c: Column) -> Column:
    """A decimal without trailing zeros, but with one digit after the point."""
    s = F.regexp_replace(c.cast(DECIMAL).cast("string"), r"0+$", "")
    return F.when(s.endswith("."), F.concat(s, F.lit("0"))).otherwise(s)


# intervals

def make_interval(low: Val, high: Val, low_closed: bool, high_closed: bool) -> Val:
    (low, high), t = unify(low, high)
    col = F.struct(low.col.alias("low"), high.col.alias("high"), F.lit(low_closed).alias("lowClosed"), F.lit(high_closed).alias("highClosed"))
    return Val(F.when(~low.null | ~high.null, col) if low.literal is None and high.literal is None else col, interval_of(t), ("interval", low, high, low_closed, high_closed))


def _known(v: Val):
    return v.literal if isinstance(v.literal, tuple) and v.literal and v.literal[0] == "interval" else None


def start(v: Val) -> Val:
    """First point: the successor of an open bound; an absent closed bound is the least value there is."""
    t, k = v.type.item, _known(v)
    if k:
        return k[1] if k[3] or k[1].type == ANY else step(k[1], 1)
    low = Val(v["low"], t)
    return Val(F.when(v["lowClosed"], low.col).otherwise(step(low, 1).col), t)


def end(v: Val) -> Val:
    t, k = v.type.item, _known(v)
    if k:
        return k[2] if k[4] or k[2].type == ANY else step(k[2], -1)
    high = Val(v["high"], t)
    return Val(F.when(v["highClosed"], high.col).otherwise(step(high, -1).col), t)


def as_interval(v: Val) -> Val:
    if v.type.name == "Interval":
        return v
    return Val(F.when(~v.null, F.struct(v.col.alias("low"), v.col.alias("high"), F.lit(True).alias("lowClosed"), F.lit(True).alias("highClosed"))), interval_of(v.type), ("interval", v, v, True, True) if v.type != ANY else None)


def _unbounded(v: Val, which: str) -> Column:
    """Does a null bound mean there is no bound?  (closed: the type's extreme; open: unknown)"""
    return v[which].isNull() & v[which + "Closed"]


def contains(i: Val, x: Val, unit: str | None = None, proper: bool = False) -> Column:
    """Whether a point lies in an interval."""
    k = _known(i)
    if k and not proper and k[1].type != ANY and k[2].type != ANY and k[1].literal is not None and k[2].literal is not None:
        return relation(">=" if k[3] else ">", x, k[1], unit) & relation("<=" if k[4] else "<", x, k[2], unit)
    lo, hi = start(i), end(i)
    ge, le = (">", "<") if proper else (">=", "<=")
    above = F.when(_unbounded(i, "low"), F.when(~x.null, True)).otherwise(relation(ge, x, lo, unit))
    below = F.when(_unbounded(i, "high"), F.when(~x.null, True)).otherwise(relation(le, x, hi, unit))
    return F.when(i.null | x.null, F.lit(None)).otherwise(above & below)


def includes(a: Val, b: Val, unit: str | None = None, proper: bool = False) -> Column:
    """Whether interval a holds all of b."""
    a, b = as_interval(a), as_interval(b)
    low = F.when(_unbounded(a, "low"), True).otherwise(relation("<=", start(a), start(b), unit))
    high = F.when(_unbounded(a, "high"), True).otherwise(relation(">=", end(a), end(b), unit))
    out = F.when(a.null | b.null, F.lit(None)).otherwise(low & high)
    return out & ~F.coalesce(equal(start(a), start(b)) & equal(end(a), end(b)), F.lit(False)) if proper else out


def timing(op: str, a: Val, b: Val, unit: str | None = None, proper: bool = False, offset=None) -> Column:
    """An interval operator phrase; scalars stand for the interval of one point."""
    if op == "includes":
        if b.type.name != "Interval" and a.type.name == "Interval":
            return contains(a, b, unit, proper)
        return includes(a, b, unit, proper)
    if op == "included in":
        if a.type.name != "Interval" and b.type.name == "Interval":
            return contains(b, a, unit, proper)
        return includes(b, a, unit, proper)
    if ANY in (a.type, b.type):
        return F.lit(None).cast("boolean")
    first = lambda v: start(v) if v.type.name == "Interval" else v
    last = lambda v: end(v) if v.type.name == "Interval" else v
    if op in ("before", "after", "same or before", "same or after") and offset:
        (amount, u), how = (offset[0].value, offset[0].unit), offset[1]
        q = F.lit(Decimal(amount))
        near, far = (last(a), first(b)) if "before" in op else (first(a), last(b))
        sign = -1 if "before" in op else 1
        edge = T.add(far, q, u, sign)
        beyond = "<" if sign < 0 else ">"
        if how == "exactly":
            return order(near, edge, unit or (T.unit_of(u) if T.unit_of(u) in T.PRECISION and near.type.name != "Date" and False else None)) == 0
        if how in ("or more", "more than"):
            return relation(beyond + ("=" if how == "or more" else ""), near, edge, unit)
        inside = {"<": ">", ">": "<"}[beyond]
        return relation(inside + ("=" if how == "or less" else ""), near, edge, unit) & relation(beyond + ("=" if "same" in op else ""), near, far, unit)
    if op == "before":
        return relation("<", last(a), first(b), unit)
    if op == "after":
        return relation(">", first(a), last(b), unit)
    if op == "same or before":
        return relation("<=", last(a), first(b), unit)
    if op == "same or after":
        return relation(">=", first(a), last(b), unit)
    if op == "within":
        q, u = F.lit(Decimal(offset[0].value)), offset[0].unit
        lo, hi = T.add(first(b), q, u, -1), T.add(last(b), q, u, 1)
        le, ge = ("<", ">") if proper else ("<=", ">=")
        return relation(ge, first(a), lo, unit) & relation(le, last(a), hi, unit)
    if op == "same as":
        if a.type.name == "Interval" or b.type.name == "Interval":
            return (order(first(a), first(b), unit) == 0) & (order(last(a), last(b), unit) == 0)
        return order(a, b, unit) == 0
    s, e, s2, e2 = first(a), last(a), first(b), last(b)
    if op == "meets":
        return timing("meets before", a, b, unit) | timing("meets after", a, b, unit)
    if op == "meets before":
        return order(step(e, 1), s2, unit) == 0
    if op == "meets after":
        return order(step(e2, 1), s, unit) == 0
    over = relation("<=", s, e2, unit) & relation("<=", s2, e, unit)
    if op == "overlaps":
        return over
    if op == "overlaps before":
        return over & relation("<", s, s2, unit)
    if op == "overlaps after":
        return over & relation(">", e, e2, unit)
    if op == "starts":
        return (order(s, s2, unit) == 0) & relation("<=", e, e2, unit)
    if op == "ends":
        return (order(e, e2, unit) == 0) & relation(">=", s, s2, unit)
    raise SemanticFault(f"unknown timing phrase {op!r}")


def _closed(lo: Val, hi: Val) -> Column:
    return F.struct(lo.col.alias("low"), hi.col.alias("high"), F.lit(True).alias("lowClosed"), F.lit(True).alias("highClosed"))


def _pick(op: str, a: Val, b: Val) -> Val:
    return Val(F.when(relation(op, a, b), a.col).otherwise(b.col), a.type)


def interval_set(op: str, a: Val, b: Val) -> Val:
    """union, intersect and except of two intervals; null where the result is no single interval."""
    (a, b), t = unify(a, b)
    s, e, s2, e2 = start(a), end(a), start(b), end(b)
    over = relation("<=", s, e2) & relation("<=", s2, e)
    if op == "union":
        ok = over | (order(step(e, 1), s2) == 0) | (order(step(e2, 1), s) == 0)
        return Val(F.when(ok, _closed(_pick("<", s, s2), _pick(">", e, e2))), t)
    if op == "intersect":
        return Val(F.when(over, _closed(_pick(">", s, s2), _pick("<", e, e2))), t)
    left = relation("<", s, s2) & relation("<=", e, e2)
    right = relation(">", e, e2) & relation(">=", s, s2)
    return Val(F.when(~over, a.col).when(left, _closed(s, step(s2, -1))).when(right, _closed(step(e2, 1), e)), t)


