"""Built-in functions in array form: each takes typed columns and gives one."""

from __future__ import annotations

from collections.abc import Callable
from decimal import Decimal

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..errors import SemanticFault
from ..plans.types import ANY, BOOL, CODE, CONCEPT, DATE, DEC, DECIMAL, DT, INT, LONG, QTY, RATIO, STR, TIME, UNC, Type, Val, interval_of, list_of, none, span_of
from . import temporal as T
from . import values as V

TABLE: dict[str, Callable] = {}


def builtin(*names: str):
    def put(f):
        for n in names:
            TABLE[n.lower()] = f
        return f

    return put


def items(v: Val) -> Val:
    """A list as it is; null is no list, a scalar a list of one."""
    if v.type.name == "List":
        return v
    if v.type == ANY:
        return Val(F.lit(None).cast("array<void>"), list_of(ANY))
    return Val(F.when(~v.null, F.array(v.col)), list_of(v.type))


def known(v: Val) -> Column:
    """The elements that aren't null."""
    return F.filter(v.col, lambda x: x.isNotNull())


def boolean(c: Column) -> Val:
    return Val(c, BOOL)


def integer(c: Column) -> Val:
    return Val(c.cast("bigint"), INT)


def string(v: Val) -> Column:
    if v.type not in (STR, ANY):
        raise SemanticFault(f"expected a String, found {v.type}")
    return v.col.cast("string")


# strings

@builtin("Combine")
def combine(xs, sep=None):
    return Val(F.when(F.size(known(items(xs))) > 0, F.array_join(known(items(xs)).cast("array<string>"), sep.literal if sep and isinstance(sep.literal, str) else "")) if sep is None or isinstance(sep.literal, str) else F.when(F.size(known(items(xs))) > 0, F.aggregate(F.slice(known(items(xs)), 2, 1 << 30), F.get(known(items(xs)), F.lit(0)), lambda acc, x: F.concat(acc, sep.col, x))), STR)


@builtin("Concatenate")
def concatenate(*xs):
    return Val(F.concat(*(string(x) for x in xs)), STR)


@builtin("Split")
def split(s, sep):
    return Val(F.when(sep.null, F.array(string(s))).otherwise(F.when(s.col == "", F.array(F.lit(""))).otherwise(F.split(string(s), F.concat(F.lit("\\Q"), string(sep), F.lit("\\E")), -1))), list_of(STR))


@builtin("SplitOnMatches")
def split_on_matches(s, rx):
    return Val(F.split(string(s), string(rx), -1), list_of(STR))


@builtin("Length")
def length(x):
    if x.type.name == "List":
        return integer(F.coalesce(F.size(x.col), F.lit(0)))
    return integer(F.length(string(x)))


@builtin("Upper")
def upper(s):
    return Val(F.upper(string(s)), STR)


@builtin("Lower")
def lower(s):
    return Val(F.lower(string(s)), STR)


@builtin("StartsWith")
def starts_with(s, p):
    return boolean(F.startswith(string(s), string(p)))


@builtin("EndsWith")
def ends_with(s, p):
    return boolean(F.endswith(string(s), string(p)))


@builtin("Substring")
def substring(s, i, n=None):
    at, size = i.col.cast("int"), F.length(string(s))
    inside = (at >= 0) & ((at < size) | ((at == 0) & (size == 0)))
    count = size if n is None else F.when(n.null | (n.col <= 0), size).otherwise(n.col.cast("int"))
    return Val(F.when(inside, F.substring(string(s), at + 1, count)), STR)


@builtin("IndexOf")
def index_of(xs, x):
    if xs.type.name != "List":
        return integer(F.when(~xs.null & ~x.null, F.instr(xs.col, string(x)) - 1) if not isinstance(x.literal, str) else F.instr(string(xs), x.literal) - 1)
    at = F.transform(xs.col, lambda y, k: F.when(V.same(Val(y, xs.type.item), x), k))
    return integer(F.when(xs.null | x.null, F.lit(None)).otherwise(F.coalesce(F.array_min(at), F.lit(-1))))


@builtin("PositionOf")
def position_of(p, s):
    return integer(F.expr("1") * 0 + F.locate(p.literal, string(s)) - 1 if isinstance(p.literal, str) else F.call_function("instr", string(s), string(p)) - 1)


@builtin("LastPositionOf")
def last_position_of(p, s):
    at = F.call_function("instr", F.reverse(string(s)), F.reverse(string(p)))
    return integer(F.when(at == 0, -1).otherwise(F.length(s.col) - F.length(p.col) - at + 1))


@builtin("Matches")
def matches(s, rx):
    return boolean(F.call_function("rlike", string(s), F.concat(F.lit("^(?:"), string(rx), F.lit(")$"))))


@builtin("ReplaceMatches")
def replace_matches(s, rx, by):
    return Val(F.call_function("regexp_replace", string(s), string(rx), string(by)), STR)


@builtin("Indexer")
def indexer(xs, i):
    if xs.type.name == "List":
        return Val(F.get(xs.col, i.col.cast("int")), xs.type.item)
    at = i.col.cast("int")
    return Val(F.when((at >= 0) & (at < F.length(string(xs))), F.substring(xs.col, at + 1, F.lit(1))), STR)


@builtin("ToString")
def to_string(x):
    return Val(V.text(x), STR)


# math

def numeric(f, keep=False):
    def run(x):
        if x.type == QTY and keep:
            return Val(F.when(~x.null, V.quantity(f(x["value"]), x["unit"])), QTY)
        if not x.type.number and x.type != ANY:
            raise SemanticFault(f"expected a number, found {x.type}")
        return f(x)

    return run


@builtin("Abs")
def absolute(x):
    if x.type == QTY:
        return Val(F.when(~x.null, V.quantity(F.abs(x["value"]), x["unit"])), QTY)
    return Val(F.abs(x.col), x.type) if x.type != ANY else none(INT)


def _ranged(c: Column) -> Val:
    return integer(F.when((c >= -(2**31)) & (c < 2**31), c))


@builtin("Ceiling")
def ceiling(x):
    return _ranged(F.ceil(V.dec(x.col)))


@builtin("Floor")
def floor(x):
    return _ranged(F.floor(V.dec(x.col)))


@builtin("Truncate")
def truncate(x):
    return integer(F.when(x.col < 0, F.ceil(V.dec(x.col))).otherwise(F.floor(V.dec(x.col))))


@builtin("Round")
def rounded(x, p=None):
    n = int(p.literal) if p is not None and p.literal is not None else 0
    if p is not None and p.literal is None:
        scale = F.pow(F.lit(10.0), p.col)
        return Val((F.round(V.dec(x.col).cast("double") * scale) / scale).cast(DECIMAL), DEC)
    return Val(F.round(V.dec(x.col), n).cast(DECIMAL), DEC)


def _real(x: Val) -> Column:
    return x.col.cast("double")


@builtin("Ln")
def ln(x):
    return Val(F.round(F.when(_real(x) == 0, F.raise_error("Ln(0)").cast("double")).when(_real(x) > 0, F.ln(_real(x))), 8).cast(DECIMAL), DEC)


@builtin("Log")
def log(x, b):
    ok = (_real(x) > 0) & (_real(b) > 0) & (_real(b) != 1)
    return Val(F.round(F.when(ok, F.ln(_real(x)) / F.ln(_real(b))), 8).cast(DECIMAL), DEC)


@builtin("Exp")
def exp(x):
    return Val(F.when(_real(x) > 46.0, F.raise_error("Exp is too large").cast(DECIMAL)).otherwise(F.round(F.exp(_real(x)), 8).cast(DECIMAL)), DEC)


@builtin("Power")
def power(a, b):
    return V.power(a, b)


@builtin("Precision")
def precision(x):
    if x.type.temporal:
        digits = F.array(*(F.lit(n) for n in (4, 6, 8, 10, 12, 14, 17)))
        got = F.element_at(digits, T.to_span(x)["prec"])
        return integer(got - 8 if x.type.name == "Time" else got)
    if isinstance(x.literal, str):
        return integer(F.lit(len(x.literal.partition(".")[2])))
    return integer(F.length(F.regexp_extract(V.number_text(V.dec(x.col)), r"\.(\d+)$", 1)) if x.type != INT else F.when(~x.null, 0))


def _boundary(x: Val, p: Val | None, high: bool) -> Val:
    if x.type.temporal:
        s = T.to_span(x)
        out = s["hi"] if high else s["lo"]
        n = int(p.literal) if p is not None and p.literal is not None else {"Date": 8, "DateTime": 17, "Time": 9}[x.type.name]
        prec = {4: 1, 6: 2, 8: 3, 10: 4, 12: 5, 14: 6, 17: 7}.get(n + (8 if x.type.name == "Time" else 0), 7)
        unit = [u for u, k in T.PRECISION.items() if k == prec][0]
        full = Val(F.when(~s.null, F.struct(out.alias("lo"), out.alias("hi"), F.lit(7).alias("prec"), s["off"].alias("off"))), span_of(x.type))
        return T.truncated(full, unit) if prec < 7 else full
    if x.type == INT:
        return x
    n = int(p.literal) if p is not None and p.literal is not None else 8
    digits = len(x.literal.partition(".")[2]) if isinstance(x.literal, str) else 8
    more = Decimal(10) ** -digits - Decimal(10) ** -n if n > digits else Decimal(0)
    return Val((V.dec(x.col) + F.lit(more).cast(DECIMAL)).cast(DECIMAL) if high else V.dec(x.col), DEC)


@builtin("LowBoundary")
def low_boundary(x, p=None):
    return _boundary(x, p, False)


@builtin("HighBoundary")
def high_boundary(x, p=None):
    return _boundary(x, p, True)


# nulls

@builtin("IsNull")
def is_null(x):
    return boolean(x.null)


@builtin("IsTrue")
def is_true(x):
    return boolean(x.col.eqNullSafe(F.lit(True)) if x.type == BOOL else F.lit(False))


@builtin("IsFalse")
def is_false(x):
    return boolean(x.col.eqNullSafe(F.lit(False)) if x.type == BOOL else F.lit(False))


@builtin("Coalesce")
def coalesce(*xs):
    if len(xs) == 1 and xs[0].type.name == "List":
        return Val(F.get(known(xs[0]), F.lit(0)), xs[0].type.item)
    vals, t = V.unify(*xs)
    return Val(F.coalesce(*(v.col for v in vals)), t)


# lists

@builtin("First")
def first(xs):
    xs = items(xs)
    return Val(F.get(xs.col, F.lit(0)), xs.type.item)


@builtin("Last")
def last(xs):
    xs = items(xs)
    return Val(F.get(xs.col, F.size(xs.col) - 1), xs.type.item)


def _slice(xs: Val, start: Column, count: Column) -> Val:
    return Val(F.when(count > 0, F.slice(xs.col, F.greatest(start, F.lit(0)).cast("int") + 1, F.greatest(count, F.lit(1)).cast("int"))).otherwise(F.when(~xs.null, F.slice(xs.col, 1, 0))), xs.type)


@builtin("Tail")
def tail(xs):
    return _slice(xs, F.lit(1), F.size(xs.col) - 1)


@builtin("Take")
def take(xs, n):
    return _slice(xs, F.lit(0), F.coalesce(n.col, F.lit(0)))


@builtin("Skip")
def skip(xs, n):
    k = F.greatest(F.coalesce(n.col, F.lit(0)), F.lit(0))
    return _slice(xs, k, F.size(xs.col) - k)


@builtin("Slice")
def slice_(xs, s, e):
    size = F.size(xs.col).cast("bigint")
    at = lambda c: F.least(F.greatest(F.when(c < 0, size + c).otherwise(c), F.lit(0)), size)
    lo, hi = at(F.coalesce(s.col, F.lit(0))), at(F.coalesce(e.col, size))
    return _slice(xs, lo, hi - lo)


@builtin("SubList")
def sub_list(xs, s, n=None):
    lo = F.greatest(s.col, F.lit(0))
    rest = F.size(xs.col) - lo
    return Val(F.when(~s.null, _slice(xs, lo, rest if n is None else F.least(F.coalesce(n.col, rest), rest)).col), xs.type)


@builtin("Distinct")
def distinct(xs):
    if xs.type.item.temporal or xs.type.item.name in ("Quantity", "Interval", "Decimal"):
        t = xs.type.item
        keep = F.filter(xs.col, lambda x, k: ~F.exists(F.slice(xs.col, 1, k), lambda y: V.same(Val(y, t), Val(x, t))))
        return Val(keep, xs.type)
    return Val(F.array_distinct(xs.col), xs.type)


@builtin("Flatten")
def flatten(xs):
    if xs.type.item.name != "List":
        return xs
    return Val(F.flatten(F.filter(xs.col, lambda x: x.isNotNull())), xs.type.item)


@builtin("Exists")
def exists(xs):
    return boolean(F.coalesce(F.exists(items(xs).col, lambda x: x.isNotNull()), F.lit(False)))


@builtin("SingletonFrom")
def singleton(xs):
    many = F.raise_error("the list has more than one element").cast(xs.type.item.ddl)
    return Val(F.when(F.size(xs.col) > 1, many).otherwise(F.get(xs.col, F.lit(0))), xs.type.item)


def member(xs: Val, x: Val) -> Column:
    """Whether a list has an element; a null probe is in no list but one with a null."""
    t = xs.type.item
    hit = F.exists(xs.col, lambda y: V.same(Val(y, t), x))
    if t.temporal and (t.span or x.type.span):
        open_ = F.exists(xs.col, lambda y: V.equal(Val(y, t), x).isNull() & y.isNotNull())
        return F.when(x.null, F.coalesce(hit, F.lit(False))).when(hit, True).when(open_, F.lit(None)).otherwise(False)
    return F.coalesce(hit, F.lit(False))


def list_set(op: str, a: Val, b: Val) -> Val:
    if a.type == ANY:
        a = none(b.type)
    if b.type == ANY:
        b = none(a.type)
    (a, b), t = V.unify(items(a), items(b))
    has = lambda xs, x: F.exists(xs, lambda y: V.same(Val(y, t.item), Val(x, t.item)))
    if op == "union":
        left, right = F.coalesce(a.col, F.slice(b.col, 1, 0)), F.coalesce(b.col, F.slice(a.col, 1, 0))
        return Val(F.concat(left, F.filter(distinct(Val(right, t)).col, lambda x: ~has(left, x))), t)
    if op == "intersect":
        return Val(distinct(Val(F.filter(a.col, lambda x: has(b.col, x)), t)).col, t)
    return Val(F.when(b.null, a.col).otherwise(F.filter(a.col, lambda x: ~has(b.col, x))), t)


def list_timing(op: str, a: Val, b: Val, proper: bool) -> Column:
    if op == "included in":
        op, a, b = "includes", b, a
    if op == "includes":
        if b.type.name != "List":
            out = member(a, b)
            return out & (F.size(a.col) > 1) if proper else out
        out = F.forall(b.col, lambda x: member(a, Val(x, b.type.item)))
        return out & (F.size(distinct(a).col) > F.size(distinct(b).col)) if proper else out
    if op == "same as":
        return F.coalesce(V.equal(a, b), F.lit(None))
    if op == "overlaps":
        return F.exists(a.col, lambda x: member(b, Val(x, a.type.item)))
    return F.lit(None).cast("boolean")


# aggregates

def _numbers(xs: Val) -> Column:
    return F.transform(known(xs), lambda x: V.dec(x))


def _unit(xs: Val) -> Column:
    return F.get(known(xs), F.lit(0))["unit"]


def over(f):
    """An aggregate of numbers, or of quantities in the unit of the first."""

    def run(xs):
        xs = items(xs)
        if xs.type.item == QTY:
            unit = _unit(xs)
            values = F.transform(known(xs), lambda q: V.converted(q, unit)["value"])
            bad = F.exists(values, lambda x: x.isNull())
            out = f(Val(values, list_of(DEC)))
            power = {"Variance": "2", "PopulationVariance": "2"}.get(f.__name__, "")
            return Val(F.when(bad, F.raise_error("units don't go together").cast(QTY.ddl)).when(out.col.isNotNull(), V.quantity(out.col, F.concat(unit, F.lit(power)) if power else unit)), QTY)
        if not (xs.type.item.number or xs.type.item == ANY):
            raise SemanticFault(f"expected numbers, found {xs.type}")
        return f(Val(xs.col.cast("array<bigint>") if xs.type.item == ANY else xs.col, list_of(INT) if xs.type.item == ANY else xs.type))

    return run


@builtin("Count")
def count(xs):
    return integer(F.coalesce(F.size(known(items(xs))), F.lit(0)))


@over
def _sum(xs):
    whole = xs.type.item.name in ("Integer", "Long")
    out = F.aggregate(known(xs), F.lit(0).cast("bigint") if whole else V.dec("0"), lambda acc, x: (acc + x).cast("bigint" if whole else DECIMAL))
    return Val(F.when(F.size(xs.col) > 0, out), xs.type.item if whole else DEC)


@over
def _avg(xs):
    total = F.aggregate(_numbers(xs), V.dec("0"), lambda acc, x: (acc + x).cast(DECIMAL))
    return Val(F.try_divide(total, V.dec(F.size(known(xs)))).cast(DECIMAL), DEC)


@over
def _product(xs):
    whole = xs.type.item.name in ("Integer", "Long")
    out = F.aggregate(known(xs), F.lit(1).cast("bigint") if whole else V.dec("1"), lambda acc, x: (acc * x).cast("bigint" if whole else DECIMAL))
    return Val(F.when(F.size(xs.col) > 0, out), xs.type.item if whole else DEC)


@over
def _median(xs):
    s = F.array_sort(_numbers(xs))
    n = F.size(s)
    mid = lambda k: F.get(s, k.cast("int"))
    return Val(((mid(F.floor((n - 1) / 2)) + mid(F.floor(n / 2))) / 2).cast(DECIMAL), DEC)


def _moment(xs: Val, least: int, less: int) -> Column:
    n = F.size(known(xs)).cast("double")
    values = F.transform(known(xs), lambda x: x.cast("double"))
    mean = F.aggregate(values, F.lit(0.0), lambda a, x: a + x) / F.nullif(n, F.lit(0.0))
    total = F.aggregate(values, F.lit(0.0), lambda a, x: a + (x - mean) * (x - mean))
    return F.when(n >= least, total / F.nullif(n - less, F.lit(0.0)))


@over
def Variance(xs):  # noqa: N802
    return Val(F.round(_moment(xs, 2, 1), 8).cast(DECIMAL), DEC)


@over
def PopulationVariance(xs):  # noqa: N802
    return Val(F.round(_moment(xs, 2, 0), 8).cast(DECIMAL), DEC)


@over
def _stddev(xs):
    return Val(F.round(F.sqrt(_moment(xs, 2, 1)), 8).cast(DECIMAL), DEC)


@over
def _popstddev(xs):
    return Val(F.round(F.sqrt(_moment(xs, 2, 0)), 8).cast(DECIMAL), DEC)


@over
def _geomean(xs):
    values = F.transform(known(xs), lambda x: x.cast("double"))
    n = F.size(values)
    logs = F.aggregate(values, F.lit(0.0), lambda a, x: a + F.ln(F.when(x > 0, x)))
    return Val(F.when(n > 0, F.round(F.exp(logs / F.nullif(n, F.lit(0))), 8)).cast(DECIMAL), DEC)


def _best(sign: int):
    def run(xs):
        xs = items(xs)
        t = xs.type.item
        if t == ANY:
            return none(ANY)
        if (t.number or t == STR or t.temporal) and not t.span:
            return Val((F.array_max if sign > 0 else F.array_min)(xs.col), t)
        better = ">" if sign > 0 else "<"
        return Val(F.aggregate(known(xs), F.lit(None).cast(t.ddl), lambda acc, x: F.when(acc.isNull() | F.coalesce(V.relation(better, Val(x, t), Val(acc, t)), F.lit(False)), x).otherwise(acc)), t)

    return run


@builtin("Mode")
def mode(xs):
    """The most frequent element; of several the one that comes first in order."""
    xs = items(xs)
    t = xs.type.item
    counted = F.transform(F.array_distinct(known(xs)), lambda x: F.struct((-F.size(F.filter(xs.col, lambda y: F.coalesce(V.equal(Val(x, t), Val(y, t)), F.lit(False))))).alias("n"), x.alias("x")))
    return Val(F.array_min(counted)["x"], t)


@builtin("AllTrue")
def all_true(xs):
    return boolean(F.coalesce(F.forall(known(items(xs)).cast("array<boolean>"), lambda x: x), F.lit(True)))


@builtin("AnyTrue")
def any_true(xs):
    return boolean(F.coalesce(F.exists(known(items(xs)).cast("array<boolean>"), lambda x: x), F.lit(False)))


for _name, _f in {"Sum": _sum, "Avg": _avg, "Product": _product, "Median": _median, "Variance": Variance, "PopulationVariance": PopulationVariance, "StdDev": _stddev, "PopulationStdDev": _popstddev, "GeometricMean": _geomean, "Min": _best(-1), "Max": _best(1)}.items():
    builtin(_name)(_f)


@builtin("Sum")
def sum_(xs):
    xs = items(xs)
    if xs.type.item == UNC:
        zero = F.struct(F.lit(0).cast("bigint").alias("low"), F.lit(0).cast("bigint").alias("high"))
        return Val(F.when(F.size(xs.col) > 0, F.aggregate(known(xs), zero, lambda a, x: F.struct((a["low"] + x["low"]).alias("low"), (a["high"] + x["high"]).alias("high")))), UNC)
    return _sum(xs)


# conversions

def _number_or_text(x: Val, ddl: str) -> Column:
    return x.col.try_cast(ddl) if x.type == STR else x.col.cast(ddl)


@builtin("ToBoolean")
def to_boolean(x):
    if x.type == STR:
        s = F.lower(x.col)
        return boolean(F.when(s.isin("true", "t", "yes", "y", "1", "1.0"), True).when(s.isin("false", "f", "no", "n", "0", "0.0"), False))
    return boolean(x.col if x.type in (BOOL, ANY) else x.col != 0)


def _integral(x: Val, ddl: str) -> Column:
    if x.type == STR:
        return F.when(x.col.rlike(r"^[+-]?\d+$"), x.col.try_cast(ddl)).cast("bigint")
    if x.type == BOOL:
        return x.col.cast("int").cast("bigint")
    return x.col.try_cast(ddl).cast("bigint")


@builtin("ToInteger")
def to_integer(x):
    return Val(_integral(x, "int"), INT)


@builtin("ToLong")
def to_long(x):
    return Val(_integral(x, "bigint"), LONG)


@builtin("ToDecimal")
def to_decimal(x):
    if x.type == STR:
        return Val(F.when(x.col.rlike(r"^[+-]?\d{1,20}(\.\d{1,8})?$"), x.col.try_cast(DECIMAL)), DEC)
    return Val(x.col.cast("int").cast(DECIMAL) if x.type == BOOL else x.col.cast(DECIMAL), DEC)


@builtin("ToDate")
def to_date(x):
    return T.parse(x.col, DATE) if x.type == STR else T.component(x, "date") if x.type.name == "DateTime" else V.convert(x, DATE) if x.type == ANY else x


@builtin("ToDateTime")
def to_datetime(x):
    return T.parse(x.col, DT) if x.type == STR else T.as_type(x, span_of(DT)) if x.type.name == "Date" else V.convert(x, DT) if x.type == ANY else x


@builtin("ToTime")
def to_time(x):
    return T.parse(x.col, TIME) if x.type == STR else T.component(x, "time") if x.type.name == "DateTime" else V.convert(x, TIME) if x.type == ANY else x


_QTY = r"^\s*([+-]?\d+(?:\.\d+)?)\s*(?:'([^']*)'|([A-Za-z]+))?\s*$"


@builtin("ToQuantity")
def to_quantity(x):
    if x.type == QTY:
        return x
    if x.type == STR:
        unit = F.regexp_extract(x.col, _QTY, 2)
        unit = F.when(unit != "", unit).otherwise(F.regexp_extract(x.col, _QTY, 3))
        return Val(F.when(x.col.rlike(_QTY), V.quantity(F.regexp_extract(x.col, _QTY, 1).try_cast(DECIMAL), F.when(unit == "", "1").otherwise(unit))), QTY)
    if x.type == RATIO:
        return V.arithmetic("/", Val(x["numerator"], QTY), Val(x["denominator"], QTY))
    return V.convert(x, QTY)


@builtin("ToRatio")
def to_ratio(x):
    side = lambda k: to_quantity(Val(F.split(x.col, ":")[k], STR)).col
    return Val(F.when(x.col.rlike(":") & side(0).isNotNull() & side(1).isNotNull(), F.struct(side(0).alias("numerator"), side(1).alias("denominator"))), RATIO)


@builtin("ToConcept")
def to_concept(x):
    if x.type.name == "List" and x.type.item == CODE:
        return Val(F.when(~x.null, F.struct(x.col.alias("codes"), F.lit(None).cast("string").alias("display"))), CONCEPT)
    return V.convert(x, CONCEPT)


@builtin("ToCode")
def to_code(x):
    if x.type == STR:
        return Val(F.when(~x.null, F.struct(x.col.alias("code"), *(F.lit(None).cast("string").alias(c) for c in ("display", "system", "version")))), CODE)
    return x


@builtin("ToInterval", "ToList")
def to_interval(x):
    return V.as_interval(x)


CONVERT = {"Boolean": to_boolean, "Integer": to_integer, "Long": to_long, "Decimal": to_decimal, "String": to_string, "Date": to_date, "DateTime": to_datetime, "Time": to_time, "Quantity": to_quantity, "Ratio": to_ratio, "Concept": to_concept, "Code": to_code}
#: What each type can be converted from at all.
_FROM = {"Boolean": {"Boolean", "Integer", "Long", "Decimal", "String"}, "Integer": {"Integer", "Long", "String", "Boolean"}, "Long": {"Integer", "Long", "String", "Boolean"}, "Decimal": {"Integer", "Long", "Decimal", "String", "Boolean"}, "Date": {"Date", "DateTime", "String"}, "DateTime": {"Date", "DateTime", "String"}, "Time": {"Time", "String"}, "Quantity": {"Quantity", "Ratio", "Integer", "Long", "Decimal", "String"}, "Ratio": {"Ratio", "String"}}


def converts_to(name: str):
    def run(x):
        if x.type == ANY:
            return none(BOOL)
        if name == "String":
            return boolean(F.when(~x.null, True))
        if x.type.name not in _FROM[name]:
            return boolean(F.when(~x.null, False))
        got = CONVERT[name](x).col if x.type.name != name else x.col
        if name == "Boolean" and x.type.number:
            return boolean(F.when(~x.null, x.col.isin(0, 1)))
        return boolean(F.when(~x.null, got.isNotNull()))

    return run


for _name in (*_FROM, "String"):
    builtin(f"ConvertsTo{_name}")(converts_to(_name))


@builtin("ConvertQuantity")
def convert_quantity(q, unit):
    return Val(V.converted(q.col, string(unit)), QTY)


@builtin("CanConvertQuantity")
def can_convert_quantity(q, unit):
    return boolean(F.when(~q.null & ~unit.null, V.converted(q.col, unit.col).isNotNull()))


# dates

def _parts(xs, n):
    cols = [x.col.cast("int") for x in xs]
    return cols + [F.lit(None).cast("int")] * (n - len(cols))


@builtin("Date")
def date(*xs):
    if len(xs) == 3:
        return Val(F.when(F.coalesce(*(F.lit(True) for _ in xs)) & ~xs[1].null & ~xs[2].null, F.make_date(*(x.col.cast("int") for x in xs))), DATE)
    text = F.format_string("%04d", xs[0].col.cast("int"))
    if len(xs) == 2:
        text = F.concat(text, F.coalesce(F.format_string("-%02d", xs[1].col.cast("int")), F.lit("")))
    return T.parse(F.when(~xs[0].null, text), DATE)


@builtin("DateTime")
def datetime(*xs):
    marks = ("%04d", "-%02d", "-%02d", "T%02d", ":%02d", ":%02d", ".%03d")
    zone = xs[7] if len(xs) > 7 else None
    parts = [F.when(F.coalesce(*(x.null for x in xs[: k + 1])) if k == 0 else x.null, F.lit("")).otherwise(F.format_string(m, x.col.cast("int"))) for k, (m, x) in enumerate(zip(marks, xs[:7]))]
    if len(xs) < 4:
        parts.append(F.lit("T"))
    if zone is not None:
        z = V.dec(zone.col)
        parts.append(F.when(~zone.null, F.concat(F.when(z < 0, "-").otherwise("+"), F.format_string("%02d:%02d", F.floor(F.abs(z)).cast("int"), (F.abs(z) * 60 % 60).cast("int")))).otherwise(""))
    bad = (xs[0].col < 1) | (xs[0].col > 9999)
    return Val(F.when(bad, F.raise_error("the year isn't between 1 and 9999").cast(span_of(DT).ddl)).when(~xs[0].null, T.parse(F.concat(*parts), DT).col), span_of(DT))


@builtin("Time")
def time(*xs):
    marks = ("%02d", ":%02d", ":%02d", ".%03d")
    parts = [F.coalesce(F.format_string(m, x.col.cast("int")), F.lit("")) for m, x in zip(marks, xs)]
    return T.parse(F.when(~xs[0].null, F.concat(*parts)), TIME)


def age(unit: str):
    def run(birth, at):
        return T.between(birth, V.convert(at, birth.type) if birth.type.name != at.type.name and not birth.type.span else at, unit, False)

    return run


# intervals

@builtin("Width")
def width(i):
    if i.type.name != "Interval":
        return none(INT)
    if i.type.item.temporal:
        raise SemanticFault("a temporal interval has no width")
    return V.arithmetic("-", V.end(i), V.start(i))


@builtin("Size")
def size(i):
    w = width(i)
    return Val(w.col + 1, w.type) if w.type == INT else V.arithmetic("+", w, Val(V.dec("0.00000001"), DEC))


def point_from(i):
    s = V.start(i)
    return Val(F.when(V.order(s, V.end(i)) == 0, s.col).otherwise(F.when(~i.null, F.raise_error("the interval holds more than one point").cast(s.type.ddl))), s.type)


def collapse(xs: Val, per: Val | None = None) -> Val:
    """Overlapping and meeting intervals merged, sorted by start."""
    t = xs.type.item
    p = t.item
    closed = F.transform(F.filter(xs.col, lambda x: x.isNotNull() & (x["low"].isNotNull() | x["high"].isNotNull())), lambda x: V._closed(V.start(Val(x, t)), V.end(Val(x, t))))
    ordered = F.array_sort(closed, lambda a, b: F.coalesce(V.order(Val(a["low"], p), Val(b["low"], p)), V.order(Val(a["high"], p), Val(b["high"], p)), F.lit(0)))

    def put(acc, x):
        tip = Val(F.element_at(acc, -1), t)
        far = V.step(V.end(tip), 1)
        if per is not None and p.temporal:
            far = V.arithmetic("+", V.end(tip), per)
        elif per is not None:
            far = Val(V.end(tip).col + (per["value"] if per.type == QTY else per.col), p)
        joins = V.relation("<=", Val(x["low"], p), far)
        merged = F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(V._closed(Val(tip["low"], p), V._pick(">", Val(tip["high"], p), Val(x["high"], p)))))
        return F.when(F.size(acc) == 0, F.array(x)).when(joins, merged).otherwise(F.concat(acc, F.array(x)))

    return Val(F.aggregate(ordered, F.slice(ordered, 1, 0), put), xs.type)


def expand(v: Val, per: Val | None = None) -> Val:
    """The points of an interval, or the unit intervals of a list of them."""
    many = v.type.name == "List"
    t = v.type.item if many else v.type
    p = t.item
    if p.temporal:
        unit = T.unit_of(per.literal[1]) if per is not None and per.literal else ("day" if p.name == "Date" else "millisecond")
        amount = int(Decimal(per.literal[0])) if per is not None and per.literal else 1

        def points(i):
            s, e = V.start(Val(i, t)), V.end(Val(i, t))
            s, e = (x if not x.type.span else Val(x["lo"], Type(p.name)) for x in (s, e))
            native = Type(p.name)
            n = T.between(s, e, unit, False).col
            return F.transform(F.when(n >= 0, F.sequence(F.lit(0).cast("bigint"), F.floor(n / amount).cast("bigint"))).otherwise(F.array().cast("array<bigint>")), lambda k: T.add(s, (k * amount).cast("int"), unit).col), native
    else:
        by = F.lit(Decimal(per.literal[0] if isinstance(per.literal, tuple) else str(per.literal))) if per is not None and per.literal is not None else F.lit(Decimal(1))
        whole = p.name in ("Integer", "Long")

        def points(i):
            s, e = V.start(Val(i, t)).col, V.end(Val(i, t)).col
            n = F.floor((V.dec(e) - V.dec(s)) / by).cast("bigint")
            got = F.transform(F.when(n >= 0, F.sequence(F.lit(0).cast("bigint"), n)).otherwise(F.array().cast("array<bigint>")), lambda k: (V.dec(s) + k * V.dec(by)).cast(DECIMAL))
            return (F.transform(got, lambda x: x.cast("bigint")) if whole else got), p
    if not many:
        got, q = points(v.col)
        return Val(F.when(~v.null, got), list_of(q))
    q = Type(p.name) if p.temporal else p

    def units(i):
        got, q_ = points(i)
        if p.temporal:
            width_ = lambda x: T.add(T.add(Val(x, q_), F.lit(amount), unit), F.lit(1), "day" if p.name == "Date" else "millisecond", -1)
        else:
            width_ = lambda x: Val((x + by).cast(p.ddl) - (F.lit(1).cast("bigint") if whole else V.dec("0.00000001")), p)
        return F.transform(got, lambda x: V._closed(Val(x, q_), Val(width_(x).col.cast(q_.ddl), q_)))

    return Val(F.array_distinct(F.flatten(F.transform(known(v), units))), list_of(interval_of(q)))


