"""Types of the language, and how each is held in a Spark column.

Integers and longs are bigint, decimals decimal(28,8).  A date, datetime or time is a native column (date,
timestamp_ntz, milliseconds of the day) where every digit is known when the plan is made, and otherwise a span:
the first and last instant its digits allow, the precision, and the offset from UTC in minutes if one is given.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

DECIMAL = "decimal(28,8)"
SPAN = "struct<lo:timestamp_ntz,hi:timestamp_ntz,prec:int,off:int>"


@dataclass(frozen=True)
class Type:
    name: str
    args: tuple = ()
    span: bool = False

    def __str__(self) -> str:
        if self.name == "Tuple":
            return "Tuple{" + ", ".join(f"{n}: {t}" for n, t in self.args) + "}"
        return self.name + (f"<{', '.join(map(str, self.args))}>" if self.args else "")

    @property
    def item(self) -> Type:
        return self.args[0]

    @property
    def temporal(self) -> bool:
        return self.name in ("Date", "DateTime", "Time")

    @property
    def number(self) -> bool:
        return self.name in ("Integer", "Long", "Decimal", "Real")

    def field(self, name: str) -> Type | None:
        return next((t for n, t in self.args if n == name), None)

    @property
    def ddl(self) -> str:
        if self.temporal and self.span:
            return SPAN
        if self.name == "List":
            return f"array<{self.item.ddl}>"
        if self.name == "Interval":
            return f"struct<low:{self.item.ddl},high:{self.item.ddl},lowClosed:boolean,highClosed:boolean>"
        if self.name in ("Tuple", "Choice"):
            return "struct<" + ",".join(f"`{n}`:{t.ddl}" for n, t in self.args) + ">"
        return _DDL[self.name]


_CODE_DDL = "struct<code:string,display:string,system:string,version:string>"
_QUANTITY_DDL = f"struct<value:{DECIMAL},unit:string>"
_DDL = {
    "Boolean": "boolean", "Integer": "bigint", "Long": "bigint", "Decimal": DECIMAL, "Real": "double", "String": "string", "Date": "date", "DateTime": "timestamp_ntz", "Time": "bigint",
    "Quantity": _QUANTITY_DDL, "Ratio": f"struct<numerator:{_QUANTITY_DDL},denominator:{_QUANTITY_DDL}>", "Code": _CODE_DDL, "Concept": f"struct<codes:array<{_CODE_DDL}>,display:string>",
    "Any": "void", "Uncertainty": "struct<low:bigint,high:bigint>", "Vocabulary": "string",
}
BOOL, INT, LONG, DEC, REAL, STR, DATE, DT, TIME, QTY, RATIO, CODE, CONCEPT, ANY, UNC, VOCAB = (Type(n) for n in ("Boolean", "Integer", "Long", "Decimal", "Real", "String", "Date", "DateTime", "Time", "Quantity", "Ratio", "Code", "Concept", "Any", "Uncertainty", "Vocabulary"))
NAMED = {t.name: t for t in (BOOL, INT, LONG, DEC, STR, DATE, DT, TIME, QTY, RATIO, CODE, CONCEPT, ANY)}
RANK = {"Integer": 1, "Long": 2, "Decimal": 3, "Real": 3, "Quantity": 4}


def list_of(t: Type) -> Type:
    return Type("List", (t,))


def interval_of(t: Type) -> Type:
    return Type("Interval", (t,))


def tuple_of(parts) -> Type:
    return Type("Tuple", tuple(sorted(parts)))


def span_of(t: Type) -> Type:
    return Type(t.name, (), True)


@dataclass(frozen=True)
class Val:
    """A typed column; literal: the Python value, where it is known when the plan is made."""

    col: Column
    type: Type
    literal: object = None

    def __getitem__(self, name: str) -> Column:
        return self.col[name]

    @property
    def null(self) -> Column:
        return self.col.isNull()


def let(cols: dict[str, Column], f) -> Column:
    """f of columns that are computed once: an expression that names its operands often would repeat them each time."""
    one = F.array(F.struct(*(c.alias(k) for k, c in cols.items())))
    return F.get(F.transform(one, lambda x: f(*(x[k] for k in cols))), F.lit(0))


def none(t: Type = ANY) -> Val:
    return Val(F.lit(None).cast(t.ddl), t)


def common(a: Type, b: Type) -> Type | None:
    """The type that both convert to without being asked, or None."""
    if a == b:
        return a
    if a == ANY or b == ANY:
        return b if a == ANY else a
    if a.name in RANK and b.name in RANK:
        hi = a if RANK[a.name] >= RANK[b.name] else b
        return DEC if "Real" in (a.name, b.name) and hi.name != "Quantity" and a.name != b.name else hi
    if a.temporal and b.temporal:
        if a.name == b.name:
            return span_of(a)
        if {a.name, b.name} == {"Date", "DateTime"}:
            return span_of(DT)
    if {a.name, b.name} == {"Code", "Concept"}:
        return CONCEPT
    if a.name == b.name and a.name in ("List", "Interval"):
        inner = common(a.item, b.item)
        return Type(a.name, (inner,)) if inner else None
    if a.name == b.name == "Tuple" and [n for n, _ in a.args] == [n for n, _ in b.args]:
        inner = [(n, common(x, y)) for (n, x), (_, y) in zip(a.args, b.args)]
        return tuple_of(inner) if all(t for _, t in inner) else None
    return None
