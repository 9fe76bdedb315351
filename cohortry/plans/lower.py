"""Lowering: from the tree to typed columns, and to DataFrames where a list comes from a table.

One job evaluates a definition for all subjects.  A frame is a DataFrame with one row per subject, or per element
of a query; scalars are columns on it.  A list that comes from a retrieve stays a DataFrame with the subject's key
(set form) as long as its consumer can take it so: query clauses become filters, projections, semi and anti joins,
aggregates become grouped aggregation joined back on the key.  Everything else sees it as an array.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass, field, replace
from decimal import Decimal

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..errors import LogicError, SemanticFault, TooCostlyFault
from ..functions import builtins as B
from ..functions import temporal as T
from ..functions import values as V
from ..sources.model import Model, type_of
from .syntax import Node
from .types import ANY, BOOL, CODE, CONCEPT, DATE, DEC, DT, INT, LONG, NAMED, QTY, RANK, RATIO, REAL, STR, TIME, UNC, VOCAB, Type, Val, interval_of, list_of, none, tuple_of

KEY = "__subject"


class Frame:
    """Rows that scalars are columns of; key: is there a subject column?"""

    def __init__(self, df: DataFrame, keyed: bool, rows: bool = False):
        self.df, self.keyed, self.rows, self.subject = df, keyed, rows, None
        self.run = None

    def aggregate(self, df: DataFrame, keyed: bool, make: Column) -> None:
        """Attach an aggregate of a table; those of one table that follow each other share its scan, shuffle and join."""
        if self.run is None or self.run["after"] is not self.df:
            self.run = {"before": self.df, "groups": []}
        for g in self.run["groups"]:
            if g["keyed"] == keyed and len(g["own"].columns) == len(df.columns) and g["own"].sameSemantics(df):
                g["df"] = g["df"].withColumns({new: F.col(old) for old, new in zip(g["own"].columns, df.columns) if new not in g["df"].columns})
                g["makes"].append(make)
                break
        else:
            self.run["groups"].append({"own": df, "df": df, "keyed": keyed, "makes": [make]})
        self.df = self.run["before"]
        for g in self.run["groups"]:
            self.attach((g["df"].groupBy(KEY) if g["keyed"] else g["df"].groupBy()).agg(*g["makes"]))
        self.run["after"] = self.df

    def attach(self, scalars: DataFrame) -> None:
        """Join one row per subject (or one row) to the frame."""
        self.df = self.df.join(scalars, KEY, "left") if self.keyed else self.df.crossJoin(F.broadcast(scalars))


@dataclass
class Rel:
    """A list in set form: its rows, the element as a value over them, and how they are ordered."""

    df: DataFrame
    value: Val
    order: list[Column] = field(default_factory=list)
    keyed: bool = False
    fresh: bool = False

    @property
    def type(self) -> Type:
        return list_of(self.value.type)


class Scope:
    """Names in reach: aliases and lets, operands, the frame, and the library they are looked up in."""

    def __init__(self, unit, frame: Frame, parent: Scope | None = None, context: str | None = None):
        self.unit, self.frame, self.parent, self.names, self.context = unit, frame, parent, {}, context or (parent.context if parent else None)

    def child(self, frame: Frame | None = None) -> Scope:
        return Scope(self.unit, frame or self.frame, self)

    def find(self, name: str):
        s = self
        while s:
            if name in s.names:
                return s.names[name]
            s = s.parent
        return None


def literal_decimal(text: str) -> Val:
    whole, _, frac = text.partition(".")
    if frac:
        if len(whole.lstrip("0")) > 20 or len(frac) > 8:
            raise SemanticFault(f"{text} is out of the decimal range")
        return Val(V.dec(text), DEC, text)
    if int(text) > 2**31:
        raise SemanticFault(f"{text} is out of the integer range")
    return Val(F.lit(int(text)).cast("bigint"), INT, text)


class Lowerer:
    """Lowers one library (and those it includes) over a model."""

    def __init__(self, spark, library: Node, model: Model | None, now: dt.datetime, parameters: dict, terminology=None, includes: dict | None = None, externals: dict | None = None, units=None):
        self.spark, self.library, self.model, self.now, self.parameters = spark, library, model or Model(), now, parameters
        self.terminology, self.includes, self.externals = terminology, includes or {}, externals or {}
        self.count, self.active, self.trace = 0, [], None
        #: Greatest number of rows that a retrieve may have; set where data may be read.
        self.max_retrieve: int | None = None
        f = library.fields
        self.defines = {d.name: d for d in f["defines"]}
        self.functions: dict[str, list[Node]] = {}
        for fn in f["functions"]:
            self.functions.setdefault(fn.name, []).append(fn)
        self.valuesets = {v.name: v.id for v in f["valuesets"]}
        self.codesystems = {c.name: c.id for c in f["codesystems"]}
        self.codes = {c.name: c for c in f["codes"]}
        self.concepts = {c.name: c for c in f["concepts"]}
        self.params = {p.name: p for p in f["parameters"]}

    # entry points
    def frame(self, context: str | None) -> Frame:
        """One row per subject of a context, or a single row without one."""
        e = self.model.find(context) if context and context != "Unfiltered" else None
        if e is None:
            if context not in (None, "Unfiltered", "Patient", "Practitioner", "Encounter"):
                raise SemanticFault(f"unknown context {context}")
            return Frame(self.spark.range(1).select(F.lit(1).alias("__one")), False)
        df = e.load()
        frame = Frame(df.select(F.col(e.key).alias(KEY), F.struct(*df.columns).alias("__context")), True)
        frame.subject = Val(F.col("__context"), type_of(frame.df.schema["__context"].dataType))
        return frame

    def define(self, name: str) -> DataFrame:
        """A definition for all subjects: columns subject (in a context) and value; one row per element of a list."""
        d = self.defines[name]
        frame = self.frame(d.context)
        scope = Scope(self, frame, None, d.context)
        got = self.lower_define(name, scope)
        if isinstance(got, Rel):
            cols = [F.col(KEY).alias("subject")] if got.keyed else []
            return got.df.select(*cols, plain(got.value).alias("value"))
        cols = [F.col(KEY).alias("subject")] if frame.keyed else []
        return frame.df.select(*cols, plain(got).alias("value"))

    def lower_define(self, name: str, scope: Scope):
        if name in self.active:
            raise SemanticFault(f"{name} refers to itself")
        d = self.defines[name]
        self.active.append(name)
        try:
            inner = Scope(self, scope.frame, None, d.context)
            return self.lower(d.body, inner)
        except LogicError as e:
            if e.define is None:
                raise type(e)(e.message, e.pos, name) from None
            raise
        finally:
            self.active.pop()

    def lower(self, n: Node, scope: Scope):
        """A Val or Rel; errors get the node's place."""
        try:
            out = getattr(self, "n_" + n.kind)(n, scope)
        except LogicError as e:
            if e.pos is None:
                raise type(e)(e.message, n.pos, e.define) from None
            raise
        if self.trace:
            self.trace(n, out)
        return out

    def val(self, n: Node, scope: Scope) -> Val:
        """The node as a value; set form becomes an array."""
        return self.as_val(self.lower(n, scope), scope)

    def as_val(self, got, scope: Scope) -> Val:
        return self.to_array(got, scope) if isinstance(got, Rel) else got

    def fresh(self, stem: str) -> str:
        self.count += 1
        return f"{stem}__{self.count}"

    # set form to scalars
    def scalar(self, rel: Rel, scope: Scope, make, t: Type, empty=None) -> Val:
        """An aggregate of a list in set form, joined to the frame; empty: its value for a subject without rows."""
        name = self.fresh("agg")
        scope.frame.aggregate(rel.df, rel.keyed, make.alias(name))
        col = F.col(name)
        return Val(F.coalesce(col, empty) if empty is not None else col, t)

    def to_array(self, rel: Rel, scope: Scope) -> Val:
        rows = rel.df.withColumns({f"__o{k}": o for k, o in enumerate(rel.order)} | {"__v": rel.value.col})
        entry = F.struct(*(F.col(f"__o{k}") for k in range(len(rel.order))), F.col("__v"))
        packed = F.transform(F.array_sort(F.collect_list(entry)), lambda x: x["__v"])
        empty = F.array().cast(f"array<{rows.schema['__v'].dataType.simpleString()}>")
        return self.scalar(replace(rel, df=rows), scope, packed, rel.type, empty)

    def n_paren(self, n, s):
        return self.lower(n.inner, s)

    # literals
    def n_null(self, n, s):
        return none()

    def n_boolean(self, n, s):
        return Val(F.lit(n.value), BOOL, n.value)

    def n_string(self, n, s):
        return Val(F.lit(n.text), STR, n.text)

    def n_number(self, n, s):
        if n.text == "2147483648":
            raise SemanticFault("2147483648 is out of the integer range")
        return literal_decimal(n.text)

    def n_long(self, n, s):
        if int(n.text) >= 2**63:
            raise SemanticFault(f"{n.text} is out of the long range")
        return Val(F.lit(int(n.text)).cast("bigint"), LONG, n.text)

    def n_quantity(self, n, s):
        return Val(V.quantity(V.dec(n.value), F.lit(n.unit)), QTY, (n.value, n.unit))

    def n_ratio(self, n, s):
        return Val(F.struct(self.n_quantity(n.numerator, s).col.alias("numerator"), self.n_quantity(n.denominator, s).col.alias("denominator")), RATIO)

    def n_date(self, n, s):
        return T.literal(n.text, DATE)

    def n_datetime(self, n, s):
        return T.literal(n.text, DT)

    def n_time(self, n, s):
        return T.literal(n.text[1:], TIME)

    def n_external(self, n, s):
        return self.parameter(n.name) if n.name in self.parameters or n.name in self.params else none()

    def parameter(self, name: str) -> Val:
        p = self.params.get(name)
        want = self.type(p.type) if p is not None and p.type else None
        if name in self.parameters:
            got = self.python(self.parameters[name])
            return V.convert(got, want) if want and got.type != want and not (got.type.name == want.name) else got
        if p is None or p.default is None:
            return none(want or ANY)
        return self.val(p.default, Scope(self, Frame(self.spark.range(1), False), None, None))

    def python(self, x) -> Val:
        """A Python value as a literal; a pair is a closed interval."""
        if isinstance(x, Val):
            return x
        if x is None:
            return none()
        if isinstance(x, bool):
            return Val(F.lit(x), BOOL, x)
        if isinstance(x, int):
            return Val(F.lit(x).cast("bigint"), INT, str(x))
        if isinstance(x, (float, Decimal)):
            return Val(V.dec(str(x)), DEC, str(x))
        if isinstance(x, dt.datetime):
            return T.literal(x.isoformat(timespec="milliseconds"), DT)
        if isinstance(x, dt.date):
            return T.literal(x.isoformat(), DATE)
        if isinstance(x, tuple) and len(x) == 2:
            return V.make_interval(self.python(x[0]), self.python(x[1]), True, True)
        if isinstance(x, list):
            return self.array([self.python(y) for y in x])
        return Val(F.lit(str(x)), STR, str(x))

    # types
    def type(self, n: Node) -> Type:
        if n.name in ("List", "Interval"):
            return Type(n.name, (self.type(n.args[0]),))
        if n.name == "Tuple":
            return tuple_of((k, self.type(t)) for k, t in n.args)
        if n.name == "Choice":
            return Type("Choice", tuple((t.name, self.type(t)) for t in n.args))
        name = n.name.split(".")[-1]
        if name in NAMED:
            return NAMED[name]
        if name in ("Vocabulary", "ValueSet", "CodeSystem"):
            return VOCAB
        e = self.model.find(name)
        if e:
            return type_of_frame(e.load())
        raise SemanticFault(f"unknown type {n.name}")

    # names
    def n_name(self, n, s):
        got = s.find(n.name)
        if got is not None:
            return got() if callable(got) else got
        if n.name in self.defines:
            return self.lower_define(n.name, s)
        if n.name in self.params or n.name in self.parameters:
            return self.parameter(n.name)
        if n.name in self.codes:
            return self.code(self.codes[n.name])
        if n.name in self.concepts:
            c = self.concepts[n.name]
            codes = [self.code(self.codes[x]) for x in c.codes]
            return Val(F.struct(F.array(*(x.col for x in codes)).alias("codes"), F.lit(c.display).cast("string").alias("display")), CONCEPT)
        if n.name in self.valuesets:
            return Val(F.lit(self.valuesets[n.name]), VOCAB, ("valueset", self.valuesets[n.name]))
        if n.name in self.codesystems:
            return Val(F.lit(self.codesystems[n.name]), VOCAB, ("codesystem", self.codesystems[n.name]))
        if s.context and n.name.lower() == s.context.lower():
            return self.subject(s)
        raise SemanticFault(f"undefined identifier {n.name}")

    def subject(self, s: Scope) -> Val:
        """The context's entity as a column of the frame."""
        f = s.frame
        if f.subject is None:
            if not f.keyed:
                raise SemanticFault("there is no context here")
            e = self.model.find(s.context)
            df, name = e.load(), self.fresh("context")
            f.df = f.df.join(df.select(F.col(e.key).alias(KEY), F.struct(*df.columns).alias(name)), KEY, "left")
            f.subject = Val(F.col(name), type_of_frame(df))
        return f.subject

    def code(self, c: Node) -> Val:
        return self.make_code(c.id, self.codesystems.get(c.system.split(".")[-1], c.system), c.display)

    def make_code(self, code, system, display) -> Val:
        col = F.struct(F.lit(code).alias("code"), F.lit(display).cast("string").alias("display"), F.lit(system).alias("system"), F.lit(None).cast("string").alias("version"))
        return Val(col, CODE)

    def n_codeselector(self, n, s):
        return self.make_code(n.id, self.codesystems.get(n.system, n.system), n.display)

    def n_conceptselector(self, n, s):
        codes = [self.n_codeselector(c, s).col for c in n.codes]
        return Val(F.struct(F.array(*codes).alias("codes"), F.lit(n.display).cast("string").alias("display")), CONCEPT)

    def n_member(self, n, s):
        if n.source.kind == "name" and n.source.name in self.includes and s.find(n.source.name) is None:
            other = self.includes[n.source.name]
            return other.n_name(Node("name", n.pos, name=n.name), Scope(other, s.frame, None, s.context))
        got = self.lower(n.source, s)
        if isinstance(got, Rel):
            return replace(got, value=self.member(got.value, n.name))
        return self.member(got, n.name)

    def member(self, v: Val, name: str) -> Val:
        t = v.type
        if t == ANY:
            return none()
        if t.name == "List":
            inner = self.member(Val(F.col("x"), t.item), name).type
            out = F.filter(F.transform(v.col, lambda x: self.member(Val(x, t.item), name).col), lambda x: x.isNotNull())
            return Val(out, list_of(inner))
        parts = {"Quantity": {"value": DEC, "unit": STR}, "Code": {c: STR for c in ("code", "display", "system", "version")}, "Concept": {"codes": list_of(CODE), "display": STR}, "Ratio": {"numerator": QTY, "denominator": QTY}}.get(t.name)
        if t.name == "Interval":
            parts = {"low": t.item, "high": t.item, "lowClosed": BOOL, "highClosed": BOOL}
        if t.name in ("Tuple", "Choice"):
            parts = dict(t.args)
        if parts is None:
            raise SemanticFault(f"{t} has no element {name}")
        if name in parts:
            return native(Val(v[name], parts[name]))
        # choice elements: value stands for valueQuantity, valueString and so on, whichever is there
        branches = [(k, x) for k, x in parts.items() if k.startswith(name) and k[len(name) : len(name) + 1].isupper()]
        if branches:
            vals, u = V.unify(*(native(Val(v[k], x)) for k, x in branches))
            return Val(F.coalesce(*(x.col for x in vals)), u)
        raise SemanticFault(f"{t} has no element {name}")

    def n_index(self, n, s):
        got = self.lower(n.source, s)
        i = self.val(n.index, s)
        if i.type not in (INT, LONG, ANY):
            raise SemanticFault("an index is an Integer")
        if isinstance(got, Rel) and i.literal is not None:
            return self.nth(got, s, int(i.literal))
        v = self.as_val(got, s)
        if v.type not in (STR, ANY) and v.type.name != "List":
            raise SemanticFault(f"{v.type} can't be indexed")
        return B.indexer(v, i) if v.type != ANY else none()

    def nth(self, rel: Rel, s: Scope, k: int, last: bool = False) -> Val:
        """One element of an ordered list in set form, without gathering the list."""
        if k == 0:
            at = F.struct(*rel.order) if rel.order else F.lit(0)
            pick = F.max_by if last else F.min_by
            held = replace(rel, df=rel.df.withColumn("__v", F.struct(rel.value.col.alias("v"))).withColumn("__at", at))
            v = self.scalar(held, s, pick("__v", "__at"), rel.value.type)
            return Val(v.col["v"], rel.value.type)
        ranked = self.ranked(rel)
        return self.scalar(replace(ranked, df=ranked.df.where(F.col("__rank") == k + 1)), s, F.first(ranked.value.col), rel.value.type)

    def ranked(self, rel: Rel) -> Rel:
        w = Window.partitionBy(*([KEY] if rel.keyed else [F.lit(1)])).orderBy(*(rel.order or [F.lit(0)]))
        return replace(rel, df=rel.df.withColumn("__rank", F.row_number().over(w)))

    # conditionals and selectors
    def n_if(self, n, s):
        cond = self.val(n.cond, s)
        (yes, no), t = V.unify(self.val(n.yes, s), self.val(n.no, s))
        return Val(F.when(self.truth(cond), yes.col).otherwise(no.col), t)

    def n_case(self, n, s):
        subject = self.val(n.subject, s) if n.subject else None
        whens = [self.val(w, s) for w, _ in n.items]
        vals, t = V.unify(*(self.val(v, s) for _, v in n.items), self.val(n.other, s))
        out = None
        for w, v in zip(whens, vals):
            cond = V.equal(subject, w) if subject else self.truth(w)
            out = F.when(cond, v.col) if out is None else out.when(cond, v.col)
        return Val(out.otherwise(vals[-1].col), t)

    def truth(self, v: Val) -> Column:
        if v.type == ANY:
            return F.lit(None).cast("boolean")
        if v.type != BOOL:
            raise SemanticFault(f"expected a Boolean, found {v.type}")
        return v.col

    def n_interval(self, n, s):
        low, high = self.val(n.low, s), self.val(n.high, s)
        if low.type == ANY and high.type == ANY:
            return Val(F.lit(None).cast(interval_of(INT).ddl), interval_of(INT))
        got = V.make_interval(low, high, n.low_closed, n.high_closed)
        if low.literal is not None and high.literal is not None and isinstance(low.literal, str) and isinstance(high.literal, str) and Decimal(low.literal) > Decimal(high.literal):
            raise SemanticFault("the interval's low bound is above its high bound")
        return got

    def n_tuple(self, n, s):
        parts = [(k, self.val(v, s)) for k, v in n.parts]
        parts.sort(key=lambda p: p[0])
        return Val(F.struct(*(v.col.alias(k) for k, v in parts)) if parts else F.lit(None), tuple_of((k, v.type) for k, v in parts))

    def n_instance(self, n, s):
        parts = {k: self.val(v, s) for k, v in n.parts}
        null = lambda t: none(t)
        if n.type == "Quantity":
            return Val(V.quantity(V.convert(parts.get("value", null(DEC)), DEC).col, V.convert(parts.get("unit", parts.get("code", null(STR))), STR).col), QTY)
        if n.type == "Code":
            return Val(F.struct(*(V.convert(parts.get(c, null(STR)), STR).col.alias(c) for c in ("code", "display", "system", "version"))), CODE)
        if n.type == "Concept":
            return Val(F.struct(V.convert(parts["codes"], list_of(CODE)).col.alias("codes"), V.convert(parts.get("display", null(STR)), STR).col.alias("display")), CONCEPT)
        return self.n_tuple(Node("tuple", n.pos, parts=n.parts), s)

    def array(self, vals: list[Val]) -> Val:
        if not vals:
            return Val(F.array().cast("array<void>"), list_of(ANY))
        vals, t = V.unify(*vals)
        return Val(F.array(*(v.col for v in vals)), list_of(t))

    def n_list(self, n, s):
        got = self.array([self.val(x, s) for x in n.items])
        return V.convert(got, list_of(self.type(n.type))) if n.type is not None else got

    def n_extent(self, n, s):
        return V.extent(self.type(n.type), n.which)

    # operators
    def n_unary(self, n, s):
        op = n.op
        if op == "-" and n.arg.kind == "number" and n.arg.text == "2147483648":
            return Val(F.lit(-(2**31)).cast("bigint"), INT, "-2147483648")
        if op in ("exists", "distinct", "flatten", "singleton"):
            return self.n_call(Node("call", n.pos, name={"exists": "Exists", "distinct": "Distinct", "flatten": "Flatten", "singleton": "SingletonFrom"}[op], args=[n.arg], receiver=None), s)
        v = self.val(n.arg, s)
        if op == "not":
            return Val(~self.truth(v), BOOL)
        if op == "-":
            got = V.negate(v)
            return Val(got.col, got.type, "-" + v.literal) if isinstance(v.literal, str) and v.type.number else got
        if op == "+":
            return v
        if v.type == ANY:
            return none()
        if op in ("start", "end", "width", "point") and v.type.name != "Interval":
            raise SemanticFault(f"expected an Interval, found {v.type}")
        return {"start": V.start, "end": V.end, "width": B.width, "point": B.point_from, "successor": lambda x: V.step(x, 1), "predecessor": lambda x: V.step(x, -1)}[op](v)

    def n_binary(self, n, s):
        op = n.op
        if op in ("and", "or", "xor", "implies"):
            a, b = self.truth(self.val(n.left, s)), self.truth(self.val(n.right, s))
            return Val({"and": lambda: a & b, "or": lambda: a | b, "xor": lambda: a != b, "implies": lambda: ~a | b}[op](), BOOL)
        left, right = self.lower(n.left, s), self.lower(n.right, s)
        if op in ("union", "intersect", "except"):
            return self.set_op(op, left, right, s)
        if op == "in" and not isinstance(left, Rel) and isinstance(right, Val) and right.type == VOCAB:
            return self.in_terms(left, right, s)
        a, b = self.as_val(left, s), self.as_val(right, s)
        if op in ("in", "contains"):
            x, xs = (a, b) if op == "in" else (b, a)
            if xs.type == ANY:
                return Val(F.lit(None if op == "contains" else False).cast("boolean"), BOOL)
            if xs.type.name == "Interval":
                return Val(V.contains(xs, x, n.precision), BOOL)
            if xs.type.name == "List":
                if n.precision:
                    return Val(F.coalesce(F.exists(xs.col, lambda y: V.order(Val(y, xs.type.item), x, n.precision) == 0), F.lit(False)), BOOL)
                if x.type == ANY and op == "contains":
                    return Val(F.when(F.size(xs.col) == 0, F.lit(None)).otherwise(F.exists(xs.col, lambda y: y.isNull())), BOOL)
                return Val(F.coalesce(B.member(xs, x), F.lit(False)) if not x.type.temporal else B.member(xs, x), BOOL)
            raise SemanticFault(f"{xs.type} is no list or interval")
        if op in ("=", "!="):
            c = V.equal(a, b)
            return Val(c if op == "=" else ~c, BOOL)
        if op in ("~", "!~"):
            c = V.equivalent(a, b)
            return Val(c if op == "~" else ~c, BOOL)
        if op in ("<", "<=", ">", ">="):
            if ANY in (a.type, b.type):
                return none(BOOL)
            return Val(V.relation(op, a, b), BOOL)
        return V.arithmetic(op, a, b)

    def set_op(self, op, left, right, s):
        if isinstance(left, Val) and isinstance(right, Val) and "Interval" in (left.type.name, right.type.name):
            if ANY in (left.type, right.type):
                return none(left.type if right.type == ANY else right.type)
            return V.interval_set(op, left, right)
        return B.list_set(op, self.as_val(left, s), self.as_val(right, s))

    def in_terms(self, code: Val, terms: Val, s: Scope) -> Val:
        """Membership of a code, concept or string in a value set or code system."""
        kind, url = terms.literal
        if kind == "codesystem":
            one = lambda c: c["system"] == F.lit(url)
        else:
            if self.terminology is None:
                return none(BOOL)
            one = self.terminology.test(url)
        if code.type == CODE:
            return Val(F.coalesce(one(code.col), F.lit(False)), BOOL)
        if code.type == CONCEPT:
            return Val(F.coalesce(F.exists(code["codes"], one), F.lit(False)), BOOL)
        if code.type.name == "List":
            return Val(F.coalesce(F.exists(code.col, lambda c: self.in_terms(Val(c, code.type.item), terms, s).col), F.lit(False)), BOOL)
        if code.type == STR:
            return Val(F.coalesce(self.terminology.test_text(url)(code.col), F.lit(False)), BOOL)
        raise SemanticFault(f"expected a Code, found {code.type}")

    def n_timing(self, n, s):
        a, b = self.val(n.left, s), self.val(n.right, s)
        if n.left_end and a.type.name == "Interval":
            a = V.start(a) if n.left_end == "start" else V.end(a)
        if n.right_end and b.type.name == "Interval":
            b = V.start(b) if n.right_end == "start" else V.end(b)
        if "List" in (a.type.name, b.type.name):
            for x, y in ((a, b), (b, a)):
                if x.type.name == "Interval" and y.type.name == "List" and y.type.item.name not in ("Interval", "Any"):
                    raise SemanticFault(f"{n.op} doesn't take {a.type} and {b.type}")
            return Val(B.list_timing(n.op, a, b, n.proper), BOOL)
        return Val(V.timing(n.op, a, b, n.precision, n.proper, n.offset), BOOL)

    def n_between(self, n, s):
        x, lo, hi = self.val(n.arg, s), self.val(n.low, s), self.val(n.high, s)
        if ANY in (x.type, lo.type, hi.type):
            return none(BOOL)
        return Val(V.relation(">" if n.proper else ">=", x, lo) & V.relation("<" if n.proper else "<=", x, hi), BOOL)

    def n_isvalue(self, n, s):
        v = self.val(n.arg, s)
        c = v.null if n.value == "null" else v.col.eqNullSafe(F.lit(n.value == "true")) if v.type == BOOL else F.lit(False)
        return Val(~c if n.negate else c, BOOL)

    def n_is(self, n, s):
        v, t = self.val(n.arg, s), self.type(n.type)
        if v.type.name == "Choice":
            return Val(v[t.name].isNotNull(), BOOL)
        fits = v.type.name == t.name or t == ANY or (v.type == REAL and t == DEC)
        return Val(~v.null if fits and v.type != ANY else F.lit(False), BOOL)

    def n_as(self, n, s):
        v, t = self.val(n.arg, s), self.type(n.type)
        if v.type.name == "Choice" and t.name in dict(v.type.args):
            return Val(v[t.name], t)
        if v.type == UNC and t.name == "Interval":
            return V.make_interval(Val(v["low"], INT), Val(v["high"], INT), True, True)
        if v.type.name == t.name:
            return v if not v.type.temporal else v
        return V.convert(v, t) if v.type == ANY or (v.type.name == t.name == "List") else none(t)

    def n_cast(self, n, s):
        v, t = self.val(n.arg, s), self.type(n.type)
        wrong = F.raise_error(F.lit(f"cast: the value is no {t}"))
        if v.type.name == "Choice" and t.name in dict(v.type.args):
            return Val(F.when(v.null | v[t.name].isNotNull(), v[t.name]).otherwise(wrong), t)
        if v.type == ANY or v.type.name == t.name or {v.type.name, t.name} <= set(RANK) or {v.type.name, t.name} in ({"Date", "DateTime"}, {"Code", "Concept"}):
            return self.changed(v, t)
        return Val(F.when(v.null, none(t).col).otherwise(wrong), t)

    def n_convert(self, n, s):
        return self.changed(self.val(n.arg, s), self.type(n.type))

    def changed(self, v: Val, t: Type) -> Val:
        if v.type == t or v.type == ANY:
            return V.convert(v, t)
        if t.name in B.CONVERT:
            return B.CONVERT[t.name](v)
        return V.convert(v, t)

    def n_convertunit(self, n, s):
        return Val(V.converted(B.to_quantity(self.val(n.arg, s)).col, F.lit(n.unit)), QTY)

    def n_component(self, n, s):
        v = self.val(n.arg, s)
        if v.type == ANY:
            return none(INT)
        if not v.type.temporal:
            raise SemanticFault(f"expected a date or time, found {v.type}")
        return T.component(v, n.unit)

    def n_spanbetween(self, n, s):
        return self.spans(n, self.val(n.low, s), self.val(n.high, s))

    def n_spanof(self, n, s):
        v = self.val(n.arg, s)
        if v.type.name != "Interval":
            return none(INT)
        k = v.literal
        low, high = (k[1], k[2]) if isinstance(k, tuple) else (Val(v["low"], v.type.item), Val(v["high"], v.type.item))
        return self.spans(n, low, high)

    def spans(self, n, a: Val, b: Val) -> Val:
        if ANY in (a.type, b.type):
            return none(INT)
        if a.type.name == "Interval" or b.type.name == "Interval" or not (a.type.temporal and b.type.temporal):
            raise SemanticFault("a duration is between two dates or times")
        if a.type.name != b.type.name:
            a, b = T.to_span(a), T.to_span(b)
        return T.between(a, b, n.unit, n.what == "difference")

    def n_collapse(self, n, s):
        xs = self.val(n.arg, s)
        if xs.type == ANY or xs.type.item == ANY:
            return none(list_of(interval_of(INT)))
        return B.collapse(xs, self.val(n.per, s) if n.per is not None else None)

    def n_expand(self, n, s):
        v = self.val(n.arg, s)
        if v.type == ANY or (v.type.name == "List" and v.type.item == ANY):
            return none(list_of(INT))
        return B.expand(v, self.val(n.per, s) if n.per is not None else None)

    # functions
    def n_call(self, n, s):
        name, args = n.name, list(n.args)
        if n.receiver is not None:
            if n.receiver.kind == "name" and n.receiver.name in self.includes and s.find(n.receiver.name) is None:
                other = self.includes[n.receiver.name]
                return other.call_user(name, [self.lower(a, s) for a in args], s)
            if name.lower() in ("where", "select") and name not in self.functions:
                return self.fluent(n, s)
            args = [n.receiver, *args]
        low = name.lower()
        if name in self.functions:
            return self.call_user(name, [self.lower(a, s) for a in args], s)
        special = getattr(self, "f_" + low, None)
        if special:
            return special(args, s)
        got = [self.lower(a, s) for a in args]
        if got and isinstance(got[0], Rel) and low in SET_FORM:
            out = SET_FORM[low](self, got[0], [self.as_val(g, s) for g in got[1:]], s)
            if out is not None:
                return out
        vals = [self.as_val(g, s) for g in got]
        f = B.TABLE.get(low)
        if f is None:
            raise SemanticFault(f"unknown function {name}")
        if vals and vals[0].type == ANY and low not in NULL_SAFE:
            return none(B_RESULT.get(low, ANY))
        try:
            return f(*vals)
        except TypeError as e:
            if "argument" not in str(e):
                raise
            raise SemanticFault(f"no overload of {name} takes {len(vals)} arguments") from None

    def call_user(self, name: str, args: list, s: Scope):
        """A function of the library, written out in place with its operands bound."""
        fits = [f for f in self.functions.get(name, []) if len(f.params) == len(args)]
        best, cost = None, None
        for f in fits:
            c = 0
            for (_, t), a in zip(f.params, args):
                want = self.type(t)
                c += 0 if want == a.type or want.name == a.type.name else 1 if a.type == ANY or want == ANY else 2 if V.common(want, a.type) else 100
            if c < 100 and (cost is None or c < cost):
                best, cost = f, c
        if best is None:
            raise SemanticFault(f"no overload of {name} takes ({', '.join(str(a.type) for a in args)})")
        if best.body is None:
            if name not in self.externals:
                raise SemanticFault(f"the external function {name} isn't registered")
            out = self.type(best.returns)
            return Val(self.externals[name](*(self.as_val(a, s).col for a in args)).cast(out.ddl), out)
        if name in self.active:
            raise SemanticFault(f"{name} calls itself")
        inner = Scope(self, s.frame, None, s.context)
        inner.names = {p: V.convert(a, self.type(t)) if isinstance(a, Val) and a.type.name != self.type(t).name else a for (p, t), a in zip(best.params, args)}
        self.active.append(name)
        try:
            return self.lower(best.body, inner)
        finally:
            self.active.pop()

    def fluent(self, n, s):
        """x.where(c) and x.select(e), with $this and $index."""
        xs = B.items(self.val(n.receiver, s))

        def run(x, i):
            inner = s.child()
            inner.names = {"$this": Val(x, xs.type.item), "$index": Val(i.cast("bigint"), INT)}
            return self.val(n.args[0], inner)

        if n.name.lower() == "where":
            return Val(F.filter(xs.col, lambda x, i: run(x, i).col), xs.type)
        t = run(F.col("x"), F.col("i")).type
        return Val(F.filter(F.transform(xs.col, lambda x, i: run(x, i).col), lambda x: x.isNotNull()), list_of(t))

    def f_now(self, args, s):
        return T.literal(self.now.isoformat(timespec="milliseconds"), DT)

    def f_today(self, args, s):
        return T.literal(self.now.date().isoformat(), DATE)

    def f_timeofday(self, args, s):
        return T.literal("T" + self.now.time().isoformat(timespec="milliseconds"), TIME)

    def f_message(self, args, s):
        src = self.lower(args[0], s)
        cond, code, severity, text = (self.val(a, s) for a in args[1:5])
        v = self.as_val(src, s)
        if cond.literal is False or (severity.literal is not None and severity.literal != "Error"):
            return v
        fatal = self.truth(cond) & (severity.col == "Error")
        return Val(F.when(fatal, F.raise_error(F.concat_ws(": ", code.col, text.col)).cast(v.type.ddl if v.type != ANY else "string")).otherwise(v.col), v.type)

    def f_not(self, args, s):
        return Val(~self.truth(self.val(args[0], s)), BOOL)

    def f_children(self, args, s):
        v = self.val(args[0], s)
        if v.type.name != "Tuple":
            return self.array([])
        return Val(F.filter(F.array(*(V.text(native(Val(v[k], t))) if t.name not in ("Tuple", "List") else F.to_json(v[k]) for k, t in v.type.args)), lambda x: x.isNotNull()), list_of(STR))

    def f_descendents(self, args, s):
        v = self.val(args[0], s)
        if v.type.name != "Tuple":
            return self.array([])
        flat = [self.f_children([_Given(v)], s).col] + [self.f_descendents([_Given(Val(v[k], t))], s).col.cast("array<string>") for k, t in v.type.args if t.name == "Tuple"]
        return Val(F.concat(*flat), list_of(STR))

    f_descendants = f_descendents

    def n_given(self, n, s):
        return n.value

    def _age(self, unit, birth, at):
        return B.age(unit)(birth, at)

    def birth(self, s: Scope) -> Val:
        e = self.model.find(s.context) if s.context else None
        subject = self.subject(s)
        name = (e.birth if e else None) or "birthDate"
        return self.member(subject, name)

    def f_anyinvalueset(self, args, s):
        v = self.val(args[0], s)
        return self.in_terms(B.items(v), self.val(args[1], s), s) if v.type != ANY else none(BOOL)

    def f_anyincodesystem(self, args, s):
        v = self.val(args[0], s)
        return Val(F.when(~v.null, self.in_terms(B.items(v), self.val(args[1], s), s).col), BOOL) if v.type != ANY else none(BOOL)

    def f_invalueset(self, args, s):
        return self.in_terms(self.val(args[0], s), self.val(args[1], s), s)

    def f_incodesystem(self, args, s):
        return self.in_terms(self.val(args[0], s), self.val(args[1], s), s)

    def f_expandvalueset(self, args, s):
        if self.terminology is None:
            return none(list_of(CODE))
        _, url = self.val(args[0], s).literal
        return Rel(self.terminology.expand(url), Val(F.col("code"), CODE), [F.col("code.system"), F.col("code.code")])

    def f_subsumes(self, args, s):
        if self.terminology is None:
            return none(BOOL)
        a, b = (self.val(x, s) for x in args)
        return Val(F.when(a.null | b.null, F.lit(None)).otherwise((a["system"] == b["system"]) & ((a["code"] == b["code"]) | self.terminology.subsumes()(a.col, b.col))), BOOL)

    def f_subsumedby(self, args, s):
        return self.f_subsumes([args[1], args[0]], s)

    # retrieve and query
    def n_retrieve(self, n, s):
        e = self.model.find(n.type)
        if e is None:
            raise SemanticFault(f"unknown type {n.type}")
        df = e.load()
        alias = self.fresh("row")
        keep = [F.struct(*df.columns).alias(alias)]
        keyed = s.frame.keyed and s.context not in (None, "Unfiltered")
        context = n.related or s.context
        if keyed:
            if context in e.subject:
                keep.append(F.col(e.subject[context]).alias(KEY))
            elif context in e.via:
                other, own, its = e.via[context]
                o = self.model.find(other)
                link = o.load().select(F.col(its).alias("__its"), F.col(o.subject[context]).alias(KEY))
                df = df.join(link, df[own] == F.col("__its"))
                keep = [F.struct(*e.load().columns).alias(alias), F.col(KEY)]
            else:
                keyed = False
        rel = Rel(df.select(*keep), Val(F.col(alias), type_of_frame(e.load())), [F.col(f"{alias}.{c}") for c in e.order], keyed)
        if keyed is False and s.frame.keyed:
            # not related to the subject: the same list for each
            rel = replace(rel, df=s.frame.df.select(KEY).distinct().crossJoin(rel.df), keyed=True)
        if n.codes is not None:
            path = n.path or e.code
            if path is None:
                raise SemanticFault(f"{n.type} has no primary code path")
            code = self.member(rel.value, path)
            terms = self.val(n.codes, s)
            if terms.type == VOCAB and terms.literal[0] == "valueset" and code.type == STR:
                # a semi join against the value set
                if self.terminology is None:
                    raise SemanticFault("there is no terminology")
                wanted = self.terminology.expand(terms.literal[1]).select(F.col("code.code").alias("__code"))
                side = F.broadcast(wanted) if self.terminology.small else wanted
                rel = replace(rel, df=rel.df.join(side, code.col == F.col("__code"), "left_semi"))
            elif terms.type == VOCAB:
                rel = replace(rel, df=rel.df.where(self.in_terms(code, terms, s).col))
            else:
                if code.type == STR and terms.type == CODE:
                    cond = code.col == terms["code"]
                elif terms.type.name == "List":
                    cond = B.member(terms, code)
                else:
                    cond = V.equivalent(code, terms)
                rel = replace(rel, df=rel.df.where(cond))
        if self.max_retrieve is not None and rel.df.limit(self.max_retrieve + 1).count() > self.max_retrieve:
            raise TooCostlyFault(f"[{n.type}] has more than {self.max_retrieve} rows")
        return rel

    def n_query(self, n, s):
        got = [(self.lower(src, s), alias) for src, alias in n.sources]
        if all(isinstance(g, Val) for g, _ in got):
            return self.array_query(n, got, s)
        return self.set_query(n, got, s)

    def set_query(self, n, got, s):
        """A query with a table among its sources."""
        names, order, frame = {}, [], None
        for g, alias in got:
            col = self.fresh(alias)
            if isinstance(g, Val):
                base = s.frame if not s.frame.rows else s.frame
                keep = [F.col(KEY)] if base.keyed else []
                xs = B.items(g)
                part = base.df.select(*keep, F.posexplode(xs.col).alias(f"{col}_at", col))
                g = Rel(part, Val(F.col(col), xs.type.item), [F.col(f"{col}_at")], base.keyed)
            else:
                keep = [F.col(KEY)] if g.keyed else []
                cols = [o.alias(f"{col}_o{k}") for k, o in enumerate(g.order)]
                g = Rel(g.df.select(*keep, g.value.col.alias(col), *cols), Val(F.col(col), g.value.type), [F.col(f"{col}_o{k}") for k in range(len(g.order))], g.keyed)
            names[alias] = g.value
            order += g.order
            if frame is None:
                frame = Frame(g.df, g.keyed, True)
            elif frame.keyed and g.keyed:
                frame.df = frame.df.join(g.df, KEY)
            else:
                frame.df, frame.keyed = frame.df.crossJoin(g.df), frame.keyed or g.keyed
        inner = Scope(self, frame, s if not s.frame.rows else s, s.context)
        inner.names = dict(names)
        for name, e in n.lets:
            inner.names[name] = self.as_val(self.lower(e, inner), inner)
        for r in n.relations:
            self.relate(frame, inner, r.source, r.alias, r.cond, r.negate)
        if n.where is not None:
            for part in conjuncts(n.where):
                self.filter(frame, inner, part)
        if len(names) == 1:
            value = next(iter(names.values()))
        else:
            keys = sorted(names)
            value = Val(F.struct(*(names[k].col.alias(k) for k in keys)), tuple_of((k, names[k].type) for k in keys))
        if n.fold is not None:
            return self.fold(n.fold, names, inner, Rel(frame.df, value, order, frame.keyed), s)
        if n.result is not None:
            value = self.as_val(self.lower(n.result.value, inner), inner)
            frame.df = frame.df.where(value.col.isNotNull())
        rel = Rel(frame.df, value, order, frame.keyed)
        if n.result is not None and n.result.distinct:
            rel = self.distinct(rel)
        return self.sorted(rel, n.sort, s) if n.sort else rel

    def distinct(self, rel: Rel) -> Rel:
        """One row for each value (per subject), at the place of the first."""
        name = self.fresh("v")
        keys = ([KEY] if rel.keyed else []) + [name]
        at = F.min(F.struct(*rel.order)) if rel.order else F.min(F.lit(0))
        df = rel.df.withColumn(name, rel.value.col).groupBy(*keys).agg(at.alias(f"{name}_at"))
        return Rel(df, Val(F.col(name), rel.value.type), [F.col(f"{name}_at")], rel.keyed)

    def sorted(self, rel: Rel, sort, s) -> Rel:
        """Order columns that put nulls last going up and first going down, ties as they came."""
        out = []
        for key, way in sort:
            v = rel.value if key is None else self.sort_key(rel.value, key, s)
            c = rank_of(v)
            out.append(F.struct(v.null.cast("int").alias("n"), c.alias("v")) if way == "asc" else F.struct((1 - v.null.cast("int")).alias("n"), reversed_(c, v)))
        return replace(rel, order=out + rel.order)

    def sort_key(self, value: Val, key: Node, s: Scope) -> Val:
        inner = s.child()
        inner.names = {"$this": value}
        if value.type.name in ("Tuple", "Choice", "Quantity", "Interval", "Code"):
            fields = dict(value.type.args) if value.type.name in ("Tuple", "Choice") else {}
            for k in fields or ("low", "high", "value", "unit", "code", "system", "display"):
                try:
                    inner.names[k] = self.member(value, k)
                except SemanticFault:
                    continue
        return self.val(key, inner)

    def filter(self, frame: Frame, inner: Scope, part: Node) -> None:
        """One conjunct of a where clause; [not] exists of a correlated query is a semi or anti join."""
        negate, e = False, part
        if e.kind == "unary" and e.op == "not" and e.arg.kind == "unary" and e.arg.op == "exists":
            negate, e = True, e.arg
        if e.kind == "unary" and e.op == "exists":
            q = e.arg
            single = q.kind == "query" and len(q.sources) == 1 and not q.relations and q.result is None and q.fold is None
            if single and any(x.kind == "name" and x.name in inner.names for x in q.walk()):
                source, alias = q.sources[0]
                self.relate(frame, inner, source, alias, q.where, negate, q.lets)
                return
        frame.df = frame.df.where(self.truth(self.as_val(self.lower(part, inner), inner)))

    def relate(self, frame: Frame, inner: Scope, source: Node, alias: str, cond: Node | None, negate: bool, lets=()) -> None:
        """with and without: keep the rows for which some row of source makes cond true, or none does."""
        got = self.lower(source, inner)
        if isinstance(got, Val):
            xs = B.items(got)

            def test(x):
                one = inner.child()
                one.names = {alias: Val(x, xs.type.item)}
                return self.val(cond, one).col

            hit = F.coalesce(F.exists(xs.col, test), F.lit(False))
            frame.df = frame.df.where(~hit if negate else hit)
            return
        col, key = self.fresh(alias), self.fresh("key")
        keep = [F.col(KEY).alias(key)] if got.keyed else []
        other = got.df.select(*keep, got.value.col.alias(col))
        one = inner.child(Frame(frame.df, frame.keyed, True))
        one.names = {alias: Val(F.col(col), got.value.type)}
        for name, e in lets:
            one.names[name] = self.val(e, one)
        on = self.truth(self.val(cond, one)) if cond is not None else F.lit(True)
        if got.keyed and frame.keyed:
            on = (F.col(KEY) == F.col(key)) & on
        frame.df = frame.df.join(other, on, "left_anti" if negate else "left_semi")

    def fold(self, fold: Node, names: dict, inner: Scope, rel: Rel, s: Scope):
        """aggregate: sums and counts become grouped aggregation, anything else an ordered fold."""
        start = self.val(fold.start, s) if fold.start is not None else none()
        if fold.distinct:
            rel = self.distinct(rel)
            inner = Scope(self, Frame(rel.df, rel.keyed, True), s, s.context)
            inner.names = {k: Val(rel.value[k], v.type) for k, v in names.items()} if len(names) > 1 else {next(iter(names)): rel.value}
        e = fold.value
        if e.kind == "binary" and e.op == "+" and e.left.kind == "name" and e.left.name == fold.name and not any(x.kind == "name" and x.name == fold.name for x in e.right.walk()) and start.type.number:
            term = self.val(e.right, inner)
            if term.type.number:
                t = V.arithmetic("+", start, term).type
                total = F.sum(V.convert(term, t).col)
                if t == DEC:
                    total = total.cast(DEC.ddl)
                has_null = F.max(term.null.cast("int"))
                got = self.scalar(replace(rel, df=inner.frame.df), s, F.struct(total.alias("v"), has_null.alias("n")), t)
                total = F.when(got.col["n"] == 1, F.lit(None)).otherwise(V.convert(start, t).col + F.coalesce(got.col["v"], F.lit(0).cast(t.ddl)))
                return Val(total.cast(t.ddl), t)
        xs = self.to_array(Rel(inner.frame.df, rel.value, rel.order, rel.keyed), s)
        return self.array_fold(fold, xs, names, start, s)

    def array_fold(self, fold: Node, xs: Val, names: dict, start: Val, s: Scope) -> Val:
        def body(acc: Val, x: Column) -> Val:
            inner = s.child()
            item = Val(x, xs.type.item)
            inner.names = {k: Val(x[k], xs.type.item.field(k)) for k in names} if len(names) > 1 else {next(iter(names)): item}
            inner.names[fold.name] = acc
            return self.val(fold.value, inner)

        t = start.type
        u = body(Val(F.col("acc"), t), F.col("x")).type
        t = u if t == ANY else V.common(t, u) or t
        return Val(F.aggregate(xs.col, V.convert(start, t).col, lambda acc, x: V.convert(body(Val(acc, t), x), t).col), t)

    def array_query(self, n, got, s):
        """A query whose sources are all values: higher-order functions over arrays."""
        one = len(got) == 1 and got[0][0].type.name != "List"
        if one and got[0][0].type == ANY:
            return none()
        lists = [(alias, B.items(g)) for g, alias in got]
        if len(lists) == 1:
            alias, xs = lists[0]
            combos, item = xs.col, xs.type.item
            names = lambda x: {alias: Val(x, item)}
        else:
            keys = [a for a, _ in lists]
            types = {a: xs.type.item for a, xs in lists}

            def product(k, bound):
                a, xs = lists[k]
                if k == len(lists) - 1:
                    return F.transform(xs.col, lambda x: F.struct(*((bound | {a: x})[c].alias(c) for c in sorted(keys))))
                return F.flatten(F.transform(xs.col, lambda x: product(k + 1, bound | {a: x})))

            combos, item = product(0, {}), tuple_of(types.items())
            names = lambda x: {a: Val(x[a], types[a]) for a in keys}

        def scope(x):
            inner = s.child()
            inner.names = names(x)
            for name, e in n.lets:
                inner.names[name] = self.val(e, inner)
            return inner

        def keep(x):
            inner, ok = scope(x), F.lit(True)
            for r in n.relations:
                src = self.as_val(self.lower(r.source, inner), inner)
                ys = B.items(src)

                hit = F.coalesce(F.exists(ys.col, self._meets(r, ys.type.item, inner)), F.lit(False))
                ok = ok & (~hit if r.negate else hit)
            if n.where is not None:
                ok = ok & self.truth(self.val(n.where, inner))
            return ok

        rows = F.filter(combos, keep) if n.relations or n.where is not None else combos
        if n.fold is not None:
            start = self.val(n.fold.start, s) if n.fold.start is not None else none()
            xs = Val(rows, list_of(item))
            if n.fold.distinct:
                xs = B.distinct(xs)
            fold = n.fold
            if n.lets:
                fold = Node("fold", fold.pos, **(fold.fields | {"value": fold.value}))
            return self.array_fold(fold, xs, dict.fromkeys(a for a, _ in lists), start, s)
        t = item
        if n.result is not None:
            t = self.val(n.result.value, scope(F.col("x"))).type
            rows = F.filter(F.transform(rows, lambda x: self.val(n.result.value, scope(x)).col), lambda x: x.isNotNull())
        out = Val(rows, list_of(t))
        if n.result is not None and n.result.distinct:
            out = B.distinct(out)
        if n.sort:
            out = self.array_sort(out, n.sort, s)
        return Val(F.get(out.col, F.lit(0)), t) if one else out

    def _meets(self, r: Node, t: Type, inner: Scope):
        def test(y):
            deep = inner.child()
            deep.names = {r.alias: Val(y, t)}
            return self.val(r.cond, deep).col

        return test

    def array_sort(self, xs: Val, sort, s) -> Val:
        t = xs.type.item

        def compare(a, b):
            out = F.lit(0)
            for key, way in reversed(sort):
                x, y = Val(a, t), Val(b, t)
                if key is not None:
                    x, y = self.sort_key(x, key, s), self.sort_key(y, key, s)
                c = F.when(x.null & y.null, 0).when(x.null, 1).when(y.null, -1).otherwise(F.coalesce(V.order(x, y), F.lit(0)))
                out = F.when(c != 0, -c if way == "desc" else c).otherwise(out)
            return out.cast("int")

        return Val(F.array_sort(xs.col, compare), xs.type)


class _Given(Node):
    """A node that is already lowered."""

    def __init__(self, value):
        super().__init__("given", value=value)


def conjuncts(n: Node) -> list[Node]:
    return conjuncts(n.left) + conjuncts(n.right) if n.kind == "binary" and n.op == "and" else [n]


def type_of_frame(df: DataFrame) -> Type:
    return Type("Tuple", tuple(sorted((f.name, type_of(f.dataType)) for f in df.schema.fields)))


def native(v: Val) -> Val:
    """A stored column in the language's own width."""
    return Val(v.col.cast("bigint"), v.type) if v.type == INT else v


def plain(v: Val) -> Column:
    return v.col if v.type != ANY else v.col.cast("string")


def rank_of(v: Val) -> Column:
    if v.type.temporal and v.type.span:
        return F.struct(v["lo"], v["prec"])
    if v.type == QTY:
        return V.base(v.col)
    return v.col


def reversed_(c: Column, v: Val) -> Column:
    """A column that sorts the other way."""
    if v.type.number or v.type == QTY:
        return (-c).alias("v")
    if v.type == DATE:
        return (-F.unix_date(c)).alias("v")
    if v.type.temporal:
        return (-T.millis(v["lo"] if v.type.span else v.col if v.type != TIME else T.from_millis(v.col))).alias("v")
    if v.type == BOOL:
        return (~c).alias("v")
    # strings: code units turned over, the shorter last
    return F.concat(F.translate(F.hex(c), "0123456789ABCDEF", "FEDCBA9876543210"), F.lit("~")).alias("v")


# set form of functions

def _agg(make, result=None, empty=None):
    def run(low: Lowerer, rel: Rel, args, s: Scope):
        t = rel.value.type
        if t == REAL:
            rel, t = replace(rel, value=Val(V.dec(rel.value.col), DEC)), DEC
        if not (t.number or t == BOOL or make in (_count,)):
            return None
        out = result or t
        col = make(rel.value.col, t)
        return low.scalar(rel, s, col.cast(out.ddl), out, None if empty is None else F.lit(empty))

    return run


def _count(c, t):
    return F.count(c)


def _exists(low, rel, args, s):
    return low.scalar(rel, s, F.count(rel.value.col) > 0, BOOL, F.lit(False))


def _first(last):
    return lambda low, rel, args, s: low.nth(rel, s, 0, last)


def _best(which):
    def run(low, rel, args, s):
        t = rel.value.type
        if (t.number or t == STR or t.temporal) and not t.span:
            return low.scalar(rel, s, which(rel.value.col), t)
        return None

    return run


def _cut(keep):
    def run(low, rel, args, s):
        if any(a.literal is None for a in args):
            return None
        ranked = low.ranked(rel)
        return replace(ranked, df=ranked.df.where(keep(F.col("__rank"), *(int(a.literal) for a in args))).drop("__rank"))

    return run


def _two(f):
    return lambda c, t: F.when(F.count(c) >= 2, F.round(f(c.cast("double")), 8))


SET_FORM = {
    "count": lambda low, rel, args, s: low.scalar(rel, s, F.count(rel.value.col), INT, F.lit(0).cast("bigint")),
    "exists": _exists,
    "sum": _agg(lambda c, t: F.sum(c)),
    "avg": _agg(lambda c, t: F.try_divide(F.sum(V.dec(c)), F.count(c)), DEC),
    "min": _best(F.min),
    "max": _best(F.max),
    "variance": _agg(_two(F.var_samp), DEC),
    "populationvariance": _agg(_two(F.var_pop), DEC),
    "stddev": _agg(_two(F.stddev_samp), DEC),
    "populationstddev": _agg(_two(F.stddev_pop), DEC),
    "geometricmean": _agg(lambda c, t: F.when(F.min(c) > 0, F.round(F.exp(F.avg(F.ln(F.when(c > 0, c.cast("double"))))), 8)), DEC),
    "median": _agg(lambda c, t: F.median(c.cast("double")), DEC),
    "mode": lambda low, rel, args, s: low.scalar(rel, s, F.mode(rel.value.col, True), rel.value.type) if not rel.value.type.span and (rel.value.type.number or rel.value.type == STR) else None,
    "alltrue": _agg(lambda c, t: F.bool_and(c), BOOL, True),
    "anytrue": _agg(lambda c, t: F.bool_or(c), BOOL, False),
    "first": _first(False),
    "last": _first(True),
    "distinct": lambda low, rel, args, s: low.distinct(rel),
    "take": _cut(lambda r, n: r <= n),
    "skip": _cut(lambda r, n: r > n),
    "tail": _cut(lambda r: r > 1),
}
#: Functions whose result for a null first argument isn't null.
NULL_SAFE = {"isnull", "istrue", "isfalse", "coalesce", "count", "exists", "alltrue", "anytrue", "date", "datetime", "time", "length", "combine", "tostring", *(f"convertsto{x.lower()}" for x in (*B._FROM, "String"))}
B_RESULT = {"toboolean": BOOL, "tointeger": INT, "tolong": LONG, "todecimal": DEC, "todate": DATE, "todatetime": DT, "totime": TIME, "toquantity": QTY, "abs": INT, "upper": STR, "lower": STR, "first": ANY, "matches": BOOL, "startswith": BOOL, "endswith": BOOL}


def _ages():
    def at(unit, calculate, dated):
        def run(self, args, s):
            vals = [self.val(a, s) for a in args]
            birth = vals.pop(0) if calculate else self.birth(s)
            if birth.type == STR:
                birth = B.to_date(birth)
            now = vals[0] if vals and dated else self.f_now([], s) if birth.type.name == "DateTime" else self.f_today([], s)
            return B.age(unit)(birth, now)

        return run

    for unit in ("year", "month", "week", "day"):
        word = unit + "s"
        for name, calculate, dated in ((f"f_agein{word}", False, False), (f"f_agein{word}at", False, True), (f"f_calculateagein{word}", True, True), (f"f_calculateagein{word}at", True, True)):
            setattr(Lowerer, name, at(unit, calculate, dated))


_ages()
