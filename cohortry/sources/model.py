"""What can be retrieved: types bound to tables, with their keys, code paths and relations to the subject."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as S

from ..plans import types as P


@dataclass
class Entity:
    """A retrievable type.

    subject: for each context, the column that holds its key; via: (type, own column, its column) where the key
    is that of a related type; order: columns that give a list its order.
    """

    name: str
    load: Callable[[], DataFrame]
    key: str
    code: str | None = None
    subject: dict[str, str] = field(default_factory=dict)
    via: dict[str, tuple[str, str, str]] = field(default_factory=dict)
    order: tuple[str, ...] = ()
    birth: str | None = None


def type_of(t: S.DataType) -> P.Type:
    """The language's type of a Spark type; a struct of low and high is an interval."""
    if isinstance(t, S.StructType):
        names = {f.name for f in t.fields}
        if names == {"low", "high", "lowClosed", "highClosed"}:
            return P.interval_of(type_of(t["low"].dataType))
        if names == {"value", "unit"}:
            return P.QTY
        if names == {"lo", "hi", "prec", "off"}:
            return P.span_of(P.DT)
        if names == {"code", "display", "system", "version"}:
            return P.CODE
        if names == {"codes", "display"}:
            return P.CONCEPT
        return P.tuple_of((f.name, type_of(f.dataType)) for f in t.fields)
    if isinstance(t, S.ArrayType):
        return P.list_of(type_of(t.elementType))
    if isinstance(t, S.DecimalType):
        return P.DEC
    return {S.BooleanType: P.BOOL, S.ByteType: P.INT, S.ShortType: P.INT, S.IntegerType: P.INT, S.LongType: P.INT, S.FloatType: P.REAL, S.DoubleType: P.REAL, S.StringType: P.STR, S.DateType: P.DATE, S.TimestampNTZType: P.DT, S.TimestampType: P.DT}.get(type(t), P.ANY)


class Model:
    """A registry of entities and contexts."""

    def __init__(self, name: str = "Tables"):
        self.name, self.entities, self.aliases = name, {}, {}

    def add(self, entity: Entity, *aliases: str) -> Model:
        self.entities[entity.name] = entity
        for a in (entity.name, *aliases):
            self.aliases[a.lower()] = entity.name
        return self

    def find(self, name: str) -> Entity | None:
        return self.entities.get(self.aliases.get(name.split(".")[-1].lower(), ""))


def sales_model(spark: SparkSession, folder: str) -> Model:
    """The star schema: customers, suppliers and users as subjects; orders, line items and events as records."""
    read = lambda name: lambda: spark.read.parquet(f"{folder}/{name}.parquet")
    m = Model("Sales")
    m.add(Entity("Region", read("region"), "r_regionkey", order=("r_regionkey",)))
    m.add(Entity("Nation", read("nation"), "n_nationkey", order=("n_nationkey",)))
    m.add(Entity("Customer", read("customer"), "c_custkey", code="c_mktsegment", subject={"Customer": "c_custkey"}, order=("c_custkey",)), "Customers")
    m.add(Entity("Supplier", read("supplier"), "s_suppkey", subject={"Supplier": "s_suppkey"}, order=("s_suppkey",)), "Suppliers")
    m.add(Entity("Part", read("part"), "p_partkey", code="p_brand", subject={"Part": "p_partkey"}, order=("p_partkey",)), "Parts")
    m.add(Entity("Order", read("orders"), "o_orderkey", code="o_orderstatus", subject={"Customer": "o_custkey", "Order": "o_orderkey"}, order=("o_orderkey",)), "Orders")
    m.add(Entity("Lineitem", read("lineitem"), "l_orderkey", code="l_returnflag", subject={"Supplier": "l_suppkey", "Order": "l_orderkey", "Part": "l_partkey"}, via={"Customer": ("Order", "l_orderkey", "o_orderkey")}, order=("l_orderkey", "l_linenumber")), "Lineitems")
    m.add(Entity("Event", read("events"), "event_id", code="event_type", subject={"User": "user_id"}, order=("event_id",)), "Events")
    m.add(Entity("User", lambda: read("events")().select("user_id").distinct(), "user_id", subject={"User": "user_id"}, order=("user_id",)), "Users")
    m.add(Entity("Document", read("documents"), "doc_id", code="lang", subject={"Document": "doc_id"}, order=("doc_id",)), "Documents")
    return m
