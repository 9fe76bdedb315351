"""Registered queries: one library for each operator family, over the star schema, with equivalent SQL.

A query's definition gives a scalar, or a tuple whose elements become the output columns.  Decimals are compared
as doubles rounded to six places.
"""

from __future__ import annotations

import datetime as dt
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .engine import Engine
from .sources.model import sales_model
from .sources.terminology import Terminology

NOW = dt.datetime(2002, 6, 15, 12, 0)
SEGMENTS = [("urn:segments", "urn:seg", "BUILDING", "Building"), ("urn:segments", "urn:seg", "MACHINERY", "Machinery"), ("urn:types", "urn:type", "purchase", "Purchase"), ("urn:types", "urn:type", "signup", "Signup"), ("urn:status", "urn:stat", "O", "Open"), ("urn:status", "urn:stat", "P", "Pending")]
ANCESTORS = [("urn:type", "purchase", "money"), ("urn:type", "error", "fault")]
HEAD = """library Families version '1.0'
using Sales version '1.0'
codesystem "Types": 'urn:type'
valueset "Conversions": 'urn:types'
valueset "Live": 'urn:status'
code "Purchase": 'purchase' from "Types"
code "Money": 'money' from "Types"
parameter "Period" Interval<DateTime> default Interval[@1996-01-01T00:00:00.000, @1997-01-01T00:00:00.000)
"""


@dataclass(frozen=True)
class Query:
    name: str
    context: str
    text: str
    columns: dict[str, str]
    sql: str | None
    subject: str | None = None


def _terms(spark: SparkSession) -> Terminology:
    return Terminology(spark.createDataFrame(SEGMENTS, "url string, system string, code string, display string"), spark.createDataFrame(ANCESTORS, "system string, code string, ancestor string"))


def engine(spark: SparkSession, folder: str) -> Engine:
    return Engine(spark, sales_model(spark, folder), _terms(spark), now=NOW, externals={"Shout": lambda c: F.concat(F.upper(c), F.lit("!"))}, libraries={"Common": COMMON})


COMMON = """library Common
define function "Net"(price Decimal, discount Decimal): price * (1.0 - discount)
define "Rate": 2
"""


def run(spark: SparkSession, folder: str, q: Query) -> DataFrame:
    """The query's definition `Q`, with its columns named and cast."""
    head = HEAD + ("include Common called Common\n" if "Common" in q.text else "")
    df = engine(spark, folder).evaluate(f"{head}context {q.context}\n{q.text}", "Q")
    tuple_ = df.schema["value"].dataType.typeName() == "struct"
    out = [F.col("subject").alias(q.subject)] if q.subject else []
    for name, kind in q.columns.items():
        c = F.col("value")[name] if tuple_ else F.col("value")
        out.append((F.round(c.cast("double"), 6) if kind == "double" else c.cast(kind)).alias(name))
    return df.select(*out)


U = "Unfiltered"


def _parts(name: str, expr: str, columns: dict[str, str], select: str) -> Query:
    """A tuple for every part; select: the same in SQL."""
    return Query(name, U, f'define Q: [Part] P return Tuple {{ k: P.p_partkey, {expr} }}', {"k": "bigint"} | columns, f"SELECT p_partkey AS k, {select} FROM part")


QUERIES = [
    Query("order_count_in_period", "Customer", 'define "Orders In Period": [Orders] O where O.o_orderdate during "Period"\ndefine Q: Count("Orders In Period")', {"order_count": "bigint"},
          "SELECT c_custkey, count(o_orderkey) AS order_count FROM customer LEFT JOIN orders ON o_custkey = c_custkey AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' GROUP BY c_custkey", "c_custkey"),
    Query("retrieve_filter", U, "define Q: [Orders] O where O.o_orderstatus = 'F' and O.o_totalprice > 1000.0 return Tuple { k: O.o_orderkey, price: O.o_totalprice }", {"k": "bigint", "price": "double"},
          "SELECT o_orderkey AS k, round(o_totalprice, 6) AS price FROM orders WHERE o_orderstatus = 'F' AND o_totalprice > 1000"),
    Query("retrieve_valueset", U, 'define Q: [Orders: o_orderstatus in "Live"] O return O.o_orderkey', {"k": "bigint"}, "SELECT o_orderkey AS k FROM orders WHERE o_orderstatus IN ('O', 'P')"),
    Query("retrieve_code", "User", 'define Q: Count([Event: event_type ~ "Purchase"])', {"n": "bigint"}, "SELECT user_id, count(*) FILTER (event_type = 'purchase') AS n FROM events GROUP BY user_id", "user_id"),
    Query("context_scope", "Customer", "define Q: Sum([Orders] O return O.o_totalprice)", {"total": "double"}, "SELECT c_custkey, round(sum(o_totalprice), 6) AS total FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey", "c_custkey"),
    Query("related_context", "Customer", "define Q: Count([Lineitem])", {"n": "bigint"}, "SELECT c_custkey, count(l_orderkey) AS n FROM customer LEFT JOIN orders ON o_custkey = c_custkey LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY c_custkey", "c_custkey"),
    Query("query_product", U, "define Q: from [Nation] N, [Region] R where N.n_regionkey = R.r_regionkey return Tuple { n: N.n_name, r: R.r_name }", {"n": "string", "r": "string"}, "SELECT n_name AS n, r_name AS r FROM nation JOIN region ON n_regionkey = r_regionkey"),
    Query("query_let", U, "define Q: [Lineitem] L let net: L.l_extendedprice * (1.0 - L.l_discount), gross: net * (1.0 + L.l_tax) where gross > 50000.0 return Tuple { k: L.l_orderkey, line: L.l_linenumber, gross: gross }", {"k": "bigint", "line": "bigint", "gross": "double"},
          "SELECT l_orderkey AS k, l_linenumber::BIGINT AS line, round(g, 6) AS gross FROM (SELECT *, ((l_extendedprice::DECIMAL(18,2) * (1 - l_discount::DECIMAL(18,2)))::DECIMAL(28,8) * (1 + l_tax::DECIMAL(18,2)))::DOUBLE AS g FROM lineitem) WHERE g > 50000"),
    Query("query_with", "Customer", "define Q: exists ([Orders] O with [Lineitem] L such that L.l_orderkey = O.o_orderkey and L.l_quantity > 49.0)", {"found": "boolean"},
          "SELECT c_custkey, EXISTS (SELECT 1 FROM orders JOIN lineitem ON l_orderkey = o_orderkey WHERE o_custkey = c_custkey AND l_quantity > 49) AS found FROM customer", "c_custkey"),
    Query("query_without", "Customer", "define Q: Count([Orders] O without [Lineitem] L such that L.l_orderkey = O.o_orderkey and L.l_returnflag = 'R')", {"n": "bigint"},
          "SELECT c_custkey, (SELECT count(*) FROM orders WHERE o_custkey = c_custkey AND NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')) AS n FROM customer", "c_custkey"),
    Query("query_exists_where", U, "define Q: [Customer] C where not exists ([Orders] O where O.o_custkey = C.c_custkey and O.o_orderstatus = 'P') return C.c_custkey", {"k": "bigint"},
          "SELECT c_custkey AS k FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')"),
    Query("query_where_null", U, "define Q: [Part] P let s: if P.p_size = 1 then null else P.p_size where s > 10 return P.p_partkey", {"k": "bigint"}, "SELECT p_partkey AS k FROM part WHERE NULLIF(p_size, 1) > 10"),
    Query("return_all", U, "define Q: [Part] P return all P.p_brand", {"brand": "string"}, "SELECT p_brand AS brand FROM part"),
    Query("return_distinct", U, "define Q: [Part] P return distinct Tuple { brand: P.p_brand, size: P.p_size }", {"brand": "string", "size": "bigint"}, "SELECT DISTINCT p_brand AS brand, p_size::BIGINT AS size FROM part"),
    Query("sort_nulls_asc", "Customer", "define Q: First([Orders] O return Tuple { s: if O.o_orderstatus = 'F' then null else O.o_totalprice, k: O.o_orderkey } sort by s, k).k", {"k": "bigint"},
          "SELECT c_custkey, (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_totalprice END ASC NULLS LAST, o_orderkey LIMIT 1) AS k FROM customer", "c_custkey"),
    Query("sort_nulls_desc", "Customer", "define Q: First([Orders] O return Tuple { s: if O.o_orderstatus = 'F' then null else O.o_totalprice, k: O.o_orderkey } sort by s desc, k).k", {"k": "bigint"},
          "SELECT c_custkey, (SELECT o_orderkey FROM orders WHERE o_custkey = c_custkey ORDER BY CASE WHEN o_orderstatus = 'F' THEN NULL ELSE o_totalprice END DESC NULLS FIRST, o_orderkey LIMIT 1) AS k FROM customer", "c_custkey"),
    Query("aggregate_fold", "Customer", "define Q: [Orders] O aggregate total starting 100: total + O.o_orderkey", {"total": "bigint"}, "SELECT c_custkey, (100 + coalesce(sum(o_orderkey), 0))::BIGINT AS total FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey", "c_custkey"),
    Query("aggregate_ordered", "Customer", "define Q: [Orders] O aggregate last starting 0: (last * 3 + O.o_orderkey) mod 1000003", {"h": "bigint"},
          "SELECT c_custkey, list_reduce(list_prepend(0::BIGINT, coalesce(list(o_orderkey ORDER BY o_orderkey) FILTER (o_orderkey IS NOT NULL), [])), lambda a, x: (a * 3 + x) % 1000003) AS h FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey", "c_custkey"),
    Query("aggregate_distinct", "User", "define Q: ([Event] E return Length(E.event_type)) L aggregate distinct n starting 0: n + L", {"n": "bigint"}, "SELECT user_id, sum(DISTINCT length(event_type))::BIGINT AS n FROM events GROUP BY user_id", "user_id"),
    Query("list_member_index", "Customer", "define Q: Tuple { second: ([Orders])[1].o_orderkey, has: 'P' in ([Orders] O return O.o_orderstatus) }", {"second": "bigint", "has": "boolean"},
          "SELECT c_custkey, (list(o_orderkey ORDER BY o_orderkey))[2] AS second, coalesce(bool_or(o_orderstatus = 'P'), false) AS has FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey", "c_custkey"),
    _parts("if_else", "v: if P.p_size > 25 then 'large' else 'small'", {"v": "string"}, "CASE WHEN p_size > 25 THEN 'large' ELSE 'small' END AS v"),
    _parts("case_searched", "v: case when P.p_size < 10 then 1 when P.p_size < 30 then 2 else null end", {"v": "bigint"}, "(CASE WHEN p_size < 10 THEN 1 WHEN p_size < 30 THEN 2 END)::BIGINT AS v"),
    _parts("case_selected", "v: case P.p_brand when 'Brand#11' then 'a' when 'Brand#22' then 'b' else 'z' end", {"v": "string"}, "CASE p_brand WHEN 'Brand#11' THEN 'a' WHEN 'Brand#22' THEN 'b' ELSE 'z' END AS v"),
    _parts("type_extent", "lo: minimum Integer, hi: maximum Integer + P.p_size * 0, big: maximum Long", {"lo": "bigint", "hi": "bigint", "big": "bigint"}, "(-2147483648)::BIGINT AS lo, 2147483647::BIGINT AS hi, 9223372036854775807::BIGINT AS big"),
    Query("logic_3vl", U, "define Q: [Part] P let t: if P.p_size > 40 then null else P.p_size > 20, q: P.p_retailprice > 1000.0 return Tuple { k: P.p_partkey, a: t and q, o: t or q, x: t xor q, i: t implies q, n: not t }", {"k": "bigint"} | dict.fromkeys("aoxin", "boolean"),
           "SELECT p_partkey AS k, (t AND q) AS a, (t OR q) AS o, (t <> q) AS x, (NOT t OR q) AS i, (NOT t) AS n FROM (SELECT *, CASE WHEN p_size > 40 THEN NULL ELSE p_size > 20 END AS t, p_retailprice > 1000 AS q FROM part)"),
    _parts("equality_null", "e: (if P.p_size = 1 then null else P.p_size) = 7, d: (if P.p_size = 1 then null else P.p_size) != 7, s: (if P.p_size = 1 then null else P.p_size) ~ 7, isn: (if P.p_size = 1 then null else P.p_size) is null", {"e": "boolean", "d": "boolean", "s": "boolean", "isn": "boolean"},
           "(NULLIF(p_size, 1) = 7) AS e, (NULLIF(p_size, 1) <> 7) AS d, (NULLIF(p_size, 1) IS NOT DISTINCT FROM 7) AS s, (p_size = 1) AS isn"),
    _parts("tuple_equal", "e: Tuple { a: P.p_size, b: P.p_brand } = Tuple { a: 7, b: 'Brand#11' }, n: Tuple { a: if P.p_size = 1 then null else P.p_size, b: 'x' } = Tuple { a: 7, b: 'x' }", {"e": "boolean", "n": "boolean"}, "(p_size = 7 AND p_brand = 'Brand#11') AS e, (NULLIF(p_size, 1) = 7) AS n"),
    _parts("equivalent_decimal", "v: (P.p_retailprice + 0.0) ~ 1000.0, w: 'ab' ~ 'AB'", {"v": "boolean", "w": "boolean"}, "(floor(abs(p_retailprice::DECIMAL(28,8)) + 0.5) = 1000) AS v, true AS w"),
    _parts("between", "v: P.p_size between 10 and 20, w: P.p_size properly between 10 and 20", {"v": "boolean", "w": "boolean"}, "(p_size BETWEEN 10 AND 20) AS v, (p_size > 10 AND p_size < 20) AS w"),
    _parts("null_tests", "a: IsNull(if P.p_size = 1 then null else P.p_size), b: IsTrue(null as Boolean), c: not (P.p_size > 3), d: (if P.p_size = 1 then null else P.p_size) is not null", dict.fromkeys("abcd", "boolean"), "(p_size = 1) AS a, false AS b, NOT (p_size > 3) AS c, (p_size <> 1) AS d"),
    _parts("unary_sign", "a: -P.p_size, b: +P.p_size, c: -(-P.p_size), d: Abs(-P.p_size)", dict.fromkeys("abcd", "bigint"), "-p_size::BIGINT AS a, p_size::BIGINT AS b, p_size::BIGINT AS c, p_size::BIGINT AS d"),
    _parts("list_equality", "a: {P.p_size, 1} = {7, 1}, b: {P.p_size, 1} ~ {7, 1}, c: {P.p_size} = {7, 1}, d: {Tuple { s: P.p_size }} = {Tuple { s: 7 }}", dict.fromkeys("abcd", "boolean"), "(p_size = 7) AS a, (p_size = 7) AS b, false AS c, (p_size = 7) AS d"),
    _parts("list_equivalence_null", "a: {if P.p_size = 1 then null else P.p_size} ~ {null as Integer}, b: Tuple { s: if P.p_size = 1 then null else P.p_size } ~ Tuple { s: null as Integer }", dict.fromkeys("ab", "boolean"), "(p_size = 1) AS a, (p_size = 1) AS b"),
    _parts("code_selectors", "a: Code { code: P.p_brand, system: 's' } = Code { code: 'Brand#11', system: 's' }, b: Code { code: P.p_brand, system: 's', display: 'x' } ~ Code { code: 'Brand#11', system: 's' }, c: Concept { codes: { Code { code: P.p_brand, system: 's' } } } ~ Concept { codes: { Code { code: 'Brand#11', system: 's' } } }", dict.fromkeys("abc", "boolean"), "(p_brand = 'Brand#11') AS a, (p_brand = 'Brand#11') AS b, (p_brand = 'Brand#11') AS c"),
    _parts("quantity_scaling", "a: (Quantity { value: ToDecimal(P.p_size), unit: 'kg' } * 2.0).value, b: (Quantity { value: ToDecimal(P.p_size), unit: 'kg' } / 2.0).value, c: (Quantity { value: ToDecimal(P.p_size), unit: 'kg' } - Quantity { value: 1.0, unit: 'kg' }).value", dict.fromkeys("abc", "double"), "(p_size * 2)::DOUBLE AS a, (p_size / 2)::DOUBLE AS b, (p_size - 1)::DOUBLE AS c"),
    _parts("converts_to", "a: ConvertsToInteger(P.p_brand), b: ConvertsToInteger(ToString(P.p_size)), c: ConvertsToBoolean('yes'), d: ConvertsToDate('2020-13-01')", dict.fromkeys("abcd", "boolean"), "false AS a, true AS b, true AS c, false AS d"),
    _parts("decimal_boundaries", "a: LowBoundary(1.587, 6), b: HighBoundary(1.587, 6)", dict.fromkeys("ab", "double"), "1.587::DOUBLE AS a, 1.587999::DOUBLE AS b"),
    _parts("coalesce", "v: Coalesce(if P.p_size = 1 then null else P.p_size, -1), t: IsTrue(P.p_size > 3), f: IsFalse(P.p_size > 3)", {"v": "bigint", "t": "boolean", "f": "boolean"}, "coalesce(NULLIF(p_size, 1), -1)::BIGINT AS v, (p_size > 3) AS t, NOT (p_size > 3) AS f"),
    _parts("arith_div_zero", "q: P.p_size / (P.p_size - 7), d: P.p_size div (P.p_size - 7), m: P.p_size mod (P.p_size - 7)", {"q": "double", "d": "bigint", "m": "bigint"}, "round(p_size::DOUBLE / NULLIF(p_size - 7, 0), 6) AS q, trunc(p_size / NULLIF(p_size - 7, 0))::BIGINT AS d, (p_size % NULLIF(p_size - 7, 0))::BIGINT AS m"),
    _parts("arith_div_mod", "d: (P.p_size - 25) div 4, m: (P.p_size - 25) mod 4, p: P.p_size ^ 2, q: P.p_size ^ (-1), n: -P.p_size", {"d": "bigint", "m": "bigint", "p": "bigint", "q": "double", "n": "bigint"}, "trunc((p_size - 25) / 4.0)::BIGINT AS d, ((p_size - 25) % 4)::BIGINT AS m, (p_size * p_size)::BIGINT AS p, round(round(1.0 / p_size, 8), 6) AS q, (-p_size)::BIGINT AS n"),
    _parts("round_half_away", "a: Round(P.p_size / 2.0), b: Round(-P.p_size / 2.0), c: Round(P.p_retailprice, 1)", {"a": "double", "b": "double", "c": "double"}, "round(p_size / 2.0)::DOUBLE AS a, round(-p_size / 2.0)::DOUBLE AS b, round(p_retailprice::DECIMAL(28,8), 1)::DOUBLE AS c"),
    _parts("log_exp_power", "a: Ln(P.p_size), b: Log(P.p_size, 2), c: Exp(P.p_size / 10.0), d: Power(P.p_size, 3), f: Power(2, -P.p_size div 10), e: Abs(P.p_size - 30)", {"a": "double", "b": "double", "c": "double", "d": "bigint", "f": "double", "e": "bigint"}, "round(round(ln(p_size), 8), 6) AS a, round(round(ln(p_size) / ln(2), 8), 6) AS b, round(round(exp(p_size / 10.0), 8), 6) AS c, (p_size ** 3)::BIGINT AS d, round(round(2.0 ** (-(p_size // 10)), 8), 6) AS f, abs(p_size - 30)::BIGINT AS e"),
    _parts("floor_ceil_trunc", "a: Floor(P.p_retailprice - 1000.0), b: Ceiling(P.p_retailprice - 1000.0), c: Truncate(P.p_retailprice - 1000.0)", {"a": "bigint", "b": "bigint", "c": "bigint"}, "floor(p_retailprice::DECIMAL(18,4) - 1000)::BIGINT AS a, ceil(p_retailprice::DECIMAL(18,4) - 1000)::BIGINT AS b, trunc(p_retailprice::DECIMAL(18,4) - 1000)::BIGINT AS c"),
    _parts("successor", "a: successor of P.p_size, b: predecessor of P.p_size, c: successor of (P.p_size + 0.5)", {"a": "bigint", "b": "bigint", "c": "double"}, "(p_size + 1)::BIGINT AS a, (p_size - 1)::BIGINT AS b, round((p_size + 0.50000001)::DOUBLE, 6) AS c"),
    _parts("string_combine", "a: Combine({ P.p_brand, null, P.p_type }, '-'), b: P.p_brand + P.p_type, c: P.p_brand & null, d: Concatenate(P.p_brand, '/', P.p_type)", dict.fromkeys("abcd", "string"), "p_brand || '-' || p_type AS a, p_brand || p_type AS b, p_brand AS c, p_brand || '/' || p_type AS d"),
    _parts("string_split", "n: Count(Split(P.p_name, ' ')), f: First(Split(P.p_name, ' ')), m: Count(SplitOnMatches(P.p_name, '[aeiou]'))", {"n": "bigint", "f": "string", "m": "bigint"}, "len(string_split(p_name, ' '))::BIGINT AS n, string_split(p_name, ' ')[1] AS f, len(regexp_split_to_array(p_name, '[aeiou]'))::BIGINT AS m"),
    _parts("string_position", "a: PositionOf('a', P.p_name), b: IndexOf(P.p_name, 'e'), c: LastPositionOf('a', P.p_name), l: Length(P.p_name)", dict.fromkeys("abcl", "bigint"), "(instr(p_name, 'a') - 1)::BIGINT AS a, (instr(p_name, 'e') - 1)::BIGINT AS b, (CASE WHEN instr(p_name, 'a') = 0 THEN -1 ELSE length(p_name) - instr(reverse(p_name), 'a') END)::BIGINT AS c, length(p_name)::BIGINT AS l"),
    _parts("string_regex", "a: Matches(P.p_brand, 'Brand#1.*'), b: ReplaceMatches(P.p_brand, '[0-9]', 'x'), c: StartsWith(P.p_brand, 'Brand#2'), d: EndsWith(P.p_brand, '3')", {"a": "boolean", "b": "string", "c": "boolean", "d": "boolean"}, "regexp_full_match(p_brand, 'Brand#1.*') AS a, regexp_replace(p_brand, '[0-9]', 'x', 'g') AS b, starts_with(p_brand, 'Brand#2') AS c, suffix(p_brand, '3') AS d"),
    _parts("string_substring", "a: Substring(P.p_name, 2, 3), b: Substring(P.p_name, 500), c: Upper(P.p_name), d: Lower(P.p_name), e: P.p_name[0]", dict.fromkeys("abcde", "string"), "substr(p_name, 3, 3) AS a, NULL::VARCHAR AS b, upper(p_name) AS c, lower(p_name) AS d, substr(p_name, 1, 1) AS e"),
    Query("date_components", U, "define Q: [Orders] O return Tuple { k: O.o_orderkey, y: year from O.o_orderdate, m: month from O.o_orderdate, d: day from O.o_orderdate, h: hour from O.o_orderdate }", dict.fromkeys("kymdh", "bigint"), "SELECT o_orderkey AS k, year(o_orderdate) AS y, month(o_orderdate) AS m, day(o_orderdate) AS d, hour(o_orderdate) AS h FROM orders"),
    Query("date_add_clamp", U, "define Q: [Orders] O return Tuple { k: O.o_orderkey, a: ToString(O.o_orderdate + 1 month), b: ToString(O.o_orderdate - 10 days), c: ToString(O.o_orderdate + 1 year) }", {"k": "bigint", "a": "string", "b": "string", "c": "string"},
          "SELECT o_orderkey AS k, strftime(o_orderdate + INTERVAL 1 MONTH, '%Y-%m-%dT%H:%M:%S.%g') AS a, strftime(o_orderdate - INTERVAL 10 DAY, '%Y-%m-%dT%H:%M:%S.%g') AS b, strftime(o_orderdate + INTERVAL 1 YEAR, '%Y-%m-%dT%H:%M:%S.%g') AS c FROM orders"),
    Query("duration_between", U, "define Q: [Orders] O return Tuple { k: O.o_orderkey, y: years between O.o_orderdate and Now(), m: months between O.o_orderdate and Now(), w: weeks between O.o_orderdate and Now(), d: days between O.o_orderdate and Now(), h: hours between O.o_orderdate and Now() }", dict.fromkeys("kymwdh", "bigint"),
          "SELECT o_orderkey AS k, m // 12 AS y, m, s // 604800 AS w, s // 86400 AS d, s // 3600 AS h FROM (SELECT o_orderkey, ((2002 - year(o_orderdate)) * 12 + 6 - month(o_orderdate) - CASE WHEN day(o_orderdate) > 15 THEN 1 ELSE 0 END)::BIGINT AS m, (epoch(TIMESTAMP '2002-06-15 12:00:00') - epoch(o_orderdate))::BIGINT AS s FROM orders)"),
    Query("difference_between", U, "define Q: [Orders] O return Tuple { k: O.o_orderkey, y: difference in years between O.o_orderdate and Now(), m: difference in months between O.o_orderdate and Now(), d: difference in days between O.o_orderdate and Now() }", dict.fromkeys("kymd", "bigint"),
          "SELECT o_orderkey AS k, date_diff('year', o_orderdate, TIMESTAMP '2002-06-15') AS y, date_diff('month', o_orderdate, TIMESTAMP '2002-06-15') AS m, date_diff('day', o_orderdate, TIMESTAMP '2002-06-15') AS d FROM orders"),
    Query("age_at", U, "define Q: [Orders] O return Tuple { k: O.o_orderkey, a: CalculateAgeInYearsAt(O.o_orderdate, @2002-06-15T00:00:00.000), d: CalculateAgeInDaysAt(O.o_orderdate, @2002-06-15T00:00:00.000) }", dict.fromkeys("kad", "bigint"),
          "SELECT o_orderkey AS k, date_sub('year', o_orderdate, TIMESTAMP '2002-06-15') AS a, date_sub('day', o_orderdate, TIMESTAMP '2002-06-15') AS d FROM orders"),
    _parts("interval_contains", "a: P.p_size in Interval[10, 20), b: Interval(10, 20] contains P.p_size, c: Interval[P.p_size, P.p_size + 5] includes Interval[12, 14], w: width of Interval[P.p_size, 60], s: start of Interval(P.p_size, 100), e: end of Interval[P.p_size, 100)", {"a": "boolean", "b": "boolean", "c": "boolean", "w": "bigint", "s": "bigint", "e": "bigint"},
           "(p_size >= 10 AND p_size < 20) AS a, (p_size > 10 AND p_size <= 20) AS b, (p_size <= 12 AND p_size + 5 >= 14) AS c, (60 - p_size)::BIGINT AS w, (p_size + 1)::BIGINT AS s, 99::BIGINT AS e"),
    _parts("interval_meets", "a: Interval[1, P.p_size] meets Interval[11, 60], b: Interval[1, P.p_size] overlaps Interval[11, 60], c: Interval[1, P.p_size] before Interval[11, 60], d: Interval[P.p_size, 70] after Interval[1, 9], e: Interval[1, P.p_size] starts Interval[1, 20], f: Interval[P.p_size, 70] ends Interval[5, 70], g: Interval[1, P.p_size] overlaps before Interval[11, 60]", dict.fromkeys("abcdefg", "boolean"),
           "(p_size = 10) AS a, (p_size >= 11) AS b, (p_size < 11) AS c, (p_size > 9) AS d, (p_size <= 20) AS e, (p_size >= 5) AS f, (p_size >= 11) AS g"),
    _parts("interval_set", "u: width of (Interval[1, P.p_size] union Interval[11, 60]), i: width of (Interval[1, P.p_size] intersect Interval[11, 60]), x: width of (Interval[0, P.p_size] except Interval[11, 60])", dict.fromkeys("uix", "bigint"),
           "(CASE WHEN p_size >= 10 THEN greatest(p_size, 60) - 1 END)::BIGINT AS u, (CASE WHEN p_size >= 11 THEN least(p_size, 60) - 11 END)::BIGINT AS i, (CASE WHEN p_size < 11 THEN p_size WHEN p_size <= 60 THEN 10 END)::BIGINT AS x"),
    Query("interval_overlaps_join", "Customer", "define Q: Count([Orders] A with [Orders] B such that B.o_orderkey != A.o_orderkey and Interval[A.o_orderdate, A.o_orderdate + 30 days] overlaps Interval[B.o_orderdate, B.o_orderdate + 30 days])", {"n": "bigint"},
          "SELECT c_custkey, (SELECT count(*) FROM orders a WHERE a.o_custkey = c_custkey AND EXISTS (SELECT 1 FROM orders b WHERE b.o_custkey = c_custkey AND b.o_orderkey <> a.o_orderkey AND a.o_orderdate <= b.o_orderdate + INTERVAL 30 DAY AND b.o_orderdate <= a.o_orderdate + INTERVAL 30 DAY)) AS n FROM customer", "c_custkey"),
    Query("timing_same_as", U, "define Q: [Orders] O return Tuple { k: O.o_orderkey, a: O.o_orderdate same month as @1996-03-05T00:00:00.000, b: O.o_orderdate same or before @1996-03-05T00:00:00.000, c: O.o_orderdate 30 days or more before @1996-03-05T00:00:00.000, d: O.o_orderdate within 10 days of @1996-03-05T00:00:00.000, e: O.o_orderdate after year of @1996-03-05T00:00:00.000 }", {"k": "bigint"} | dict.fromkeys("abcde", "boolean"),
          "SELECT o_orderkey AS k, (date_trunc('month', o_orderdate) = DATE '1996-03-01') AS a, (o_orderdate <= TIMESTAMP '1996-03-05') AS b, (o_orderdate <= TIMESTAMP '1996-03-05' - INTERVAL 30 DAY) AS c, (o_orderdate BETWEEN TIMESTAMP '1996-03-05' - INTERVAL 10 DAY AND TIMESTAMP '1996-03-05' + INTERVAL 10 DAY) AS d, (year(o_orderdate) > 1996) AS e FROM orders"),
    Query("interval_collapse", "Customer", "define Q: Count(collapse ([Orders] O return Interval[O.o_orderdate, O.o_orderdate + 60 days]))", {"n": "bigint"},
          "SELECT c_custkey, coalesce(n, 0)::BIGINT AS n FROM customer LEFT JOIN (SELECT o_custkey, sum(CASE WHEN prev IS NULL OR o_orderdate > prev + INTERVAL 1 MILLISECOND THEN 1 ELSE 0 END) AS n FROM (SELECT o_custkey, o_orderdate, max(o_orderdate + INTERVAL 60 DAY) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS prev FROM orders) GROUP BY o_custkey) ON o_custkey = c_custkey", "c_custkey"),
    _parts("interval_expand", "n: Count(expand Interval[1, P.p_size]), s: Sum(expand Interval[1, P.p_size] per 2), u: Count(expand { Interval[1, P.p_size] })", dict.fromkeys("nsu", "bigint"), "p_size::BIGINT AS n, (((p_size + 1) // 2) * ((p_size + 1) // 2))::BIGINT AS s, p_size::BIGINT AS u"),
    _parts("list_union_dups", "a: Count({ 1, 1, P.p_size } union { P.p_size, 99, 99 }), b: Count({ 1, 1, P.p_size } except { P.p_size }), c: Count({ 1, 1, P.p_size } intersect { 1, P.p_size, 7 })", dict.fromkeys("abc", "bigint"), "4::BIGINT AS a, (CASE WHEN p_size = 1 THEN 0 ELSE 2 END)::BIGINT AS b, (CASE WHEN p_size = 1 THEN 1 ELSE 2 END)::BIGINT AS c"),
    Query("list_take_skip", "Customer", "define Q: Tuple { t: Sum(Take([Orders] O return O.o_orderkey, 3)), s: Count(Skip([Orders], 3)), f: First([Orders]).o_orderkey, l: Last([Orders]).o_orderkey }", dict.fromkeys("tsfl", "bigint"),
          "SELECT c_custkey, list_sum(l[1:3])::BIGINT AS t, greatest(len(l) - 3, 0)::BIGINT AS s, l[1] AS f, l[-1] AS l FROM (SELECT c_custkey, coalesce(list(o_orderkey ORDER BY o_orderkey) FILTER (o_orderkey IS NOT NULL), []) AS l FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey)", "c_custkey"),
    _parts("list_flatten", "n: Count(flatten { { P.p_size, 1 }, { 2 } }), d: Count(distinct { P.p_size, 1, 2, 1 }), t: Last(Tail({ 5, P.p_size })), s: Count(Slice({ 1, 2, 3, 4, P.p_size }, 1, -1)), g: singleton from { P.p_size }", dict.fromkeys("ndtsg", "bigint"), "3::BIGINT AS n, (CASE WHEN p_size IN (1, 2) THEN 2 ELSE 3 END)::BIGINT AS d, p_size::BIGINT AS t, 3::BIGINT AS s, p_size::BIGINT AS g"),
    Query("list_membership", "User", "define Q: Tuple { a: 'purchase' in ([Event] E return distinct E.event_type), n: Count([Event] E return distinct E.event_type), i: ([Event] E return distinct E.event_type) includes { 'view', 'click' } }", {"a": "boolean", "n": "bigint", "i": "boolean"},
          "SELECT user_id, bool_or(event_type = 'purchase') AS a, count(DISTINCT event_type) AS n, (bool_or(event_type = 'view') AND bool_or(event_type = 'click')) AS i FROM events GROUP BY user_id", "user_id"),
    Query("agg_basic", "Order", "define Q: Tuple { n: Count([Lineitem]), s: Sum([Lineitem] L return L.l_quantity), a: Avg([Lineitem] L return L.l_quantity), lo: Min([Lineitem] L return L.l_extendedprice), hi: Max([Lineitem] L return L.l_extendedprice), d: Max([Lineitem] L return L.l_linenumber) }", {"n": "bigint", "s": "double", "a": "double", "lo": "double", "hi": "double", "d": "bigint"},
          "SELECT o_orderkey, count(l_orderkey) AS n, round(sum(l_quantity), 6) AS s, round(avg(l_quantity), 6) AS a, round(min(l_extendedprice), 6) AS lo, round(max(l_extendedprice), 6) AS hi, max(l_linenumber)::BIGINT AS d FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey", "o_orderkey"),
    Query("agg_median_mode", "Order", "define Q: Tuple { m: Median([Lineitem] L return L.l_quantity), o: Mode([Lineitem] L return L.l_returnflag) }", {"m": "double", "o": "string"},
          "SELECT o_orderkey, round(median(l_quantity), 6) AS m, (SELECT l_returnflag FROM lineitem WHERE l_orderkey = o_orderkey GROUP BY l_returnflag ORDER BY count(*) DESC, l_returnflag LIMIT 1) AS o FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey", "o_orderkey"),
    Query("agg_variance", "Order", "define Q: Tuple { v: Round(Variance([Lineitem] L return L.l_quantity), 4), s: Round(StdDev([Lineitem] L return L.l_quantity), 4), p: Round(PopulationVariance([Lineitem] L return L.l_quantity), 4), q: Round(PopulationStdDev([Lineitem] L return L.l_quantity), 4) }", dict.fromkeys("vspq", "double"),
          "SELECT o_orderkey, round(round(var_samp(l_quantity), 8), 4) AS v, round(round(stddev_samp(l_quantity), 8), 4) AS s, CASE WHEN count(l_quantity) >= 2 THEN round(round(var_pop(l_quantity), 8), 4) END AS p, CASE WHEN count(l_quantity) >= 2 THEN round(round(stddev_pop(l_quantity), 8), 4) END AS q FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey", "o_orderkey"),
    Query("agg_geomean", "Order", "define Q: Tuple { g: Round(GeometricMean([Lineitem] L return L.l_quantity), 4), p: Product({ 1, 2, 3 }) }", {"g": "double", "p": "bigint"}, "SELECT o_orderkey, round(round(exp(avg(ln(l_quantity))), 8), 4) AS g, 6::BIGINT AS p FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey", "o_orderkey"),
    Query("agg_all_any_true", "Order", "define Q: Tuple { a: AllTrue([Lineitem] L return L.l_quantity > 5.0), o: AnyTrue([Lineitem] L return L.l_quantity > 45.0) }", {"a": "boolean", "o": "boolean"},
          "SELECT o_orderkey, coalesce(bool_and(l_quantity > 5), true) AS a, coalesce(bool_or(l_quantity > 45), false) AS o FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey", "o_orderkey"),
    Query("quantity_sum", "Order", "define Q: Tuple { kg: Sum(([Lineitem] L return Quantity { value: L.l_quantity, unit: 'kg' })).value, g: (Sum(([Lineitem] L return Quantity { value: L.l_quantity, unit: 'kg' })) + 500 'g').value }", {"kg": "double", "g": "double"},
          "SELECT o_orderkey, round(sum(l_quantity), 6) AS kg, round(sum(l_quantity) + 0.5, 6) AS g FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey", "o_orderkey"),
    _parts("convert_predicates", "a: ConvertsToInteger(P.p_brand), b: ConvertsToDecimal(Substring(P.p_brand, 6)), c: ToInteger(Substring(P.p_brand, 6)), d: ToString(P.p_size), e: ToBoolean('yes'), f: convert P.p_size to String", {"a": "boolean", "b": "boolean", "c": "bigint", "d": "string", "e": "boolean", "f": "string"},
           "false AS a, true AS b, substr(p_brand, 7)::BIGINT AS c, p_size::VARCHAR AS d, true AS e, p_size::VARCHAR AS f"),
    _parts("convert_failures_null", "a: ToInteger(P.p_name), b: ToDecimal(P.p_brand), c: ToBoolean(P.p_type), i: P.p_size is Integer, s: P.p_size is String", {"a": "bigint", "b": "double", "c": "boolean", "i": "boolean", "s": "boolean"}, "NULL::BIGINT AS a, NULL::DOUBLE AS b, NULL::BOOLEAN AS c, true AS i, false AS s"),
    Query("code_in_valueset", "User", 'define Q: Count([Event] E where E.event_type in "Conversions")', {"n": "bigint"}, "SELECT user_id, count(*) FILTER (event_type IN ('purchase', 'signup')) AS n FROM events GROUP BY user_id", "user_id"),
    Query("expand_valueset", U, 'define Q: ExpandValueSet("Conversions") C return Tuple { code: C.code, system: C.system }', {"code": "string", "system": "string"}, "SELECT * FROM (VALUES ('purchase', 'urn:type'), ('signup', 'urn:type')) t(code, system)"),
    Query("subsumes", U, 'define Q: Tuple { a: Subsumes("Money", "Purchase"), b: SubsumedBy("Purchase", "Money"), c: Subsumes("Purchase", "Money"), d: "Purchase" in "Conversions" }', dict.fromkeys("abcd", "boolean"), "SELECT true AS a, true AS b, false AS c, true AS d"),
    Query("message_passthrough", U, "define Q: [Part] P return Tuple { k: P.p_partkey, v: Message(P.p_size, P.p_size > 10, '100', 'Warning', 'large') }", {"k": "bigint", "v": "bigint"}, "SELECT p_partkey AS k, p_size::BIGINT AS v FROM part"),
    Query("user_function", U, 'define function twice(x Integer): x * 2\ndefine fluent function plus(x Integer, y Integer): x + y\ndefine Q: [Part] P return Tuple { k: P.p_partkey, a: twice(P.p_size), b: P.p_size.plus(5) }', {"k": "bigint", "a": "bigint", "b": "bigint"}, "SELECT p_partkey AS k, (p_size * 2)::BIGINT AS a, (p_size + 5)::BIGINT AS b FROM part"),
    Query("library_include", U, "define Q: [Lineitem] L return Tuple { k: L.l_orderkey, l: L.l_linenumber, net: Common.Net(L.l_extendedprice, L.l_discount) * Common.Rate }", {"k": "bigint", "l": "bigint", "net": "double"}, "SELECT l_orderkey AS k, l_linenumber::BIGINT AS l, round((l_extendedprice::DECIMAL(18,2) * (1 - l_discount::DECIMAL(18,2)) * 2)::DOUBLE, 6) AS net FROM lineitem"),
    Query("udf_external", U, "define function Shout(x String) returns String: external\ndefine Q: [Part] P return Tuple { k: P.p_partkey, v: Shout(P.p_brand) }", {"k": "bigint", "v": "string"}, "SELECT p_partkey AS k, upper(p_brand) || '!' AS v FROM part"),
    Query("fluent_where_select", "User", "define Q: Count((([Event] E return E.event_type).where($this = 'click')).select(Length($this)))", {"n": "bigint"}, "SELECT user_id, count(*) FILTER (event_type = 'click') AS n FROM events GROUP BY user_id", "user_id"),
    Query("json_children", U, "define Q: [Nation] N return Tuple { k: N.n_nationkey, n: Count(Children(N)) }", {"k": "bigint", "n": "bigint"}, "SELECT n_nationkey::BIGINT AS k, 3::BIGINT AS n FROM nation"),
    Query("partial_precision_compare", U, "define Q: [Orders] O return Tuple { k: O.o_orderkey, a: O.o_orderdate before @1997, b: O.o_orderdate = @1996-05, c: O.o_orderdate after @1996-05, d: year from @1996-05 }", {"k": "bigint", "a": "boolean", "b": "boolean", "c": "boolean", "d": "bigint"},
          "SELECT o_orderkey AS k, CASE WHEN year(o_orderdate) <> 1997 THEN year(o_orderdate) < 1997 END AS a, CASE WHEN date_trunc('month', o_orderdate) <> DATE '1996-05-01' THEN false END AS b, CASE WHEN date_trunc('month', o_orderdate) <> DATE '1996-05-01' THEN date_trunc('month', o_orderdate) > DATE '1996-05-01' END AS c, 1996::BIGINT AS d FROM orders"),
    Query("uncertain_duration", U, "define Q: [Orders] O return Tuple { k: O.o_orderkey, lo: (years between O.o_orderdate and @2000) > 2, hi: (years between O.o_orderdate and @2000) > 10 }", {"k": "bigint", "lo": "boolean", "hi": "boolean"}, "SELECT o_orderkey AS k, CASE WHEN a > 2 THEN true WHEN b <= 2 THEN false END AS lo, CASE WHEN a > 10 THEN true WHEN b <= 10 THEN false END AS hi FROM (SELECT o_orderkey, datesub('year', o_orderdate, TIMESTAMP '2000-01-01') AS a, datesub('year', o_orderdate, TIMESTAMP '2000-12-31 23:59:59.999') AS b FROM orders)"),
]


def queries() -> dict:
    return {q.name: (lambda spark, folder, q=q: run(spark, folder, q)) for q in QUERIES}


def oracle_sql() -> dict[str, str]:
    return {q.name: q.sql for q in QUERIES if q.sql}
