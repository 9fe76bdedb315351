"""Value sets and code hierarchies as DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import TooCostlyFault

#: Codes that are compared one by one, that stand in plans, and that are sent to all executors, at most; retrieves with a larger
#: set join it by shuffle.
FEW, INLINE, BROADCAST = 200, 100_000, 1_000_000


class Terminology:
    """valuesets: url, system, code, display; ancestors: system, code, ancestor (the closure, without the code itself)."""

    def __init__(self, valuesets: DataFrame, ancestors: DataFrame | None = None):
        self.valuesets, self.ancestors = valuesets, ancestors
        self.small = valuesets.limit(BROADCAST + 1).count() <= BROADCAST
        self._tests: dict = {}

    def expand(self, url: str) -> DataFrame:
        """One column code: the members of a value set."""
        code = F.struct("code", F.col("display").cast("string").alias("display"), "system", F.lit(None).cast("string").alias("version"))
        return self.valuesets.where(F.col("url") == url).select(code.alias("code"))

    def _members(self, url: str) -> DataFrame:
        return self.valuesets.where((F.col("url") == url) & F.col("code").isNotNull()).select(F.col("system").cast("string").alias("system"), F.col("code").cast("string").alias("code")).distinct()

    def _test(self, name: str, table: DataFrame, *columns: str):
        """Whether structs of these columns are rows of the table.  A few rows are compared as literals; up to INLINE
        stand in the plan as buckets of their JSON texts, so that a test reads a few of them whatever their number."""
        if name not in self._tests:
            key = lambda m: F.to_json(m)
            table = table.select(F.struct(*columns).alias("m"))
            rows = table.select("m", key(F.col("m")).alias("k"), F.xxhash64(key(F.col("m"))).alias("h")).limit(INLINE + 1).collect()
            if len(rows) > INLINE:
                raise TooCostlyFault(f"{name} has more than {INLINE} members for a test inside an expression; retrieve with it, so that it is joined")
            if len(rows) <= FEW:
                known = [F.struct(*(F.lit(v).cast("string").alias(c) for v, c in zip(r["m"], columns))) for r in rows]
                self._tests[name] = lambda m: m.isin(known) if known else F.lit(False)
            else:
                buckets = [[] for _ in range(len(rows) // 4 + 1)]
                for r in rows:
                    buckets[r["h"] % len(buckets)].append(r["k"])
                # JSON escapes control characters, so these can part its texts
                held = F.split(F.lit("\x1e".join("\x1f".join(b) for b in buckets)), "\x1e")
                self._tests[name] = lambda m: F.array_contains(F.split(F.get(held, F.pmod(F.xxhash64(key(m)), F.lit(len(buckets))).cast("int")), "\x1f"), key(m))
        return self._tests[name]

    def test(self, url: str):
        """Whether a code column is a member."""
        member = self._test(url, self._members(url), "system", "code")
        return lambda c: member(F.struct(c["system"].cast("string").alias("system"), c["code"].cast("string").alias("code")))

    def test_text(self, url: str):
        member = self._test(f"{url} as text", self._members(url).select("code").distinct(), "code")
        return lambda c: member(F.struct(c.cast("string").alias("code")))

    def subsumes(self):
        """Whether one code is an ancestor of another."""
        if self.ancestors is None:
            return lambda a, b: F.lit(False)
        columns = ("system", "ancestor", "code")
        member = self._test("the hierarchy", self.ancestors.select(*(F.col(c).cast("string").alias(c) for c in columns)).distinct(), *columns)
        return lambda a, b: member(F.struct(a["system"].cast("string").alias("system"), a["code"].cast("string").alias("ancestor"), b["code"].cast("string").alias("code")))
