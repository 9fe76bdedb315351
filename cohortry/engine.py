"""The engine: parse, check and evaluate libraries over a model's tables."""

from __future__ import annotations

import datetime as dt
import threading
import uuid
from collections import OrderedDict
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from .errors import EvaluationFault, LogicError, SemanticFault, SyntaxFault, TimeoutFault, TooCostlyFault
from .plans.lower import Lowerer, Scope
from .plans.syntax import Node, parse_library
from .sources.model import Model


@dataclass(frozen=True)
class Diagnostic:
    """What a check found: its severity, message, place and definition."""

    severity: str
    message: str
    pos: tuple[int, int] | None
    define: str | None


class Library:
    """A parsed library."""

    def __init__(self, tree: Node, text: str):
        self.tree, self.text = tree, text

    @property
    def name(self) -> str | None:
        return self.tree.name

    @property
    def version(self) -> str | None:
        return self.tree.version

    @property
    def expressions(self) -> list[str]:
        return [d.name for d in self.tree.defines]

    def private(self, name: str) -> bool:
        return any(d.name == name and d.access == "private" for d in self.tree.defines)


class Engine:
    """Evaluates libraries for every subject of their contexts.

    libraries: a mapping or a function from name (and version) to the text of an included library; externals:
    functions from columns to a column; now: the frozen time; the limits bound the source, the nesting of an
    expression, the rows of a retrieve (refused beyond, never cut) and the seconds of an evaluation.
    """

    def __init__(
        self,
        spark: SparkSession,
        model: Model | None = None,
        terminology=None,
        libraries: dict[str, str] | Callable[[str, str | None], str | None] | None = None,
        externals: dict[str, Callable] | None = None,
        now: dt.datetime | None = None,
        max_source: int = 100_000,
        max_depth: int = 2000,
        max_retrieve: int | None = None,
        timeout: float | None = None,
        cache: int = 64,
        validate: bool = True,
        trace: Callable | None = None,
    ):
        self.spark, self.model, self.terminology = spark, model or Model(), terminology
        self.resolver = (lambda name, version: libraries.get(name)) if isinstance(libraries, dict) else libraries
        self.externals, self.now = externals or {}, now
        self.max_source, self.max_depth, self.max_retrieve, self.timeout, self.validate, self.trace = max_source, max_depth, max_retrieve, timeout, validate, trace
        self._parsed: OrderedDict[str, Library] = OrderedDict()
        self._cache = cache
        # timestamps without a zone are kept as they are written only in UTC
        spark.conf.set("spark.sql.session.timeZone", "UTC")

    def parse(self, text: str) -> Library:
        if len(text) > self.max_source:
            raise TooCostlyFault(f"the source has {len(text)} characters; at most {self.max_source} are taken")
        if text in self._parsed:
            self._parsed.move_to_end(text)
            return self._parsed[text]
        lib = Library(parse_library(text, self.max_depth), text)
        self._parsed[text] = lib
        while len(self._parsed) > self._cache:
            self._parsed.popitem(last=False)
        return lib

    def lowerer(self, lib: Library, parameters: dict | None = None, now: dt.datetime | None = None, seen: tuple[str, ...] = ()) -> Lowerer:
        includes = {}
        for inc in lib.tree.includes:
            if inc.name in seen:
                raise SemanticFault(f"libraries include each other: {' -> '.join((*seen, inc.name))}", inc.pos)
            text = self.resolver(inc.name, inc.version) if self.resolver else None
            if text is None:
                raise SemanticFault(f"the library {inc.name} isn't found", inc.pos)
            includes[inc.alias] = self.lowerer(self.parse(text), None, now, (*seen, inc.name))
        at = now or self.now or dt.datetime.now(dt.timezone.utc).replace(tzinfo=None)
        low = Lowerer(self.spark, lib.tree, self.model, at, parameters or {}, self.terminology, includes, self.externals)
        low.trace = self.trace
        return low

    def check(self, text: str | Library) -> list[Diagnostic]:
        """All that is wrong with a library, one finding for each definition; no data is read but schemas."""
        try:
            lib = self.parse(text) if isinstance(text, str) else text
        except LogicError as e:
            return [Diagnostic("error", e.message, e.pos, None)]
        found = []
        try:
            low = self.lowerer(lib)
        except LogicError as e:
            return [Diagnostic("error", e.message, e.pos, None)]
        for d in lib.tree.defines:
            try:
                low.lower_define(d.name, Scope(low, low.frame(d.context), None, d.context))
            except LogicError as e:
                if e.define in (None, d.name):
                    found.append(Diagnostic("error", e.message, e.pos, d.name))
        return found

    def evaluate(self, lib: Library | str, name: str | None = None, parameters: dict | None = None, now: dt.datetime | None = None):
        """A definition's DataFrame, or those of all public definitions by name."""
        lib = self.parse(lib) if isinstance(lib, str) else lib
        low = self.lowerer(lib, parameters, now)
        low.max_retrieve = self.max_retrieve
        if name is not None:
            if name not in low.defines:
                raise SemanticFault(f"the library has no definition {name}")
            return low.define(name)
        return {d.name: low.define(d.name) for d in lib.tree.defines if d.access != "private"}

    def value(self, expression: str, parameters: dict | None = None):
        """The value of an expression without a context, as Python has it."""
        rows = self.collect(self.evaluate(f"define \"result\": {expression}", "result", parameters))
        return [r["value"] for r in rows] if len(rows) != 1 else rows[0]["value"]

    def collect(self, df: DataFrame) -> list:
        """The rows of a small result, within the time limit; the jobs are cancelled beyond it."""
        sc = self.spark.sparkContext
        tag = f"cohortry-{uuid.uuid4().hex}"
        timer = threading.Timer(self.timeout, lambda: sc.cancelJobsWithTag(tag)) if self.timeout else None
        sc.addJobTag(tag)
        try:
            if timer:
                timer.start()
            return df.collect()
        except Exception as e:
            if timer and not timer.is_alive():
                raise TimeoutFault(f"the evaluation took more than {self.timeout} seconds") from e
            raise EvaluationFault(str(e).splitlines()[0]) from e
        finally:
            sc.removeJobTag(tag)
            if timer:
                timer.cancel()


__all__ = ["Diagnostic", "Engine", "EvaluationFault", "Library", "SemanticFault", "SyntaxFault", "TimeoutFault", "TooCostlyFault"]
