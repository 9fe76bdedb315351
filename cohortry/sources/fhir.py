"""FHIR resources as JSON lines or tables: six types, with the subject each belongs to.

Temporal elements stay text on reading, since their digits say how precise they are; the language's conversions
make spans of them.  Elements with a choice of types are columns of their own (valueQuantity, valueString, ...),
and the plain name stands for whichever is there.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .model import Entity, Model

CODING = "array<struct<code:string,display:string,system:string,version:string>>"
CONCEPT = f"struct<coding:{CODING},text:string>"
QUANTITY = "struct<value:decimal(28,8),unit:string,system:string,code:string>"
PERIOD = "struct<start:string,`end`:string>"
REFERENCE = "struct<reference:string>"
SCHEMAS = {
    "Patient": "id string, gender string, birthDate string, deceasedBoolean boolean, name array<struct<family:string,given:array<string>>>",
    "Practitioner": "id string, name array<struct<family:string>>",
    "Organization": "id string, name string",
    "Encounter": f"id string, status string, class struct<code:string>, type array<{CONCEPT}>, subject {REFERENCE}, period {PERIOD}",
    "Observation": f"id string, status string, code {CONCEPT}, subject {REFERENCE}, encounter {REFERENCE}, effectiveDateTime string, effectivePeriod {PERIOD}, valueQuantity {QUANTITY}, valueString string, valueCodeableConcept {CONCEPT}",
    "Condition": f"id string, code {CONCEPT}, subject {REFERENCE}, onsetDateTime string, recordedDate string",
}


def read_resources(spark: SparkSession, path: str, kind: str) -> DataFrame:
    """One resource type from JSON lines (other types in the files are passed over), with a key column of its subject."""
    rows = spark.read.schema(f"resourceType string, {SCHEMAS[kind]}").json(path).where(F.col("resourceType") == kind).drop("resourceType")
    return with_subject(rows)


def with_subject(rows: DataFrame) -> DataFrame:
    """subjectId: the id in a reference like Patient/1."""
    if "subject" not in rows.columns:
        return rows
    return rows.withColumn("subjectId", F.regexp_extract(F.col("subject.reference"), r"(?:^|/)Patient/([^/]+)$", 1))


def resolve(rows: DataFrame, reference: str, targets: DataFrame, kind: str) -> DataFrame:
    """rows joined to the resource of a type that a reference column like Encounter/5 names; others get nulls."""
    found = targets.select(F.col("id").alias("__id"), F.struct(*targets.columns).alias(kind.lower()))
    return rows.join(found, F.regexp_extract(F.col(reference), rf"(?:^|/){kind}/([^/]+)$", 1) == F.col("__id"), "left").drop("__id")


def fhir_model(tables: dict[str, DataFrame]) -> Model:
    """A model over resource tables by type name."""
    m = Model("FHIR")
    for name, df in tables.items():
        df = with_subject(df) if "subjectId" not in df.columns else df
        subject = {"Patient": "id"} if name == "Patient" else {"Patient": "subjectId"} if "subjectId" in df.columns else {name: "id"}
        m.add(Entity(name, lambda df=df: df, "id", code={"Encounter": "type", "Observation": "code", "Condition": "code"}.get(name), subject=subject, order=("id",), birth="birthDate" if name == "Patient" else None))
    return m


HELPERS = """library Helpers
define function ToCode(c Tuple{code String, display String, system String, version String}): Code { code: c.code, display: c.display, system: c.system, version: c.version }
define function ToQuantity(q Tuple{value Decimal, unit String, system String, code String}): Quantity { value: q.value, unit: Coalesce(q.code, q.unit) }
define function ToInterval(p Tuple{start String, "end" String}): Interval[ToDateTime(p.start), ToDateTime(p."end")]
define function ToConcept(c Tuple{coding List<Code>, text String}): Concept { codes: c.coding, display: c.text }
define function ToString(s String): s
"""
