"""The data model: explicit schemas, keys, references and checks of its 67 tables.

The tables are described once, in the data dictionary of ``FIXTURES.md``; this
module turns that text into Spark schemas and into the rules of
``operators.quality``, so that dictionary and code cannot drift apart.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import cache, reduce
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plenum.operators import quality
from plenum.operators.quality import Rule
from plenum.schema.domains import DOMAINS
from plenum.sources import io

DICTIONARY = Path(__file__).resolve().parents[2] / "FIXTURES.md"

TYPES = {
    "string": T.StringType(), "int": T.IntegerType(), "bigint": T.LongType(),
    "boolean": T.BooleanType(), "double": T.DoubleType(), "float": T.FloatType(),
    "date": T.DateType(), "timestamp": T.TimestampType(),
    # The one unbounded number: amounts of money.
    "decimal(38,s)": T.DecimalType(38, 6),
}

TABLE = re.compile(r"^\*\*(\w+)\*\* — (.*)\.\s*$")
COLUMN = re.compile(
    r"(\w+) (?:array<(\w+)>|(decimal\(38,s\)|\w+))(?:\(uuid\))?(?:∈(\w+))?(?:\[(\d+)\])?( !)? `"
)
KEY = re.compile(r"(?:PK|UQ)\(([^)]*)\)(?: WHERE ([^`]*?))? `")
REFERENCE = re.compile(r"([\w+]+)→(\w+)(\*?)")


@dataclass(frozen=True)
class Key:
    columns: tuple[str, ...]
    where: str | None = None


@dataclass(frozen=True)
class Reference:
    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]
    cascade: bool


@dataclass
class Table:
    name: str
    schema: T.StructType
    domains: dict[str, str] = field(default_factory=dict)
    widths: dict[str, int] = field(default_factory=dict)
    keys: list[Key] = field(default_factory=list)
    references: list[Reference] = field(default_factory=list)

    def rules(self) -> list[Rule]:
        """NOT NULL, domains, vector widths, and the checks of the table."""
        required = [quality.not_null(f.name) for f in self.schema if not f.nullable]
        closed = [quality.in_domain(c, DOMAINS[d]) for c, d in self.domains.items()]
        wide = [quality.has_width(c, w) for c, w in self.widths.items()]
        return required + closed + wide + checks().get(self.name, [])


def checks() -> dict[str, list[Rule]]:
    """The CHECK constraints of the data model, by table."""
    within, one = quality.within, quality.exactly_one
    candidate = quality.present_iff("vote_cast_candidate_name", "position = 'Candidate'")
    shape = quality.union_shape(
        "legislation_type", {"BILL": "bill_type", "AMENDMENT": "amendment_type"}
    )
    return {
        "user_preferences": [within("importance", 1, 10)],
        "qa_question_topics": [within("weight", 0, 1, open_low=True)],
        "qa_answer_options": [within("stance_multiplier", -1, 1), within("importance_signal", 1, 10)],
        "qa_user_responses": [one("selected_option", "custom_text")],
        "user_bill_alignments": [within("alignment_score", 0, 1)],
        "user_amendment_alignments": [within("alignment_score", 0, 1)],
        "bill_concept_group_taxonomy": [within("score", 0, 1)],
        "raw_bill_text": [within("chunk_index", 0)],
        "amendment_text_chunks": [within("chunk_index", 0)],
        "vote_positions": [one("member_id", "lis_member_id"), candidate],
        "vote_history_positions": [candidate],
        "votes": [shape],
        "vote_history": [shape],
        "concept_taxonomy": [quality.in_domain("status", DOMAINS["taxonomy_status"])],
        "bill_concept_topics": [
            quality.in_domain("effect", DOMAINS["concept_effect"]),
            quality.in_domain("impact", DOMAINS["concept_impact"]),
            quality.in_domain("scope", DOMAINS["concept_scope"]),
        ],
        "bill_decomposition_runs": [quality.in_domain("status", DOMAINS["decomposition_status"])],
    }


# Keys the data model means to have besides the declared ones.
INTENDED_KEYS = {
    "member_terms": ("member_id", "chamber", "start_year"),
    "qa_user_responses": ("user_id", "question_id"),
    "bill_concept_summaries": ("analysis_id", "concept_group_id"),
    "bill_fiscal_estimates": ("analysis_id", "concept_group_id", "pass_number"),
    "bill_analysis_topics": ("analysis_id", "concept_group_id", "topic", "pass_number"),
    "amendment_concept_summaries": ("analysis_id", "amendment_id"),
}


def _columns(text: str) -> tuple[T.StructType, dict[str, str], dict[str, int]]:
    fields, domains, widths = [], {}, {}
    for entry in text.split("; "):
        match = COLUMN.match(entry)
        if not match:
            raise ValueError(f"unreadable column in the data dictionary: {entry}")
        name, element, plain, domain, width, required = match.groups()
        type_ = T.ArrayType(TYPES[element], containsNull=False) if element else TYPES[plain]
        fields.append(T.StructField(name, type_, not required))
        if domain:
            domains[name] = domain
        if width:
            widths[name] = int(width)
    return T.StructType(fields), domains, widths


@cache
def tables(dictionary: Path = DICTIONARY) -> dict[str, Table]:
    """All tables of the data dictionary, by name."""
    found: dict[str, Table] = {}
    pending: list[tuple[str, tuple[str, ...], str, bool]] = []
    current = None
    for line in dictionary.read_text(encoding="utf-8").splitlines():
        head = TABLE.match(line)
        if head:
            current = Table(head[1], *_columns(head[2]))
            found[current.name] = current
        elif line.startswith("Keys: ") and current:
            keys, _, references = line.partition("FKs: ")
            current.keys = [
                Key(tuple(k.strip() for k in columns.split(",")), where or None)
                for columns, where in KEY.findall(keys)
            ]
            for columns, parent, star in REFERENCE.findall(references):
                pending.append((current.name, tuple(columns.split("+")), parent, bool(star)))
    for child, columns, parent, cascade in pending:
        # A composite reference uses the same names on both sides, a single one
        # points at the parent's primary key.
        target = columns if len(columns) > 1 else primary_key(found[parent])
        found[child].references.append(Reference(columns, parent, target, cascade))
    return found


def primary_key(table: Table) -> tuple[str, ...]:
    singles = [k.columns for k in table.keys if k.columns in (("id",), ("user_id",), ("state_code",))]
    return singles[0] if singles else table.keys[0].columns


def scan(spark: SparkSession, root: str, name: str, columns: Sequence[str] | None = None) -> DataFrame:
    """A table of the data model stored as Parquet under ``root``."""
    schema = tables()[name].schema
    return io.scan(spark, f"{root}/{name}", schema, columns or schema.names)


def cascades() -> list[tuple[str, list[str], str, list[str]]]:
    """The cascading references, in the form ``cascade_delete`` takes."""
    return [
        (t.name, list(r.columns), r.parent, list(r.parent_columns))
        for t in tables().values()
        for r in t.references
        if r.cascade
    ]


def integrity_report(data: Mapping[str, DataFrame]) -> DataFrame:
    """Violations of every rule, key (declared or intended) and reference among the
    given tables: ``table, rule, violations``. References to tables not given are
    skipped; all others are settled in one shuffle."""
    parts = []
    for name, df in data.items():
        table = tables()[name]
        label = F.lit(name).alias("table")
        parts.append(quality.quality_report(df, *table.rules()).select(label, "rule", "violations"))
        intended = [Key(INTENDED_KEYS[name])] if name in INTENDED_KEYS else []
        for key in table.keys + intended:
            where = F.expr(key.where) if key.where else None
            repeated = quality.unique_violations(df, list(key.columns), where=where)
            rule = F.lit(f"unique({','.join(key.columns)})").alias("rule")
            parts.append(repeated.agg(F.count("*").alias("violations")).select(label, rule, "violations"))
    refs = [
        (name, dict(zip(ref.columns, ref.parent_columns, strict=True)), ref.parent)
        for name in data for ref in tables()[name].references if ref.parent in data
    ]
    if refs:
        rule = F.concat_ws("→", F.replace("columns", F.lit(","), F.lit("+")), "parent").alias("rule")
        lost = quality.reference_violations(data, refs)
        parts.append(lost.select(F.col("child").alias("table"), rule, F.col("orphans").alias("violations")))
    return reduce(DataFrame.unionByName, parts)
