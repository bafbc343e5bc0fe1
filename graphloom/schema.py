"""Fixed schemas of nodes, edges and results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _A = T.StringType(), T.ArrayType(T.StringType())


def _struct(**fields) -> T.StructType:
    return T.StructType([T.StructField(k, v, True) for k, v in fields.items()])


NODE = _struct(
    id=_S, type=_S, timestamp=T.TimestampNTZType(), source_files=_A, source=_S, collection=_S, project=_S,
    description=_S, rationale=_S, alternatives=_A, related_to=_A,
    name=_S, implementation=_S, use_cases=_A, context=_S,
    attempt=_S, reason_failed=_S, lesson_learned=_S, alternative_solution=_S,
)
EDGE = _struct(src=_S, dst=_S, rel_type=_S, weight=T.DoubleType(), created_at=T.TimestampNTZType(), reasoning=_S, llm_classified=T.BooleanType())
GAP_REPORT = _struct(gap_type=_S, affected_nodes=_A, severity=_S, recommendation=_S, metrics=T.MapType(_S, T.DoubleType()))
SCANNED_FILE = _struct(
    normalized_path=_S, original_path=_S, filesystem_id=_S, file_size=T.LongType(), last_modified=T.DoubleType(),
    content_hash=_S, last_scanned=T.DoubleType(), project_id=_S, scan_status=_S, error_message=_S,
)

#: Least and most characters of each field, by node type.
BOUNDS = {
    "Decision": {"description": (10, 1000), "rationale": (20, 2000)},
    "Pattern": {"name": (3, 100), "implementation": (20, 3000), "context": (10, 1000)},
    "Failure": {"attempt": (10, 1000), "reason_failed": (10, 2000), "lesson_learned": (20, 2000), "alternative_solution": (0, 1000)},
}
#: Fields that may be missing.
OPTIONAL = {"alternative_solution"}
PREFIX = {"Decision": "D", "Pattern": "P", "Failure": "F"}


def json_list(column: Column) -> Column:
    """A list that was stored as JSON text; text that is no JSON list gives an empty one."""
    return F.coalesce(F.from_json(column, "array<string>"), F.array().cast("array<string>"))


def conform(df: DataFrame, schema: T.StructType) -> DataFrame:
    """df with exactly the columns of the schema: missing ones null, JSON text read where a list is due."""
    def one(f):
        if f.name not in df.columns:
            return F.lit(None).cast(f.dataType).alias(f.name)
        c = F.col(f.name)
        if isinstance(f.dataType, T.ArrayType) and df.schema[f.name].dataType == _S:
            c = F.when(c.isNotNull(), json_list(c))
        return c.cast(f.dataType).alias(f.name)

    return df.select(*map(one, schema.fields))
