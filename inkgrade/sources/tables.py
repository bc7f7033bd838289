"""The five stored tables, with declared schemas."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import ArrayType, StringType, StructType

SCHEMAS = {
    "teachers": "id INT, first_name STRING, last_name STRING, email STRING, position STRING, "
                "university STRING, created_at TIMESTAMP",
    "students": "id INT, teacher_id INT, full_name STRING, university STRING, direction STRING, "
                "stage STRING, login STRING, is_active BOOLEAN, created_at TIMESTAMP",
    "tasks": "id INT, teacher_id INT, title STRING, description STRING, mode STRING, "
             "reference_file_path STRING, instruction_file_path STRING, deadline TIMESTAMP, "
             "is_active BOOLEAN, created_at TIMESTAMP",
    "task_assignments": "id INT, task_id INT, student_id INT, created_at TIMESTAMP",
    "submissions": "id INT, task_id INT, student_id INT, attempt_number INT, mode STRING, "
                   "uploaded_file_path STRING, total_score DOUBLE, ai_json_result STRING, "
                   "overlay_path STRING, table_json ARRAY<STRUCT<criterion: STRING, "
                   "score: DOUBLE, max_score: DOUBLE, percent: DOUBLE, comment: STRING>>, "
                   "status STRING, created_at TIMESTAMP",
}


def read_tables(spark: SparkSession, base: str, fmt: str = "parquet", **options) -> dict[str, DataFrame]:
    """Each stored table as a DataFrame of its declared schema, read from ``base/<table>`` without schema inference.

    With ``fmt="jdbc"``, ``base`` is the JDBC URL and ``id_bounds`` (one pair, or one per table) and ``num_partitions`` in
    ``options`` split each read into ranges of ``id``; columns are cast to their declared types, structures from JSON.
    """
    if fmt != "jdbc":
        return {
            name: spark.read.schema(schema).format(fmt).options(**options).load(f"{base}/{name}")
            for name, schema in SCHEMAS.items()
        }
    bounds = options.pop("id_bounds")
    parts = options.pop("num_partitions", 200)
    out = {}
    for name in SCHEMAS:
        low, high = bounds[name] if isinstance(bounds, dict) else bounds
        rows = spark.read.format("jdbc").options(
            url=base, dbtable=name, partitionColumn="id", lowerBound=low, upperBound=high, numPartitions=parts, **options).load()
        out[name] = rows.select(declared(rows, name))
    return out


def declared(rows: DataFrame, name: str) -> list[Column]:
    """The columns of a stored table in their declared types; those that ``rows`` lack are null."""
    out = []
    for field in StructType.fromDDL(SCHEMAS[name]).fields:
        if field.name not in rows.columns:
            value = F.lit(None).cast(field.dataType)
        elif isinstance(field.dataType, ArrayType) and isinstance(rows.schema[field.name].dataType, StringType):
            value = F.from_json(field.name, field.dataType.simpleString())
        else:
            value = F.col(field.name).cast(field.dataType)
        out.append(value.alias(field.name))
    return out
