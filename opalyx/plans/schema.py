"""Schemas of the store's tables and their additive evolution."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

_S, _D, _TS, _B, _L, _A = T.StringType(), T.DoubleType(), T.TimestampType(), T.BooleanType(), T.LongType(), T.ArrayType(T.StringType())


def _table(required: dict, optional: dict) -> T.StructType:
    return T.StructType([T.StructField(k, v, False) for k, v in required.items()] + [T.StructField(k, v) for k, v in optional.items()])


OPPORTUNITIES = _table(
    {
        **dict.fromkeys(["id", "dedup_key", "title", "organizer", "source_url", "status", "opportunity_type", "evidence_level"], _S),
        **dict.fromkeys(["regions", "languages", "competition_types", "project_types", "building_categories", "official_sectors", "built_asset_types", "design_scopes", "project_modes", "audience", "cpv_codes"], _A),
        "extraction_confidence": _D,
        "discovered_at": _TS,
        "updated_at": _TS,
    },
    {
        **dict.fromkeys(["authority_name", "official_url", "jurisdiction", "procedure_type", "official_notice_id", "implementation_path", "estimated_contract_value_text", "prize_summary", "location_label", "geo_source", "eligibility_summary", "brief_pdf_url", "documents_portal_url", "evidence_note"], _S),
        **dict.fromkeys(["licensed_architect_required", "local_partner_required"], _B),
        **dict.fromkeys(["registration_fee_eur", "submission_fee_eur", "estimated_contract_value_eur", "geo_lat", "geo_lng", "geo_confidence", "qualification_score"], _D),
        "deadline_at": T.DateType(),
        "last_verified_at": _TS,
    },
)
_RUN = {"source_id": _S, "source_name": _S, "source_kind": _S, "source_tier": _S}
_COUNTS = dict.fromkeys(["document_count", "upserted_count", "parse_failure_count", "duplicate_group_count", "max_duplicate_group_size"], _L)
SOURCE_RUNS = _table({"id": _L, **_RUN, "status": _S, "started_at": _TS, **_COUNTS}, {"completed_at": _TS, "last_error": _S})
SOURCE_HEALTH = _table(
    {**_RUN, "last_status": _S, **dict.fromkeys(["last_document_count", "last_upserted_count", "last_parse_failure_count", "duplicate_group_count", "max_duplicate_group_size"], _L), "updated_at": _TS},
    {"last_run_started_at": _TS, "last_run_completed_at": _TS, "last_success_at": _TS, "last_error": _S},
)
REVIEW_QUEUE = _table(
    {**dict.fromkeys(["queue_id", "origin", "reason_code", "status"], _S), "priority": T.IntegerType(), "title": _S, "summary": _S, "payload_json": _S, "is_active": _B, "first_detected_at": _TS, "last_detected_at": _TS, "updated_at": _TS},
    dict.fromkeys(["evidence_note", "source_id", "competition_id", "dedup_key", "notice_id"], _S),
)
REVIEW_DECISIONS = _table({"id": _L, "queue_id": _S, "decision": _S, "created_at": _TS}, {"actor_label": _S, "note": _S})
SAVED_SEARCHES = _table({"id": _L, "workspace_key": _S, "name": _S, "filters_json": _S, "created_at": _TS, "updated_at": _TS}, {})
WATCHLIST = _table({"id": _L, "workspace_key": _S, "opportunity_id": _S, "created_at": _TS, "updated_at": _TS}, {})

#: What columns added to older tables hold.
DEFAULTS = {"opportunity_type": "unknown", "evidence_level": "secondary", "status": "discovered"}


class UnsafeDrift(ValueError):
    """A table lacks a column that has no default, or holds one of another type."""


def align_schema(df: DataFrame, target: T.StructType) -> DataFrame:
    """df with the target's columns, in its order: missing nullable ones as null, others by default, else an error."""
    have = {f.name: f.dataType for f in df.schema}
    out = []
    for f in target:
        if f.name in have:
            if have[f.name] != f.dataType and not _widens(have[f.name], f.dataType):
                raise UnsafeDrift(f"{f.name} is {have[f.name].simpleString()}, not {f.dataType.simpleString()}")
            out.append(F.col(f.name).cast(f.dataType).alias(f.name))
        elif f.nullable:
            out.append(F.lit(None).cast(f.dataType).alias(f.name))
        elif isinstance(f.dataType, T.ArrayType):
            out.append(F.array().cast(f.dataType).alias(f.name))
        elif f.name in DEFAULTS:
            out.append(F.lit(DEFAULTS[f.name]).cast(f.dataType).alias(f.name))
        else:
            raise UnsafeDrift(f"{f.name} is missing and has no default")
    return df.select(*out)


def _widens(a: T.DataType, b: T.DataType) -> bool:
    rank = {"tinyint": 0, "smallint": 1, "int": 2, "bigint": 3, "float": 4, "double": 5}
    stamps = {"timestamp", "timestamp_ntz"}
    x, y = a.simpleString(), b.simpleString()
    return (x in rank and y in rank and rank[x] < rank[y]) or {x, y} <= stamps


def has_column(df: DataFrame, name: str) -> bool:
    return name in df.columns


def read_or_empty(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """The table at a path, aligned; an empty one where nothing is there."""
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    there = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(hadoop)
    return align_schema(spark.read.parquet(path), schema) if there else spark.createDataFrame([], schema)
