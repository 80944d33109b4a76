"""Registry collections: JSON records in, normalised columns out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import clean_array, ws_trim

REGISTRY_SCHEMA = (
    "skill_id string, name string, display_name string, source_type string, source_location string, version string, description string, purpose_summary string, "
    "declared_capabilities array<string>, detected_capabilities array<string>, risk_tags array<string>, admission_status string, review_decision string, review_summary string, "
    "report_id string, file_name string, file_hash string, created_by string, reviewed_by string, created_at long, updated_at long"
)
PROFILE_SCHEMA = (
    "skill_id string, network_access boolean, file_read boolean, file_write boolean, command_exec boolean, sensitive_data_access boolean, external_fetch boolean, "
    "data_collection boolean, persistence boolean, privilege_use boolean, tool_invocation boolean, tags array<string>, evidence array<string>"
)
RISK_SCHEMA = "skill_id string, id string, category string, level string, title string, description string, condition string, mitigation string"
RECORD_SCHEMA = (
    "record_id string, skill_id string, report_id string, reviewer string, decision string, summary string, "
    "residual_risks array<struct<id:string,category:string,level:string,title:string>>, capability_notes array<string>, created_at long"
)
REPORT_SCHEMA = (
    "id string, task_id string, file_name string, username string, team string, created_at long, status string, decision string, finding_count int, high_risk int, medium_risk int, "
    "low_risk int, no_risk int, item_scores map<string,double>"
)
LOGIN_SCHEMA = "id string, username string, timestamp long, result string, ip string"
USER_SCHEMA = "username string, team string, role string, created_at long"
DEFAULTS = {"admission_status": "pending", "review_decision": "review", "decision": "review"}
_BEHAVIOR = [
    "network_targets", "file_targets", "exec_targets", "download_iocs", "drop_iocs", "execute_iocs", "outbound_iocs", "persistence_iocs", "priv_esc_iocs", "credential_iocs",
    "defense_evasion_iocs", "lateral_move_iocs", "collection_iocs", "c2_beacon_iocs", "behavior_chains", "behavior_timelines", "sequence_alerts", "probe_warnings", "evasion_signals",
]
PAYLOAD_SCHEMA = "result struct<behavior:struct<" + ",".join(f"{c}:array<string>" for c in _BEHAVIOR) + ">>"


def normalize(df: DataFrame) -> DataFrame:
    """Trim strings, clean string arrays, fill status defaults."""
    cols = []
    for f in df.schema.fields:
        c = F.col(f.name)
        if isinstance(f.dataType, T.StringType):
            c = ws_trim(c)
            if f.name in DEFAULTS:
                c = F.when(F.coalesce(c, F.lit("")) == "", F.lit(DEFAULTS[f.name])).otherwise(c)
        elif f.dataType.simpleString() == "array<string>":
            c = clean_array(F.coalesce(c, F.array().cast("array<string>")))
        cols.append(c.alias(f.name))
    return df.select(*cols)


def read_registry(spark: SparkSession, path: str, schema: str = REGISTRY_SCHEMA, fmt: str = "json", multiline: bool = False) -> DataFrame:
    """JSON lines (or parquet) of one record type with a declared schema, normalised.

    ``multiline=True`` reads files that hold one JSON array each; such a file is one task.
    """
    r = spark.read.schema(schema)
    df = r.option("multiLine", str(multiline).lower()).json(path) if fmt == "json" else r.format(fmt).load(path)
    return normalize(df)


def explode_results(reports: DataFrame, payload: str = "payload", key: str = "skill_id") -> DataFrame:
    """Nested report payload -> long behaviour rows: key, category, item.

    Unparseable payloads yield no rows.
    """
    b = F.from_json(F.col(payload), PAYLOAD_SCHEMA)["result"]["behavior"]
    tagged = lambda name: lambda x: F.struct(F.lit(name).alias("category"), x.alias("item"))
    cells = F.concat(*[F.transform(F.coalesce(b[c], F.array().cast("array<string>")), tagged(c.removesuffix("_iocs"))) for c in _BEHAVIOR])
    return reports.select(key, F.explode(cells).alias("r")).select(key, "r.category", "r.item")
