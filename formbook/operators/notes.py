"""Strategy notes (B8, B9): validation with normalisation, listing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from formbook.schema import NOTE_TYPES

R_EMPTY = "empty note content"
R_TEAM = "unknown franchise"


def validate_notes(notes: DataFrame, franchises: DataFrame, note_types: Sequence[str] = NOTE_TYPES) -> DataFrame:
    """Unknown type -> 'general'; blank content rejected; unknown team
    rejected (a NULL team is allowed); accepted content is trimmed."""
    f = franchises.select("franchise_id", F.lit(True).alias("_known"))
    n = notes.join(f, "franchise_id", "left")
    blank = F.col("content").isNull() | (F.length(F.trim("content")) == 0)
    unknown = F.col("franchise_id").isNotNull() & F.col("_known").isNull()
    reason = F.when(blank, F.lit(R_EMPTY)).when(unknown, F.lit(R_TEAM))
    return n.select(
        "note_id", "franchise_id",
        F.when(F.col("note_type").isin(list(note_types)), F.col("note_type")).otherwise(F.lit("general"))
        .alias("note_type"),
        F.when(~blank, F.trim("content")).alias("content"),
        F.length("content").alias("chars"),
        "created_by",
        reason.isNull().alias("accepted"),
        reason.alias("reason"),
    )


def notes_audit(validated: DataFrame) -> DataFrame:
    """Audit rows emitted for accepted notes (B8 -> change_log)."""
    return validated.where(F.col("accepted")).select(
        "note_id",
        F.lit("data_change").alias("event_type"), F.lit("strategy_notes").alias("table_name"),
        F.lit("save_strategy_note").alias("tool_name"), "franchise_id",
        F.to_json(F.struct("note_id", "note_type", "chars")).alias("payload"),
        F.lit("success").alias("result_status"))


def list_notes(validated: DataFrame, franchises: DataFrame, team: str | None = None, limit: int = 20) -> DataFrame:
    """B9 (J13 + O4): accepted notes with the team name, optional
    case-folded team filter, newest first."""
    n = (validated.where(F.col("accepted"))
         .join(franchises.select("franchise_id", F.col("name").alias("franchise_name")), "franchise_id", "left"))
    if team:
        n = n.where(F.lower("franchise_name") == team.lower())
    return n.select("note_id", "note_type", "content", "created_by", "franchise_name") \
        .orderBy(F.desc("note_id")).limit(limit)
