"""Nested match documents: build (D2), write, and scan.

The scan reads multi-line JSON against the declared ``MATCH_SCHEMA``
(absent optional fields -> NULL, undeclared fields dropped at parse
time) and takes lineage + id from the hidden ``_metadata.file_path``.
"""

from __future__ import annotations

import json
import re
import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DataType, MapType, StructField, StructType

from formbook.schema import MATCH_SCHEMA
from formbook.session import session_with
from formbook.sources.tables import any_file, move_folder, partition_folder, remove_folder

DEFAULT_ID_PATTERN = r"([0-9]+)\.json$"
OPEN_COST = 64 << 10  # bytes that a file counts on top of its own when files are packed into tasks
MALFORMED = "malformed"  # column of a scan that keeps what the parser cannot read
NO_FILES = "no files"
INGEST_STATUS = "competition string, ok boolean, documents long, error string"


# Bronze columns and where they stand in a document (fixed values).
DOCUMENT_COLUMNS = {
    "dates": "info.dates",
    "event": "info.event",
    "gender": "info.gender",
    "match_type": "info.match_type",
    "outcome_result": "info.outcome.result",
    "outcome_winner": "info.outcome.winner",
    "outcome_method": "info.outcome.method",
    "outcome_eliminator": "info.outcome.eliminator",
    "outcome_by_runs": "info.outcome.by.runs",
    "outcome_by_wickets": "info.outcome.by.wickets",
    "outcome_by_innings": "info.outcome.by.innings",
    "overs_per_innings": "info.overs",
    "player_of_match": "info.player_of_match",
    "season": "info.season",
    "team_type": "info.team_type",
    "teams": "info.teams",
    "toss": "info.toss",
    "venue": "info.venue",
    "player_registry": "info.registry.people",
    "innings": "innings",
}


def declared_field(df: DataFrame, path: str) -> Column:
    """The field at a dotted ``path`` with its declared type. An inferred
    schema holds only what the files carry, so there a missing field is NULL
    and a nested one of another shape is read again as declared."""
    def kind(level: DataType) -> DataType | None:
        for name in path.split("."):
            if not isinstance(level, StructType) or name not in level.names:
                return None
            level = level[name].dataType
        return level

    found, declared = kind(df.schema), kind(StructType.fromDDL(MATCH_SCHEMA))
    if found is None:
        return F.lit(None).cast(declared)
    if found == declared:
        return F.col(path)
    if isinstance(found, (StructType, ArrayType)):
        return F.from_json(F.to_json(path), declared)
    return F.col(path).cast(declared)


def inferred_schema(own: SparkSession, paths: str | list[str]) -> StructType:
    """The schema of the documents as their values show it. What is
    declared as a map keeps that type: its keys are data, and as fields they
    would grow with the people of all documents. Every document is read."""
    declared = StructType.fromDDL(MATCH_SCHEMA)
    places = [at.split(".") for at in DOCUMENT_COLUMNS.values()]

    def kind(place: list[str]) -> DataType:
        level = declared
        for name in place:
            level = level[name].dataType
        return level

    maps = [place for place in places if isinstance(kind(place), MapType)]
    parts = {place[0]: len(place) > 1 for place in places}
    loose = ", ".join(f"{name} {'map<string,variant>' if nested else 'variant'}" for name, nested in parts.items())
    docs = own.read.option("multiLine", True).schema(loose).json(paths)

    def kept(name: str) -> Column:
        keys = [place[1] for place in maps if place[0] == name]
        return F.map_filter(name, lambda key, _: ~key.isin(keys)).alias(name) if keys else F.col(name)

    texts = docs.select(F.to_json(F.struct(*[kept(name) for name in parts])).alias("value"))
    strings = getattr(texts._jdf, "as")(own._jvm.org.apache.spark.sql.Encoders.STRING())
    found = StructType.fromJson(json.loads(own._jsparkSession.read().json(strings).schema().json()))

    def with_field(level: StructType, place: list[str], field: DataType) -> StructType:
        rest = {f.name: f.dataType for f in level.fields}
        inner = rest.get(place[0])
        rest[place[0]] = field if len(place) == 1 else with_field(
            inner if isinstance(inner, StructType) else StructType(), place[1:], field)
        return StructType([StructField(name, of) for name, of in rest.items()])

    for place in maps:
        found = with_field(found, place, kind(place))
    return found


def _packed(spark: SparkSession, open_cost: int) -> SparkSession:
    """A session whose scans pack files into tasks by their bytes: a file
    counts ``open_cost`` bytes on top of its own, so a task of the usual 128
    MB takes up to two thousand small documents (32 with Spark's default)."""
    return session_with(spark, {"spark.sql.files.openCostInBytes": str(open_cost),
                                "spark.sql.variant.allowDuplicateKeys": "true"})


def _bronze_columns(docs: DataFrame, id_pattern: str, competition: Column) -> list[Column]:
    file = F.col("_metadata.file_path")
    return [file.alias("source_file"), F.regexp_extract(file, id_pattern, 1).alias("match_id"),
            competition.alias("competition"),
            *[declared_field(docs, at).alias(name) for name, at in DOCUMENT_COLUMNS.items()]]


def read_match_documents(spark: SparkSession, path: str, competition: str | None = None,
                         id_pattern: str = DEFAULT_ID_PATTERN, infer_schema: bool = False,
                         open_cost: int = OPEN_COST) -> DataFrame:
    """S1 + S3 + P1: bronze rows (one per match document). ``infer_schema``
    is the superseded inferred scan (S2) — a sampling pass over the files
    whose result drifts between sources; the declared schema is the default."""
    own = _packed(spark, open_cost)
    schema = inferred_schema(own, path) if infer_schema else MATCH_SCHEMA
    docs = own.read.option("multiLine", True).schema(schema).json(path)
    return docs.select(*_bronze_columns(docs, id_pattern, F.lit(competition).cast("string")))


@dataclass(frozen=True)
class Sources:
    """The active competitions of a configuration and where their documents
    lie. ``present`` have at least one file (file-system metadata only)."""

    codes: list[str]
    present: list[str]
    root: str
    folder: str

    def paths(self) -> list[str]:
        return [f"{self.root}/{self.folder.format(code=code)}" for code in self.present]

    def code_of_file(self) -> Column:
        """The competition in a file's path; paths come URL-encoded."""
        file = F.url_decode(F.replace(F.col("_metadata.file_path"), F.lit("+"), F.lit("%2B")))
        parts = [re.escape(part) for part in re.split(r"(\*|\{code\})", self.folder)]
        named = "".join({re.escape("*"): "[^/]*", re.escape("{code}"): "([^/]+)"}.get(p, p) for p in parts)
        return F.regexp_extract(file, f"/{named}$", 1)


def active_sources(spark: SparkSession, root: str, config: DataFrame, folder: str) -> Sources:
    """The active competitions of ``config`` (competition_code,
    is_active; a handful of rows)."""
    rows = config.where(F.col("is_active")).select("competition_code").distinct().collect()
    codes = sorted(r["competition_code"] for r in rows)
    return Sources(codes, [c for c in codes if any_file(spark, f"{root}/{folder.format(code=c)}")], root, folder)


def read_competitions(spark: SparkSession, root: str, config: DataFrame,
                      id_pattern: str = DEFAULT_ID_PATTERN, folder: str = "{code}/*.json",
                      infer_schema: bool = False, open_cost: int = OPEN_COST) -> tuple[DataFrame | None, DataFrame]:
    """S19 + S18: one scan of every active competition of ``config`` under
    ``root/<folder>``; the competition comes from the path, so the number of
    tasks follows the bytes and not the competitions or matches. Returns the
    scan (None where there is nothing) and a status DataFrame; a competition
    without files is recorded and the others go on."""
    sources = active_sources(spark, root, config, folder)
    status = spark.createDataFrame([(c, c in sources.present, None if c in sources.present else NO_FILES)
                                    for c in sources.codes], "competition string, ok boolean, error string")
    if not sources.present:
        return None, status
    own = _packed(spark, open_cost)
    schema = inferred_schema(own, sources.paths()) if infer_schema else MATCH_SCHEMA
    docs = own.read.option("multiLine", True).schema(schema).json(sources.paths())
    return docs.select(*_bronze_columns(docs, id_pattern, sources.code_of_file())), status


def ingest_competitions(spark: SparkSession, root: str, config: DataFrame, target: str,
                        id_pattern: str = DEFAULT_ID_PATTERN, folder: str = "{code}/*.json",
                        open_cost: int = OPEN_COST) -> DataFrame:
    """One scan and one write for all active competitions, each of them
    in its partition of ``target``.

    Malformed documents are kept as such by the PERMISSIVE parser, files that
    cannot be read at all (a broken archive) give no row and so differ from
    the listing. A competition with either, or without files, fails alone:
    its new partition is not published and what it held before stays.
    Publishing moves the written folders, so each document is written once.
    Returns (competition, ok, documents, error).
    """
    sources = active_sources(spark, root, config, folder)
    if not sources.present:
        return spark.createDataFrame([(c, False, None, NO_FILES) for c in sources.codes], INGEST_STATUS)
    own = _packed(spark, open_cost)
    docs = (own.read.option("multiLine", True).schema(f"{MATCH_SCHEMA}, {MALFORMED} string")
            .option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", MALFORMED)
            .option("ignoreCorruptFiles", True).json(sources.paths()))
    load = f"{target.rstrip('/')}/_load-{uuid.uuid4().hex}"
    (docs.select(*_bronze_columns(docs, id_pattern, sources.code_of_file()), F.col(MALFORMED).isNotNull().alias(MALFORMED))
     .write.partitionBy("competition").parquet(f"{load}/new"))

    listed = own.read.format("binaryFile").load(sources.paths()).select(
        F.col("_metadata.file_path").alias("source_file"), sources.code_of_file().alias("competition"))
    written = own.read.parquet(f"{load}/new").groupBy("source_file").agg(
        F.count("*").alias("documents"), F.count_if(MALFORMED).alias("malformed"))
    figures = listed.join(written, "source_file", "left").groupBy("competition").agg(
        F.count("*").alias("files"), F.count_if(F.col("documents").isNull()).alias("unreadable"),
        F.sum("malformed").alias("malformed"), F.sum("documents").alias("documents"))
    found = {r["competition"]: r for r in figures.collect()}  # a row for each competition of the configuration
    status = []
    for code in sources.codes:
        got = found.get(code)
        if got is None:
            status.append((code, False, None, NO_FILES))
        elif got["malformed"] or got["unreadable"]:
            status.append((code, False, None, f"{got['malformed'] or 0} malformed and {got['unreadable']} unreadable "
                                              f"of {got['files']} files"))
        else:
            publish(spark, f"{load}/new", f"{load}/old", target, code)
            status.append((code, True, got["documents"], None))
    remove_folder(spark, load)
    return spark.createDataFrame(status, INGEST_STATUS)


def publish(spark: SparkSession, new: str, old: str, target: str, code: str) -> None:
    """Put a competition's written partition in the place of its present one,
    which waits in ``old`` until the new one stands."""
    place = f"competition={partition_folder(code)}"
    move_folder(spark, f"{target}/{place}", f"{old}/{place}")
    move_folder(spark, f"{new}/{place}", f"{target}/{place}")


def nested_documents(d: DataFrame) -> DataFrame:
    """Pack ball rows back into one nested document per match.

    Every grouping key contains ``match_id``, so with balls partitioned
    by match the packing needs no shuffle; a document is bounded by the
    size of one match."""
    ball = F.struct(
        F.col("actual_delivery"), F.col("batter"), F.col("bowler"),
        F.lit(None).cast("string").alias("non_striker"),
        F.struct(F.col("extras_byes").alias("byes"), F.col("extras_legbyes").alias("legbyes"),
                 F.col("extras_noballs").alias("noballs"), F.col("extras_penalty").alias("penalty"),
                 F.col("extras_wides").alias("wides")).alias("extras"),
        F.struct(F.col("runs_batter").alias("batter"), F.col("runs_extras").alias("extras"),
                 F.col("runs_total").alias("total"), F.col("non_boundary")).alias("runs"),
        F.col("wickets"),
    )
    overs = d.groupBy("match_id", "innings_seq", "over_number").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("delivery_seq", ball.alias("b")))),
                    lambda s: s["b"]).alias("deliveries"))
    inn_attrs = d.groupBy("match_id", "innings_seq").agg(
        F.max("batting_team").alias("team"), F.max("innings_target_runs").alias("target_runs"),
        F.max("match_type").alias("match_type"))
    innings = (
        overs.groupBy("match_id", "innings_seq").agg(
            F.transform(F.array_sort(F.collect_list(F.struct("over_number", "deliveries"))),
                        lambda s: F.struct(s["over_number"].alias("over"), s["deliveries"].alias("deliveries")))
            .alias("overs"))
        .join(inn_attrs, ["match_id", "innings_seq"])
        .select("match_id", "innings_seq", F.struct(
            F.col("team"), F.col("overs"),
            F.when(F.col("match_type") != "Test", F.array(F.struct(
                F.lit(0.1).alias("from"), F.lit(5.6).alias("to"), F.lit("mandatory").alias("type"))))
            .alias("powerplays"),
            F.when(F.col("target_runs").isNotNull(), F.struct(
                F.lit(None).cast("double").alias("overs"), F.col("target_runs").cast("bigint").alias("runs")))
            .alias("target"),
        ).alias("inn"))
    )
    people = (d.select("match_id", F.col("batter").alias("n"), F.col("batter_id").alias("i"))
              .unionByName(d.select("match_id", F.col("bowler").alias("n"), F.col("bowler_id").alias("i")))
              .where(F.col("i").isNotNull()).distinct()
              .groupBy("match_id").agg(F.map_from_entries(F.collect_list(F.struct("n", "i"))).alias("people")))
    info = d.groupBy("match_id").agg(
        F.max("competition").alias("competition"), F.max("match_date").alias("match_date"),
        F.max("season").alias("season"), F.max("venue").alias("venue"), F.max("match_type").alias("match_type"),
        F.max("team_1").alias("team_1"), F.max("team_2").alias("team_2"),
        F.max("outcome_by_runs").alias("by_runs"), F.max("outcome_by_wickets").alias("by_wickets"),
        F.max("event_stage").alias("stage"))
    packed = innings.groupBy("match_id").agg(
        F.transform(F.array_sort(F.collect_list(F.struct("innings_seq", "inn"))), lambda s: s["inn"])
        .alias("innings"))
    return (
        info.join(people, "match_id", "left").join(packed, "match_id")
        .select("match_id", "competition", F.struct(
            F.array(F.col("match_date")).alias("dates"),
            F.struct(F.lit(None).cast("string").alias("name"), F.lit(None).cast("bigint").alias("match_number"),
                     F.lit(None).cast("string").alias("group"), F.col("stage")).alias("event"),
            F.lit("male").alias("gender"), F.col("match_type"),
            F.struct(F.lit(None).cast("string").alias("result"), F.lit(None).cast("string").alias("winner"),
                     F.struct(F.col("by_runs").cast("bigint").alias("runs"),
                              F.col("by_wickets").cast("bigint").alias("wickets")).alias("by")).alias("outcome"),
            F.col("season"), F.lit("club").alias("team_type"),
            F.array(F.col("team_1"), F.col("team_2")).alias("teams"),
            F.col("venue"),
            F.struct(F.col("people")).alias("registry"),
        ).alias("info"), "innings")
    )


def write_documents(docs: DataFrame, root: str) -> None:
    """One JSON document per file: ``root/competition=<c>/match_id=<id>/part-*.json``
    (each file holds exactly one match). Tasks put their files in place
    themselves; moved by the driver, they would go one after the other."""
    (docs.write.mode("overwrite").option("mapreduce.fileoutputcommitter.algorithm.version", "2")
     .partitionBy("competition", "match_id").json(root))
