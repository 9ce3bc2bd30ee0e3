"""Set-based table maintenance on Parquet.

There is no MERGE on plain Parquet, so every change is expressed as a
DataFrame that *is* the new table content and committed as a new
version directory (``<root>/v=<n>``) — a path that is being read is
never overwritten, readers of the old version are unaffected, and a
failed write leaves the previous version current.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def path_exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def any_file(spark: SparkSession, pattern: str) -> bool:
    """Whether a path pattern matches anything (file-system metadata only)."""
    fs, p = _fs(spark, pattern)
    return bool(fs.globStatus(p))


def partition_folder(value: str) -> str:
    """A partition value as Spark names its folder: characters that a path
    cannot hold are percent-encoded."""
    kept = "".join(f"%{ord(c):02X}" if c in '"#%\'*/:=?\\{[]^' or ord(c) < 32 or ord(c) == 127 else c for c in value)
    return kept or "__HIVE_DEFAULT_PARTITION__"


def move_folder(spark: SparkSession, source: str, target: str) -> None:
    """Rename a folder, its new parents made first; a missing one is none to
    move."""
    fs, a = _fs(spark, source)
    b = _fs(spark, target)[1]
    if fs.exists(a):
        fs.mkdirs(b.getParent())
        if not fs.rename(a, b):
            raise OSError(f"cannot move {source} to {target}")


def remove_folder(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def write_counted(df: DataFrame, path: str, mode: str = "overwrite", partition_by: Sequence[str] = (),
                  fmt: str = "parquet") -> int:
    """Write and report the row count from an ``Observation`` taken
    during the write (no second pass over the plan)."""
    obs = Observation("write_counted")
    w = df.observe(obs, F.count(F.lit(1)).alias("rows")).write.mode(mode)
    if partition_by:
        w = w.partitionBy(*partition_by)
    w.format(fmt).save(path)
    return int(obs.get.get("rows", 0))


class VersionedTable:
    """A Parquet table as numbered immutable versions under ``root``."""

    def __init__(self, spark: SparkSession, root: str):
        self.spark = spark
        self.root = root.rstrip("/")

    def versions(self) -> list[int]:
        if not path_exists(self.spark, self.root):
            return []
        fs, p = _fs(self.spark, self.root)
        out = []
        for st in fs.listStatus(p):
            name = st.getPath().getName()
            if name.startswith("v=") and path_exists(self.spark, f"{self.root}/{name}/_SUCCESS"):
                out.append(int(name[2:]))
        return sorted(out)

    def exists(self) -> bool:
        return bool(self.versions())

    def read(self, version: int | None = None, merge_schema: bool = False) -> DataFrame:
        v = version if version is not None else self.versions()[-1]
        return self.spark.read.option("mergeSchema", str(merge_schema).lower()).parquet(f"{self.root}/v={v}")

    def commit(self, df: DataFrame, partition_by: Sequence[str] = ()) -> int:
        """Write ``df`` as the next version; returns the row count."""
        v = (self.versions() or [0])[-1] + 1
        return write_counted(df, f"{self.root}/v={v}", partition_by=partition_by)


def ensure_database(spark: SparkSession, name: str) -> None:
    """CREATE DATABASE IF NOT EXISTS."""
    spark.sql(f"CREATE DATABASE IF NOT EXISTS `{name}`")


def with_not_null(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """NOT NULL enforced lazily — a NULL in any listed column fails
    the job that writes (or reads) the frame, naming the column."""
    out = df
    for col in columns:
        out = out.withColumn(col, F.when(F.col(col).isNull(),
                                         F.raise_error(F.lit(f"NULL in NOT NULL column {col}")))
                             .otherwise(F.col(col)))
    return out


# ------------------------------------------------------------------ rewrites (new content)

def upsert(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Update all columns of matching keys, insert the rest
    (idempotent: applying the same source twice gives the same table).
    Source columns missing in the target are added (schema evolution)."""
    src = source.dropDuplicates(list(keys))
    return target.join(src.select(*keys), list(keys), "left_anti").unionByName(src, allowMissingColumns=True)


def insert_absent(target: DataFrame, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """ON CONFLICT DO NOTHING — only source keys absent in target."""
    new = source.join(target.select(*keys).distinct(), list(keys), "left_anti")
    return target.unionByName(new, allowMissingColumns=True)


def append_new(target: DataFrame | None, source: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The rows of ``source`` not yet in ``target`` (to append)."""
    src = source.dropDuplicates(list(keys))
    return src if target is None else src.join(target.select(*keys).distinct(), list(keys), "left_anti")


def flip_current(table: DataFrame, new_rows: DataFrame, flag: str = "is_current") -> DataFrame:
    """Mark every existing row not current, add the new rows as current."""
    return (table.withColumn(flag, F.lit(False))
            .unionByName(new_rows.withColumn(flag, F.lit(True)), allowMissingColumns=True))


def needs_backfill(df: DataFrame, key_col: str) -> bool:
    """S20 guard: column missing, or at least one NULL (bounded probe)."""
    return key_col not in df.columns or df.where(F.col(key_col).isNull()).limit(1).count() > 0


def backfill_key(df: DataFrame, key_col: str, expr: Column) -> DataFrame:
    """Fill only missing keys (adds the column when absent)."""
    if key_col not in df.columns:
        return df.withColumn(key_col, expr)
    return df.withColumn(key_col, F.coalesce(F.col(key_col), expr))


def add_column_backfill(df: DataFrame, column: str, mapping: DataFrame, key: str,
                        value_col: str | None = None) -> DataFrame:
    """ADD COLUMN IF NOT EXISTS + keyed UPDATE: left join the mapping
    and keep existing values where present."""
    v = value_col or column
    m = mapping.select(key, F.col(v).alias("_new"))
    out = df if column in df.columns else df.withColumn(column, F.lit(None).cast(mapping.schema[v].dataType))
    return out.join(m, key, "left").withColumn(column, F.coalesce(F.col(column), F.col("_new"))).drop("_new")


def upsert_case_folded(target: DataFrame, source: DataFrame, key_cols: Sequence[str],
                       fold_cols: Sequence[str], id_col: str | None = None) -> tuple[DataFrame, DataFrame]:
    """UPDATE-or-INSERT (never DELETE) on a composite key where
    ``fold_cols`` compare case-insensitively. Returns the new table and a
    one-row (inserted, updated) count frame."""
    def keyed(df):
        out = df
        for c in key_cols:
            out = out.withColumn(f"_k_{c}", F.lower(F.col(c)) if c in fold_cols else F.col(c))
        return out
    kcols = [f"_k_{c}" for c in key_cols]
    t, s = keyed(target), keyed(source).dropDuplicates([f"_k_{c}" for c in key_cols])
    matched = s.join(t.select(*kcols, *([id_col] if id_col else [])), kcols, "left_semi")
    inserted = s.join(t.select(*kcols), kcols, "left_anti")
    kept = t.join(s.select(*kcols), kcols, "left_anti")
    if id_col:
        ids = t.select(*kcols, id_col)
        matched = matched.drop(id_col) if id_col in matched.columns else matched
        matched = matched.join(ids, kcols, "left")
    new_table = kept.unionByName(matched, allowMissingColumns=True).unionByName(inserted, allowMissingColumns=True)
    return new_table.drop(*kcols), _counts(inserted, matched)


def _counts(inserted: DataFrame, updated: DataFrame) -> DataFrame:
    n_ins = inserted.agg(F.count("*").alias("n")).scalar()
    n_upd = updated.agg(F.count("*").alias("n")).scalar()
    return inserted.sparkSession.range(1).select(n_ins.alias("inserted"), n_upd.alias("updated"))


def snapshot_diff(old: DataFrame, new: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Change feed between two snapshots — full outer join on the key,
    rows compared as whole structs (null-safe, exact); emits insert /
    update / delete rows (new image for insert/update, old image for
    delete)."""
    cols = [c for c in new.columns if c not in keys]

    def imaged(df, tag):
        return df.select(*keys, F.lit(True).alias(f"_in_{tag}"),
                         F.struct(*[F.col(c) for c in cols]).alias(f"_r_{tag}"))
    j = imaged(old, "o").join(imaged(new, "n"), list(keys), "full_outer")
    change = (F.when(F.col("_in_o").isNull(), F.lit("insert"))
              .when(F.col("_in_n").isNull(), F.lit("delete"))
              .when(~F.col("_r_o").eqNullSafe(F.col("_r_n")), F.lit("update")))
    img = F.when(F.col("_in_n").isNull(), F.col("_r_o")).otherwise(F.col("_r_n"))
    return (j.withColumn("change_type", change).where(F.col("change_type").isNotNull())
            .select(*keys, "change_type", img.alias("_img")).select(*keys, "change_type", "_img.*"))


def replace_partition(df: DataFrame, path: str, partition_col: str, values: Sequence = ()) -> int:
    """Overwrite only the partitions present in ``df`` (dynamic
    partition overwrite on a path); other partitions stay untouched. Of the
    replaced partition ``values``, those without rows in ``df`` are emptied."""
    present = {r[0] for r in df.select(partition_col).distinct().collect()} if values else set()
    obs = Observation("replace_partition")
    (df.observe(obs, F.count(F.lit(1)).alias("rows")).write.mode("overwrite")
     .option("partitionOverwriteMode", "dynamic").partitionBy(partition_col).parquet(path))
    utils = df.sparkSession.sparkContext._jvm.org.apache.spark.sql.catalyst.catalog.ExternalCatalogUtils
    for value in set(values) - present:
        name = utils.getPartitionPathString(partition_col, None if value is None else str(value))
        fs, folder = _fs(df.sparkSession, f"{path.rstrip('/')}/{name}")
        fs.delete(folder, True)
    return int(obs.get.get("rows", 0))


# ------------------------------------------------------------------ S16 / S17

def partition_values(df: DataFrame, col: str) -> DataFrame:
    """Distinct partition values present in a table."""
    return df.select(col).distinct()


def file_manifest(spark: SparkSession, path: str, group_pattern: str) -> DataFrame:
    """Per-group source signature from file metadata only
    (``binaryFile`` with the content column pruned): file count, bytes,
    latest modification, and an order-independent hash (sum of per-file
    xxhash64, in decimals that cannot overflow) — mergeable, no file list
    is collected."""
    files = spark.read.format("binaryFile").load(path).select("path", "length", "modificationTime")
    return (files.withColumn("group", F.regexp_extract("path", group_pattern, 1))
            .groupBy("group").agg(
                F.count("*").alias("files"), F.sum("length").alias("bytes"),
                F.max("modificationTime").alias("last_modified"),
                F.sum(F.xxhash64("path", "length", "modificationTime").cast("decimal(38,0)")).alias("signature")))


def groups_to_rebuild(current: DataFrame, stored: DataFrame | None, present: DataFrame | None = None,
                      force: bool = False) -> DataFrame:
    """A group is rebuilt when forced, when its signature
    changed or is new, or when its partition is missing from the target."""
    if force or stored is None:
        return current.select("group")
    changed = current.join(stored.select("group", "signature"), ["group", "signature"], "left_anti").select("group")
    if present is not None:
        changed = changed.unionByName(current.select("group").join(present.select("group"), "group", "left_anti"))
    return changed.distinct()
