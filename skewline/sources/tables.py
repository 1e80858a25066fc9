"""Table catalog (S1) and keyed writes.

Tables are parquet folders partitioned by month of ``date`` (progress, which has no date,
by a hash of its key).  A write puts the partitions it touches into a new batch folder,

    <table>/data/batch=<id>/part=<month>/...   and, when that is complete,
    <table>/_current/<number>.json              partition -> batch, one file a version,

so readers see all of a batch or nothing of it, whatever is interrupted.  A version's file is
made by one rename that fails if the file exists: of two writers that started from the same
version the second is refused.  Versions of two commits ago are deleted.
"""

from __future__ import annotations

import json
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from skewline.session import whole_groups

D, S, X, I = T.DoubleType(), T.StringType(), T.DateType(), T.IntegerType()


def _schema(*fields) -> T.StructType:
    return T.StructType([T.StructField(n, t, nullable) for n, t, nullable in fields])


# The seven tables, keys first.
SCHEMAS: dict[str, T.StructType] = {
    "options_daily": _schema(("date", X, False), ("ticker", S, False), ("underlying", S, False), ("strike", D, False),
                             ("expiry", X, False), ("contract_type", S, False), ("open", D, True), ("high", D, True),
                             ("low", D, True), ("close", D, True), ("volume", D, True), ("vwap", D, True),
                             ("transactions", I, True), ("mid_price", D, True), ("iv_computed", D, True),
                             ("delta", D, True), ("gamma", D, True)),
    "stock_daily": _schema(("date", X, False), ("ticker", S, False), ("open", D, True), ("high", D, True),
                           ("low", D, True), ("close", D, True), ("volume", D, True), ("realized_vol_20d", D, True),
                           ("ewma_var", D, True)),
    "market_daily": _schema(("date", X, False), ("vix", D, True), ("vix3m", D, True), ("hy_oas", D, True),
                            ("t_bill_3m", D, True), ("dspx", D, True), ("cor1m", D, True)),
    "features_daily": _schema(("date", X, False), ("ticker", S, False), *[(c, D, True) for c in (
        "iv_atm_30dte", "iv_pct_rank_252d", "iv_minus_ewma_rv", "z_iv_minus_ewma_rv", "skew_pct_rank_252d",
        "term_structure_60_30", "z_call_put_volume_ratio", "z_5d_return", "vix_level", "z_vix_3d_change",
        "vix3m_level", "z_hy_oas_5d_change", "dspx_level", "cor1m_level", "z_realized_vol_20d", "cw_iv_spread",
        "call_put_volume_ratio", "skew_25d")]),
    "signals": _schema(("date", X, False), ("ticker", S, False), ("activity_score", D, True),
                       ("p_magnitude", D, True), ("p_up", D, True), ("signal", S, True), ("confidence", S, True),
                       ("threshold_pct", D, True), ("top_features", T.ArrayType(S), True),
                       ("leakage_caveats", T.ArrayType(S), True)),
    "backfill_progress": _schema(("ticker", S, False), ("contract_ticker", S, False), ("last_date", X, True)),
    "pull_log": _schema(("pulled_at", T.TimestampNTZType(), False), ("url", S, False), ("status_code", I, True),
                        ("elapsed_ms", D, True)),
}
KEYS = {"options_daily": ("date", "ticker"), "stock_daily": ("date", "ticker"), "market_daily": ("date",),
        "features_daily": ("date", "ticker"), "signals": ("date", "ticker"),
        "backfill_progress": ("ticker", "contract_ticker"), "pull_log": ()}


PART = "part"
PROGRESS_SHARDS = 16


def part_of(name: str) -> Column:
    """The partition a row belongs to: its month, or a shard of its key."""
    if "date" in KEYS[name]:
        return F.date_format("date", "yyyy-MM")
    return F.format_string("s%02d", F.pmod(F.xxhash64(*KEYS[name]), F.lit(PROGRESS_SHARDS)))


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


class ConcurrentWrite(RuntimeError):
    """Another writer has committed since this one read the table."""


class Versions:
    """The committed versions of one table folder."""

    def __init__(self, spark: SparkSession, path: str):
        self.jvm, self.path = spark._jvm, path
        self.conf = spark.sparkContext._jsc.hadoopConfiguration()
        self.fs = self._path(path).getFileSystem(self.conf)

    def _path(self, name: str):
        return self.jvm.org.apache.hadoop.fs.Path(name)

    def numbers(self) -> list[int]:
        folder = self._path(f"{self.path}/_current")
        if not self.fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in self.fs.listStatus(folder)]
        return sorted(int(n.split(".")[0]) for n in names if n.endswith(".json") and n[0].isdigit())

    def read(self, number: int | None = None) -> tuple[int, dict[str, str]]:
        """(number, partition -> batch) of a version, by default the latest; (0, {}) before the first."""
        if number is None:
            number = max(self.numbers(), default=0)
        if not number:
            return 0, {}
        stream = self.fs.open(self._path(f"{self.path}/_current/{number:08d}.json"))
        try:
            return number, json.loads(self.jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
        finally:
            stream.close()

    def commit(self, after: int, batches: dict[str, str]) -> None:
        """Make a version visible that follows version ``after``."""
        name = f"{self.path}/_current/{after + 1:08d}.json"
        draft = self._path(f"{self.path}/_current/.{uuid.uuid4().hex}")
        out = self.fs.create(draft, True)
        out.write(bytearray(json.dumps(batches), "utf-8"))
        out.close()
        options = self.jvm.org.apache.hadoop.fs.Options.Rename
        none = self.jvm.java.lang.reflect.Array.newInstance(options.NONE.getClass(), 0)
        context = self.jvm.org.apache.hadoop.fs.FileContext.getFileContext(draft.toUri() if draft.toUri().getScheme() else self.fs.getUri(), self.conf)
        try:
            context.rename(draft, self._path(name), none)
        except Exception as e:
            self.fs.delete(draft, False)
            raise ConcurrentWrite(f"{name} has been committed by another writer") from e

    def drop_before(self, number: int) -> None:
        """Delete the versions before ``number`` and the partitions that only they name."""
        kept = {(p, b) for n in self.numbers() if n >= number for p, b in self.read(n)[1].items()}
        for n in self.numbers():
            if n < number:
                for p, b in self.read(n)[1].items():
                    if (p, b) not in kept:
                        self.fs.delete(self._path(f"{self.path}/data/batch={b}/{PART}={p}"), True)
                self.fs.delete(self._path(f"{self.path}/_current/{n:08d}.json"), False)


def read_table(spark: SparkSession, root: str, name: str, parts: list[str] | None = None, version: int | None = None) -> DataFrame:
    """A table by name, or only some of its partitions; an empty typed frame when nothing has
    been committed yet (any other failure to read it is an error).  ``version`` reads an earlier commit
    that is still there."""
    path, names = f"{root}/{name}", SCHEMAS[name].fieldNames()
    if not exists(spark, path):
        return spark.createDataFrame([], SCHEMAS[name])
    if not KEYS[name]:
        return spark.read.schema(SCHEMAS[name]).parquet(path)
    number, batches = Versions(spark, path).read(version)
    plain = number == 0 and not exists(spark, f"{path}/data")  # a folder of partitions that another tool wrote
    schema = T.StructType([*SCHEMAS[name].fields, T.StructField(PART, S)])
    if plain:
        stored = spark.read.schema(schema).parquet(path)
    else:
        wanted = [f"{path}/data/batch={b}/{PART}={p}" for p, b in sorted(batches.items()) if parts is None or p in parts]
        if not wanted:
            return spark.createDataFrame([], SCHEMAS[name])
        stored = spark.read.schema(schema).option("basePath", f"{path}/data").parquet(*wanted)
    return (stored if parts is None else stored.where(F.col(PART).isin(parts))).select(*names)


def conform(df: DataFrame, name: str) -> DataFrame:
    """Align a frame to a table schema by name (missing columns NULL, extra dropped)."""
    return df.select(*[(F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
                       for f in SCHEMAS[name].fields])


# --------------------------------------------------------------------------- S9


def last_wins(df: DataFrame, keys, order: list[Column]) -> DataFrame:
    """One row per key, the one ordered first by ``order`` (e.g. load sequence desc)."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("_rk", F.row_number().over(w)).where(F.col("_rk") == 1).drop("_rk")


def upsert(base: DataFrame, updates: DataFrame, keys, newest=()) -> DataFrame:
    """S9 (INSERT OR REPLACE): rows of ``updates`` replace base rows with the same key.

    Among updates of one key the greatest ``newest`` columns (load time, position in the
    payload; columns of ``updates`` only) win, and equal ones are told apart by their values,
    so the result never depends on row order."""
    values = [c for c in base.columns if c not in keys]
    rows = base.withColumn("_seq", F.lit(0)).unionByName(updates.withColumn("_seq", F.lit(1)), allowMissingColumns=True)
    order = [F.col("_seq").desc(), *[F.col(c).desc_nulls_last() for c in newest], *[F.col(c).desc_nulls_last() for c in values]]
    return last_wins(rows, keys, order).select(*base.columns)


def upsert_partitions(spark: SparkSession, root: str, name: str, updates: DataFrame, newest=(),
                      rows_per_file: int = 1_000_000) -> None:
    """Persisted S9: rewrite only the partitions touched by ``updates``.

    Reads the touched partitions (others are not listed), upserts them into a new batch folder
    and commits.  A partition of many rows is dealt by key to as many tasks as it fills files.
    Idempotent: replaying a batch leaves the table unchanged."""
    keys, columns = KEYS[name], SCHEMAS[name].fieldNames()
    extra = [c for c in newest if c in updates.columns and c not in columns]
    upd = conform(updates, name).select(*columns) if not extra else updates.select(
        *[(F.col(f.name) if f.name in updates.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in SCHEMAS[name].fields], *extra)
    versions = Versions(spark, f"{root}/{name}")
    number, batches = versions.read()
    # Calendar months (or shards) of one batch: a handful of strings.
    new = {r[0]: r[1] for r in upd.groupBy(part_of(name)).count().collect()}
    if not new:
        return
    old = read_table(spark, root, name, list(new))
    most = max((r[1] + new[r[0]] for r in old.groupBy(part_of(name)).count().collect()), default=max(new.values()))
    batch = f"{number + 1:08d}-{uuid.uuid4().hex[:8]}"
    merged = upsert(old, upd, keys, newest).withColumn(PART, part_of(name))
    with whole_groups(spark):
        (merged.repartition(PART, F.pmod(F.xxhash64(*keys), F.lit(-(-max(most, *new.values()) // rows_per_file))))
         .write.partitionBy(PART).parquet(f"{root}/{name}/data/batch={batch}"))
    versions.commit(number, {**batches, **dict.fromkeys(new, batch)})
    versions.drop_before(number)


def advance_progress(spark: SparkSession, root: str, rows: DataFrame) -> None:
    """The last date ingested of every contract in ``rows`` (options_daily) moves forward."""
    new = rows.groupBy(F.col("underlying").alias("ticker"), F.col("ticker").alias("contract_ticker")).agg(F.max("date").alias("last_date"))
    parts = [r[0] for r in new.select(part_of("backfill_progress")).distinct().collect()]
    old = read_table(spark, root, "backfill_progress", parts)
    both = new.unionByName(old).groupBy("ticker", "contract_ticker").agg(F.max("last_date").alias("last_date"))
    upsert_partitions(spark, root, "backfill_progress", both.join(new.select("ticker", "contract_ticker"), ["ticker", "contract_ticker"], "left_semi"))


# --------------------------------------------------------------------------- S10


def update_from(base: DataFrame, updates: DataFrame, keys, cols) -> DataFrame:
    """S10 (UPDATE ... FROM): matched rows take the update's values - a NULL in the update
    overwrites; unmatched rows keep theirs.  Of several updates of one key the one with the greatest
    values counts, so rows never multiply."""
    updates = last_wins(updates, keys, [F.col(c).desc_nulls_last() for c in cols])
    u = updates.select(*keys, *[F.col(c).alias(f"_u_{c}") for c in cols]).withColumn("_hit", F.lit(True))
    j = base.join(u, list(keys), "left")
    out = [F.when(F.col("_hit"), F.col(f"_u_{c}")).otherwise(F.col(c)).alias(c) if c in cols else F.col(c)
           for c in base.columns]
    return j.select(*out)


# --------------------------------------------------------------------------- S11, S12


def request_log_rows(requests: DataFrame, redact, url_chars: int | None = None) -> DataFrame:
    """pull_log rows: redacted URL, on demand cut to ``url_chars`` characters."""
    url = redact(F.col("url"))
    return requests.select(F.col("pulled_at"), (url if url_chars is None else F.left(url, F.lit(url_chars))).alias("url"),
                           F.col("status_code").cast("int").alias("status_code"),
                           F.col("elapsed_ms").cast("double").alias("elapsed_ms"))


def append_request_log(rows: DataFrame, root: str) -> None:
    conform(rows, "pull_log").write.mode("append").parquet(f"{root}/pull_log")


def backfill_worklist(contracts: DataFrame, progress: DataFrame, end) -> DataFrame:
    """Contracts still to pull: those without progress reaching ``end``."""
    done = progress.where(F.col("last_date") >= F.lit(end).cast("date")).select("ticker", "contract_ticker")
    return contracts.join(done, ["ticker", "contract_ticker"], "left_anti")
