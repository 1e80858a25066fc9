"""Helpers shared by the corpus operators: table access, bounded draws and stored intermediates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from skewline.session import shared_path


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_DRAW = 1 << 30
FEW_KINDS = 10_000


def draw(rows: DataFrame, limit: int) -> DataFrame:
    """The distinct rows of ``rows`` with ``weight``, how often each occurs, and ``place``, a hash
    of the row.  If there are more than about ``limit`` of them, ``place`` chooses: equal
    rows are one, so no frequent row or key can fill the draw."""
    place = F.xxhash64(F.lit("draw"), *rows.columns)
    n = rows.agg(F.approx_count_distinct(place, 0.02).alias("n")).first().n
    share = min(1.0, 0.9 * limit / max(1, n))
    some = rows if share == 1 else rows.where(F.pmod(place, F.lit(_DRAW)) < int(_DRAW * share))
    return some.groupBy(*rows.columns).agg(F.count(F.lit(1)).alias("weight")).withColumn("place", place)


def draw_windows(rows: DataFrame, limit: int, chars: int, by: str) -> DataFrame:
    """(by, window): distinct pieces of at most ``chars`` code points of the column ``text``, about
    ``limit`` in all and equally many for each value of ``by``, two at least.  Texts are cut from
    end to end, and every piece of every distinct text can be drawn, by a hash of text and place."""
    rows = rows.select(by, "text").where(F.length("text") > 0)
    pieces = F.ceil(F.length("text") / chars)
    totals = (rows.select(by, F.xxhash64("text"), pieces.alias("pieces")).distinct()
              .groupBy(by).agg(F.sum("pieces").alias("pieces")))
    kinds = totals.count()
    each = max(2, limit // max(1, kinds))
    shares = totals.select(F.col(by).alias("_by"), (F.lit(float(_DRAW)) * each / F.col("pieces")).alias("_share"))

    def chosen(text_hash):
        places = F.filter(F.sequence(F.lit(0).cast("long"), pieces - 1),
                          lambda i: F.pmod(F.xxhash64(F.lit("window"), text_hash, i), F.lit(_DRAW)) < F.col("_share"))
        return F.transform(places, lambda i: F.substring("text", (i * chars + 1).cast("int"), F.lit(chars)))

    # One short row a value of ``by``: broadcast while they are few, so that no text moves; else joined.
    shares = F.broadcast(shares) if kinds <= FEW_KINDS else shares
    # The array of one binds the text's hash, worked out once a text.
    return (rows.join(shares, F.col(by) == F.col("_by"))
            .select(by, F.explode(F.flatten(F.transform(F.array(F.xxhash64("text")), chosen))).alias("window")).distinct())


class Scratch:
    """Intermediate tables in the shared checkpoint folder, deleted once nothing reads them."""

    def __init__(self, spark: SparkSession, name: str):
        self.spark = spark
        self.name = name

    def store(self, df: DataFrame) -> DataFrame:
        """Write ``df`` and return its scan (with ``.stored_at``): computed once, its
        lineage cut, and safe from lost executors."""
        path = shared_path(self.spark, f"llm-{self.name}")
        df.write.parquet(path)
        out = self.spark.read.parquet(path)
        out.stored_at = path
        return out

    def drop(self, *frames: DataFrame) -> None:
        jvm, conf = self.spark._jvm, self.spark.sparkContext._jsc.hadoopConfiguration()
        for df in frames:
            p = jvm.org.apache.hadoop.fs.Path(df.stored_at)
            p.getFileSystem(conf).delete(p, True)
