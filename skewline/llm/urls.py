"""URL filter: host and path rules first, gradient-boosted trees on lexical features else.

The trees learn from the URLs that a rule decides (at most about ``TRAIN_ROWS`` distinct ones,
weighted by how often they occur and drawn by a hash; a documented bound) and judge those
that no rule fits.  Features
are lengths, depth, digit ratio, entropy, parameter counts and statistics of the host's
last label, counted over all URLs in ``SUFFIX_BUCKETS`` hash buckets (a fixed-size table); a
URL that is learned from gets its suffix's statistics from the other half of the URLs.

Defined results: a null URL or one without ``://`` has an empty host and path, fits no
rule, and is judged by the trees from its text (null: empty); repeated rows are judged
alike; without any rule-decided URL the trees score 0.5, which blocks; an empty table
gives no rows; columns other than page_id and url are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from skewline.llm import gbdt
from skewline.llm.arrowtext import byte_slices, text_bytes
from skewline.llm.common import draw

# (verdict, host, path)
RULES = (("allow", "com", "/"), ("block", "example.com", "/en/"), ("allow", "www.example.com", "/en/"),
         ("block", "net", "/es/"), ("block", "net", "/fr/"))
TRAIN_ROWS = 40_000
SUFFIX_BUCKETS = 1024


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """struct(rule, verdict) of the longest rule that fits, null if none does."""
    out = F.lit(None)
    for verdict, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def _count(mask: np.ndarray, offs: np.ndarray) -> np.ndarray:
    c = np.concatenate([[0], np.cumsum(mask, dtype=np.int64)])
    return (c[offs[1:]] - c[offs[:-1]]).astype(float)


def lexical(urls: pa.Array, hosts: pa.Array, paths: pa.Array) -> np.ndarray:
    """Lexical features of each URL, without its suffix statistics."""
    columns = []
    for col in (urls, hosts, paths):
        data, offs = text_bytes(col)
        n, size = len(col), np.diff(offs).astype(float)
        doc = np.repeat(np.arange(n), np.diff(offs))
        digit, letter = (data >= 48) & (data < 58), ((data | 32) >= 97) & ((data | 32) < 123)
        vowel = np.isin(data | 32, np.frombuffer(b"aeiou", np.uint8))
        share = lambda m: np.divide(_count(m, offs), size, out=np.zeros(n), where=size > 0)  # noqa: B023,E731
        # Entropy of the bytes: size * log(size) - sum(count * log(count)), over size.
        key, count = np.unique(doc * 256 + data, return_counts=True)
        spent = np.bincount(key >> 8, count * np.log(count), n)[:n] if len(key) else np.zeros(n)
        entropy = np.divide(size * np.log(np.maximum(size, 1)) - spent, size, out=np.zeros(n), where=size > 0)
        columns += [size, share(digit), share(letter), share(vowel), entropy, _count(data == ord("-"), offs), _count(data == ord("."), offs)]
        if col is urls:
            columns += [_count(data == ord(c), offs) for c in "/?&=#%@_"]
        elif col is paths:
            columns += [_count(data == ord("/"), offs), _count(digit, offs)]
    return np.stack(columns, 1)


def suffix_bucket(host: Column) -> Column:
    return (F.crc32(F.element_at(F.split(host, r"\."), -1).cast("binary")) % SUFFIX_BUCKETS).cast("int")


def suffix_statistics(urls: DataFrame) -> np.ndarray:
    """(2, SUFFIX_BUCKETS, 3): URLs in a bucket, those a rule decides, and those it blocks, for either half of the
    URLs.  At most twice SUFFIX_BUCKETS rows reach the driver."""
    out = np.zeros((2, SUFFIX_BUCKETS, 3))
    rows = urls.groupBy("half", "suffix").agg(F.count(F.lit(1)).alias("n"), F.count("decided").alias("known"),
                                      F.sum((F.col("decided") == "block").cast("long")).alias("blocked"))
    for r in rows.collect():
        out[r.half, r.suffix] = r.n, r.known, r.blocked or 0
    return out


def suffix_features(stats: np.ndarray, suffix: np.ndarray, half: np.ndarray | None = None) -> np.ndarray:
    """Log of a suffix's URLs and its smoothed share blocked: of all URLs, or of twice those outside ``half``."""
    n, known, blocked = (stats.sum(0)[suffix] if half is None else 2 * stats[1 - half, suffix]).T
    return np.stack([np.log1p(n), (blocked + 1) / (known + 2)], 1)


def judge(pages: DataFrame, rules=RULES, train_rows: int = TRAIN_ROWS) -> DataFrame:
    """page_id, host, path, rule and verdict of every row, with the trees' score (likeness
    to blocked URLs)."""
    host, path = host_and_path(F.col("url"))
    urls = (pages.select("page_id", F.col("url").cast("string").alias("url")).withColumns({"host": host, "path": path})
            .withColumn("fit", rule_of(F.col("host"), F.col("path"), rules))
            .select("page_id", "url", "host", "path", F.col("fit.rule").alias("rule"), F.col("fit.verdict").alias("decided"),
                    suffix_bucket(F.col("host")).alias("suffix"),
                    F.coalesce(F.crc32(F.col("url").cast("binary")) % 2, F.lit(0)).cast("int").alias("half")))
    stats = suffix_statistics(urls)

    def features(batch: pa.RecordBatch, crossed: bool = False) -> np.ndarray:
        url, host, path, suffix, half = (batch.column(batch.schema.get_field_index(c)) for c in ("url", "host", "path", "suffix", "half"))
        own = half.to_numpy(zero_copy_only=False) if crossed else None
        return np.concatenate([lexical(url, host, path), suffix_features(stats, suffix.to_numpy(zero_copy_only=False), own)], 1)

    got = (draw(urls.where(F.col("decided").isNotNull()).select("url", "host", "path", "suffix", "half", "decided"), train_rows)
           .toArrow().sort_by("place").combine_chunks())
    weight, y = got["weight"].to_numpy(), np.array([d == "block" for d in got["decided"].to_pylist()], float)
    x = features(got.to_batches()[0], crossed=True) if got.num_rows else np.zeros((0, 1))
    model = gbdt.fit(x, y, weight)
    names = ["page_id", "host", "path", "rule", "decided"]

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in byte_slices(batch, "url"):
                score = gbdt.predict(model, features(part))
                columns = [part.column(part.schema.get_field_index(c)) for c in names]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(score)], names=[*names, "score"])

    return (urls.mapInArrow(tasks, urls.select(*names).schema.add("score", "double"))
            .select("page_id", "host", "path", "rule",
                    F.coalesce("decided", F.when(F.col("score") >= 0.5, "block").otherwise("allow")).alias("verdict"), "score"))
