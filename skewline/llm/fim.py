"""Fill-in-middle transformation by repeated captures.

A text is a run of units: white space with the word after it, or trailing white space.
One ``regex`` fullmatch of ``(unit)*`` keeps every repetition of its group, so ``ends(1)``
of the match gives the number of units and every place where the text may be cut.  Draws
from a hash of doc_id choose the two cuts and the form; Spark builds the output from them.

Defined results: a null text is empty; an empty text and one that holds a sentinel stay
plain; a null doc_id draws as the word ``null``; repeated rows are transformed alike; an
empty table gives no rows; only doc_id and text are read, so other columns may clash.
A match keeps some 300 bytes a unit and the library ends one at 1 GiB, so a text of more
than ``UNITS_AT_ONCE`` code points is matched in runs of at most that many units.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

UNIT = r"[\x20\x09-\x0D]*+[^\x20\x09-\x0D]++|[\x20\x09-\x0D]++"
UNITS_AT_ONCE = 1 << 19
PREFIX, SUFFIX, MIDDLE = "<P>", "<S>", "<M>"
SEED = 42
RATE, SPM_SHARE = 50, 80  # per cent

_COLUMNS = "doc_id long, text string, n long, cut long, stop long"
_ARROW = pa.schema([("doc_id", pa.int64()), ("text", pa.string()), ("n", pa.int64()), ("cut", pa.int64()), ("stop", pa.int64())])
_PATTERNS: dict[int, tuple] = {}


def unit_ends(text: str, at_once: int = UNITS_AT_ONCE) -> list[int]:
    """Where each unit of ``text`` ends."""
    import regex

    if at_once not in _PATTERNS:
        _PATTERNS[at_once] = regex.compile(f"({UNIT})*+"), regex.compile(f"({UNIT}){{1,{at_once}}}+")
    whole, run = _PATTERNS[at_once]
    if len(text) <= at_once:
        return whole.fullmatch(text).ends(1)
    ends: list[int] = []
    while not ends or ends[-1] < len(text):
        ends += run.match(text, ends[-1] if ends else 0).ends(1)
    return ends


def draws(doc_id: Column, seed: int = SEED) -> list[Column]:
    """Four unsigned 32-bit draws of a document."""
    digest = F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("null"))), 256)
    return [F.conv(F.substring(digest, 8 * k + 1, 8), 16, 10).cast("long") for k in range(4)]


def cut_texts(docs: DataFrame, seed: int = SEED) -> DataFrame:
    """doc_id, text, number of units, and the code points before the end of the prefix and of the middle."""
    first, second, *_ = draws(F.col("doc_id"), seed)

    def tasks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text, a, b in zip(batch.column(1), batch.column(2).to_pylist(), batch.column(3).to_pylist()):
                ends = [0, *unit_ends(text.as_py())]
                n = len(ends) - 1
                a, b = sorted((a % (n + 1), b % (n + 1)))
                rows.append((n, ends[a], ends[b]))
            numbers = [pa.array(c, pa.int64()) for c in zip(*rows)] or [pa.array([], pa.int64())] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1).cast(pa.string()), *numbers], schema=_ARROW)

    return (docs.select(F.col("doc_id").cast("long"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
                        first.alias("first"), second.alias("second")).mapInArrow(tasks, _COLUMNS))


def transform(docs: DataFrame, rate: int = RATE, spm_share: int = SPM_SHARE, seed: int = SEED) -> DataFrame:
    """doc_id, n, form (plain, psm or spm), prefix_chars, middle_chars and the output text.
    About ``rate`` per cent of the documents change form, ``spm_share`` per cent of them to spm."""
    *_, third, fourth = draws(F.col("doc_id"), seed)
    text = F.col("text")
    sentinel = text.contains(PREFIX) | text.contains(SUFFIX) | text.contains(MIDDLE)
    form = (F.when((text == "") | sentinel | (third % 100 >= rate), "plain")
            .when(fourth % 100 < spm_share, "spm").otherwise("psm"))
    prefix = F.substring(text, F.lit(1), F.col("cut").cast("int"))
    middle = F.substring(text, F.col("cut").cast("int") + 1, F.col("middle").cast("int"))
    suffix = F.substring(text, F.col("stop").cast("int") + 1, F.length(text))
    p, s, m = F.lit(PREFIX), F.lit(SUFFIX), F.lit(MIDDLE)
    output = (F.when(F.col("form") == "plain", text)
              .when(F.col("form") == "psm", F.concat(p, prefix, s, suffix, m, middle))
              .otherwise(F.concat(s, suffix, p, prefix, m, middle)))
    cut = F.col("form") != "plain"
    return (cut_texts(docs, seed).withColumn("form", form).withColumn("middle", F.col("stop") - F.col("cut"))
            .select("doc_id", "n", "form", F.when(cut, F.col("cut")).alias("prefix_chars"),
                    F.when(cut, F.col("middle")).alias("middle_chars"), output.alias("output")))


def restore(output: Column, form: Column) -> Column:
    """The text that ``output`` was made from.  A text with a sentinel stays plain, so the first
    sentinel of each kind after the one before it is the one that was put there."""
    def parts(first: str, second: str) -> tuple[Column, Column, Column]:
        at = F.locate(second, output)
        end = F.call_function("locate", F.lit(MIDDLE), output, at)
        size = len(first)
        return (F.substring(output, F.lit(size + 1), at - 1 - size), F.substring(output, at + size, end - at - size),
                F.substring(output, end + size, F.length(output)))

    psm_prefix, psm_suffix, psm_middle = parts(PREFIX, SUFFIX)
    spm_suffix, spm_prefix, spm_middle = parts(SUFFIX, PREFIX)
    return (F.when(form == "psm", F.concat(psm_prefix, psm_middle, psm_suffix))
            .when(form == "spm", F.concat(spm_prefix, spm_middle, spm_suffix)).otherwise(output))
