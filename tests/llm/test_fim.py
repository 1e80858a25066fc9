import hashlib
import random
import re

from pyspark.sql import functions as F
from skewline.llm import fim

UNIT = re.compile(r"[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+")
TEXTS = [None, "", " ", "one", " lead", "trail \n", "a  b\tc \n d", "é日本語 😀😀 x", "a\u0085b\x1c c", "has <P> in", "has <S>", "<M>",
         "ends <", "ends <S", "< <P < >", "word " * 3000, "x" * 9000, " \t\n" * 50]


def expected(doc_id, text):
    text = text or ""
    units = UNIT.findall(text)
    assert "".join(units) == text
    n = len(units)
    digest = hashlib.sha256(f"42:{'null' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(digest[8 * k:8 * k + 8], 16) for k in range(4)]
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    prefix, middle, suffix = "".join(units[:a]), "".join(units[a:b]), "".join(units[b:])
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 50:
        return n, "plain", None, None, text
    if h[3] % 100 < 80:
        return n, "spm", len(prefix), len(middle), f"<S>{suffix}<P>{prefix}<M>{middle}"
    return n, "psm", len(prefix), len(middle), f"<P>{prefix}<S>{suffix}<M>{middle}"


def test_against_findall_and_round_trip(spark):
    rng = random.Random(5)
    rows = [(100 * i + k, t, "clash", 7) for i, t in enumerate(TEXTS) for k in range(12)]
    rows += [(10_000 + i, "".join(rng.choice(["a", "<", "<S", "P", " ", "\t", "bc>", "é"]) for _ in range(rng.randrange(60))), "x", 1) for i in range(200)]
    rows += [(None, "null id text", "x", 1), (3, "same id", "x", 1), (3, "same id", "x", 1)]
    df = spark.createDataFrame(rows, "doc_id long, text string, output string, n int")
    got = fim.transform(df).withColumn("back", fim.restore(F.col("output"), F.col("form"))).collect()
    want = [(d, *expected(d, t), t or "") for d, t, *_ in rows]
    assert sorted(map(repr, ((r.doc_id, r.n, r.form, r.prefix_chars, r.middle_chars, r.output, r.back) for r in got))) == sorted(map(repr, want))
    assert {r.form for r in got} == {"plain", "psm", "spm"}


def test_long_texts_in_runs():
    for text in ("a b  c\n" * 100 + " ", "x" * 300, " " * 300, "a" + " b" * 200):
        assert fim.unit_ends(text, at_once=7) == fim.unit_ends(text) == [m.end() for m in UNIT.finditer(text)]


def test_empty_table(spark):
    assert fim.transform(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_statement(spark):
    import duckdb
    import __spark_entry__ as E

    from conftest import SF001

    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{SF001}/documents.parquet')")
    want = con.execute(E.oracle_sql()["op12_repeated_capture_fim"])
    names = [c[0] for c in want.description]
    got = E.queries()["op12_repeated_capture_fim"](spark, SF001)
    assert got.columns == names
    assert sorted(map(repr, map(tuple, got.collect()))) == sorted(map(repr, want.fetchall()))
