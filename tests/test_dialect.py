"""The front end: what it accepts, what it means, and what it refuses."""

import re

import pytest
from pyspark.sql import types as T

from larkspur.dialect.engine import Engine
from larkspur.dialect.lexer import DialectError, tokens
from larkspur.functions.columns import cast_int, cast_long, cast_truncated, extract_part, int_div, like_loose
from larkspur.sources.catalog import Catalog
from larkspur.sources.sinks import console

KINDS = ["crate", "tube", "sack", "drum"]


@pytest.fixture(scope="module")
def engine(spark):
    """1,200 parcels: numbered from 0, of kinds in turn, each weight once in 1,200."""
    catalog = Catalog(spark)
    rows = [(i, i * 7 % 1200, i % 6, KINDS[i % 4]) for i in range(1200)]
    catalog.add("parcels", spark.createDataFrame(rows, "num int, weight int, zone int, kind string"))
    catalog.load_folder("/root/testdata/sf0.001", ("orders", "customer", "nation"))
    return Engine(spark, catalog)


@pytest.mark.parametrize("expression,value", [("num - 20", 0), ("num * 3", 60), ("num % 7", 6), ("num / 3", 6), ("num / 8.0", 2.5), ("-num / 3", -6), ("(5 - num) / 4", -3), ("2 + num * 2", 42), ("90 - num - 5", 65), ("num / 2 * 3", 30), ("num * 3 / 8 as q", 7), ("7 - 9 / 2", 3), ("-(num - 25)", 5)])
def test_arithmetic(engine, expression, value):
    row = engine.sql(f"select {expression} from parcels where num = 20").first()
    assert float(row[0]) == value and isinstance(row[0], int) == (value != 2.5)


@pytest.mark.parametrize("pattern,found", [("%r%", {"crate", "drum"}), ("t%", {"tube"}), ("%e", {"crate", "tube"}), ("s_ck", {"sack"}), ("sack", {"sack"}), ("ack", set()), ("D%", set()), ("%", set(KINDS))])
def test_like(engine, pattern, found):
    assert {r[0] for r in engine.sql(f"select distinct kind from parcels where kind like '{pattern}'").collect()} == found


def test_loose_like(spark, engine):
    loose = Engine(spark, engine.catalog, loose_like=True)
    count = lambda p: loose.sql(f"select count(*) as n from parcels where kind like {p}").first()[0]
    assert count("'C%T'") == 300 and count("'U'") == 600 and count("'d_um'") == 0 and count("'[a-z]'") == 0
    assert count("case when num < 600 then 'CR' else 'S%K' end") == 300
    assert count("'it''s'") == count('"it\'s%"') == count("'\\E|.*'") == 0


@pytest.mark.parametrize("text,value", [
    ("select count(*) as n from parcels where not zone = 2 and zone < 4", 600),
    ("select count(*) as n from parcels where num = 4 or num = 8 or zone > 5", 2),
    ("select count(*) as n from parcels where zone in (0, 5)", 400),
    ("select count(*) as n from parcels where exists (select * from nation where n_nationkey > 99)", 0),
    ("select count(*) as n from parcels where not exists (select 1 from nation where n_nationkey > 99)", 1200),
    ("select count(*) as n from parcels p where exists (select * from nation where n_nationkey = p.num)", 25),
    ("select count(*) as n from parcels, nation n where num > n_nationkey and num < 4", 3 + 2 + 1),
    ("select count(*) as n from parcels left join nation on num = n_nationkey where n_name is null", 1175),
    ("select count(*) as n from parcels full outer join nation on num = n_nationkey + 1190", 1200 + 15),
    ("select count(*) as n from nation cross join parcels where num between 6 and 9", 100),
    ("select count(*) as n from nation join (select num from parcels where num < 9) t on n_nationkey = t.num", 9),
    ("select count(*) as n from nation a, nation b join parcels on b.n_nationkey = num", 625),
    ("select count(distinct zone) as n from parcels", 6),
    ("select max(kind) as n from parcels", "tube"),
    ("select min(kind) as n from parcels", "crate"),
    ("select sum(zone) as n from parcels where num < 0", None),
    ("select count(*) as n from parcels where num not in (select n_nationkey from nation)", 1175),
    ("select extract(day from date '2023-01-30' + interval '1' month) as n from parcels limit 1", 28),
    ("select count(*) as n from parcels where kind > 'drum'", 600),
    ("select 300000000000 as n from parcels limit 1", 300000000000),
    ("select substring('parcel' from 3 for 2) as n from parcels limit 1", "rc"),
    ("select 'o''clock' as n from parcels limit 1", "o'clock"),
    ("select cast_long(num + 9007199254740993) as n from parcels where num = 0", 9007199254740993),
    ("select cast_int(cast(0 - 2.7 as decimal(5,1))) as n from parcels limit 1", -2),
    ("select cast_int(cast_double(2.5)) as n from parcels limit 1", 2),
    ("select cast_double(cast_decimal_15(cast(0 - 1.239 as decimal(9,3)))) as n from parcels limit 1", -1.23),
])
def test_meaning(engine, text, value):
    assert engine.sql(text).first()["n"] == value


def test_having_order_limit(engine):
    rows = engine.sql("select zone, count(*) as n, avg(num) as a from parcels where num < 1198 group by zone having n >= 200 or max(num) = 0 order by zone desc limit 2").collect()  # 3, 9 .. 1197: mean 600
    assert [tuple(r) for r in rows] == [(3, 200, 600.0), (2, 200, 599.0)]
    assert [f.dataType for f in engine.sql("select avg(zone) as a from parcels").schema] == [T.DoubleType()]
    assert [r[0] for r in engine.sql("select num from parcels order by weight desc, num limit 3").collect()] == sorted(range(1200), key=lambda i: (-(i * 7 % 1200), i))[:3]


def test_explain_and_console(engine):
    plan = "\n".join(r[0] for r in engine.sql("explain select num from parcels where num = 3").collect())
    assert "Optimized Logical Plan" in plan and "Physical Plan" in plan
    shown = console(engine.sql("select num from parcels order by num limit 12"))
    assert shown.splitlines()[0] == "num" and shown.count("\n") == 11 and re.search(r"12 rows, \d+ ms$", shown)


@pytest.mark.parametrize("text", ["select", "select num", "select num from", "select num count from parcels", "select num from parcels where", "select num from parcels limit x", "select ? from parcels", "select num from parcels; select 1", "select interval '1' eon from parcels", "update parcels set num = 1", "select extract(era from num) from parcels", "select num from parcels where num in ()"])
def test_refused(engine, text):
    with pytest.raises(DialectError):
        engine.sql(text)


def test_lexer():
    assert [t.text for t in tokens("a<>1.5 -- x\n'q' \"r\"") if t.kind != "end"] == ["a", "<>", "1.5", "'q'", '"r"']


def test_functions(spark):
    from pyspark.sql import functions as F

    row = spark.range(1).select(int_div(F.lit(-7), F.lit(2)).alias("a"), cast_truncated(F.lit("-1.239").cast("decimal(10,3)")).alias("b"), cast_truncated(F.lit("1.239").cast("decimal(10,3)")).alias("c"), extract_part("hour", F.expr("timestamp_ntz '2020-01-01 05:06:07'")).alias("d")).first()
    assert (row["a"], float(row["b"]), float(row["c"]), row["d"]) == (-3, -1.23, 1.23, 5)
    longs = spark.createDataFrame([(9007199254740993, -2.5)], "a long, b double").select(cast_long("a"), cast_long("b"), cast_int(F.lit("-2.70").cast("decimal(5,2)")), like_loose(F.lit("it's \\E (x)"), "S \\E (%)")).first()
    assert tuple(longs) == (9007199254740993, -2, -2, True)
    with pytest.raises(ValueError):
        extract_part("era", "x")


def test_console_answers(engine):
    from larkspur.__main__ import answer

    assert answer(engine, "select count(*) as n from nation").splitlines()[:2] == ["n", "25"]
    assert answer(engine, "selec").startswith("error: expected select") and "Physical Plan" in answer(engine, "explain select num from parcels")
