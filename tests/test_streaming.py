from larkspur.dialect.engine import Engine
from larkspur.sources.catalog import Catalog
from larkspur.streaming.tables import load_stream, run_available


def test_select_over_a_growing_folder(spark, tmp_path):
    folder = str(tmp_path / "in")
    spark.read.parquet("/root/testdata/sf0.001/events.parquet").write.parquet(folder)
    catalog = Catalog(spark)
    load_stream(catalog, "arriving", folder)
    engine = Engine(spark, catalog)
    run_available(engine.sql("select event_id, value from arriving where event_type = 'click' and value > 10"), "clicks", str(tmp_path / "a"))
    want = spark.read.parquet(folder).filter("event_type = 'click' and value > 10").count()
    assert spark.table("clicks").count() == want > 0
    run_available(engine.sql("select event_type, count(*) as n from arriving group by event_type"), "kinds", str(tmp_path / "b"), "complete")
    assert sum(r["n"] for r in spark.table("kinds").collect()) == spark.read.parquet(folder).count()
