"""One query per operator, and which of them have no SQL twin."""
import __spark_entry__ as E
import corpus_pipeline
from cyclekit.llm.queries import ORACLE, QUERIES


def test_one_query_per_operator():
    assert sorted(int(q[2:].split("_")[0]) for q in QUERIES) == list(range(1, 14))
    assert set(QUERIES) | {"pipeline"} <= set(E.queries())
    assert set(ORACLE) == {"op2_warc", "op6_quality_rules", "op12_lexical_search", "op13_hard_negatives"}
    assert "pipeline" not in E.oracle_sql()


def test_pipeline_stages_in_order():
    assert [n for n, _ in corpus_pipeline.STAGES] == [
        "quality rules", "n-gram Jaccard join", "benchmark decontamination", "secret scans", "byte-level BPE"]


def test_rows_are_numbered_once_whatever_the_frame(spark, tmp_path):
    from cyclekit.llm.common import numbered
    spark.range(100).selectExpr("id", "id % 3 AS k").repartition(3).write.parquet(f"{tmp_path}/a")
    spark.range(20).write.csv(f"{tmp_path}/c")
    a, b = spark.read.parquet(f"{tmp_path}/a"), spark.range(3).withColumnRenamed("id", "k")
    for frame in (a, a.filter("id > 5"), a.select("id"), a.join(b, "k"), a.unionAll(a), a.selectExpr("id", "explode(array(1, 2)) AS x"),
                  spark.range(5), spark.read.csv(f"{tmp_path}/c"), a.limit(0)):
        rows = numbered(frame, "_row")
        assert rows.columns == [*frame.columns, "_row"] and rows.count() == frame.count() == rows.select("_row").distinct().count()
