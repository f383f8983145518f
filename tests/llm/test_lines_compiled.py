"""What Spark compiles for lines: short sources, and joins that are compiled at all."""

import pytest
from pyspark.sql import functions as F

from quillspark.llm import lines


def compiled(df):
    """(plan, source, bytes of the longest method) of each part that Spark compiles."""
    parts = df._jdf.queryExecution().debug().codegenToSeq()
    return [((x := parts.apply(i))._1(), x._2(), x._3().maxMethodCodeSize()) for i in range(parts.size())]


@pytest.fixture
def tables(spark, tmp_path):
    """Writes a frame and reads it back; plans are whole, and join by sorting."""
    keys = {"spark.sql.adaptive.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "-1"}
    before = {k: spark.conf.get(k) for k in keys}
    for k, v in keys.items():
        spark.conf.set(k, v)

    def written(df, name):
        df.write.parquet(f"{tmp_path}/{name}")
        return spark.read.parquet(f"{tmp_path}/{name}")

    yield written
    for k, v in before.items():
        spark.conf.set(k, v)


def test_sums_and_products_are_not_checked(spark, tables):
    """Minima and places cannot overflow; the checks of ANSI mode would be made for each shingle.
    The session's own setting stays."""
    before = spark.conf.get("spark.sql.ansi.enabled")
    docs = tables(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), "docs")
    sources = [source for _, source, _ in compiled(lines.signatures(docs))]
    assert any("subStringSQL" in x for x in sources) and not any("multiplyExact" in x for x in sources)
    assert spark.conf.get("spark.sql.ansi.enabled") == before


def test_bits_and_their_join_are_compiled(spark, tables):
    """The driver held 1.6 MB of source for the bits, and the join that compares them was too wide to
    be compiled. A method of more than 8,000 bytes is never compiled by the JVM."""
    docs = tables(spark.createDataFrame([(1, "a b")], "doc_id long, text string"), "docs")
    made = lines._sketched(docs.select(F.col("doc_id").alias("lid"), lines._units(F.col("text")).alias("u")), 12)
    assert max(len(source) for _, source, _ in compiled(made)) < 900_000
    left = tables(docs.selectExpr("doc_id key", "doc_id lid", "doc_id root"), "left")
    near = compiled(lines._near(left, tables(made, "sketches"), 0.8))
    joins = [size for plan, source, size in near if "SortMergeJoin" in plan and "bitCount" in source]
    assert joins and max(joins) < 8000
