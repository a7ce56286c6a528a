"""Tables with fixed schemas from files and from a database give the same rows."""

from pyspark.sql import functions as F

from larkspur.sources import tables


def test_schemas_are_complete(spark):
    assert len(tables.SCHEMAS) == 18
    for name in tables.SCHEMAS:
        assert spark.createDataFrame([], tables.SCHEMAS[name]).columns, name


def test_files_and_database(spark, tmp_path):
    kinds = dict(x.split() for x in tables.SCHEMAS["documents"].split(", "))
    rows = spark.range(500).select(
        *((F.col("id") % 7 == 0 if k == "boolean" else F.when(F.col("id") % 50 != 1, F.expr("timestamp_ntz'2024-01-01 00:00:00' + make_dt_interval(0, cast(id as int))")) if k == "timestamp_ntz" else F.concat(F.lit(f"{c[:3]}-"), "id")).alias(c) for c, k in kinds.items())
    )
    rows.withColumn("more", F.lit(1)).write.parquet(str(tmp_path / "documents.parquet"))
    url = f"jdbc:derby:{tmp_path}/db"
    wide = [f"{c} VARCHAR(99)" for c, k in kinds.items() if k == "string"]
    rows.write.format("jdbc").options(url=f"{url};create=true", dbtable="documents", createTableColumnTypes=", ".join(wide), driver="org.apache.derby.jdbc.EmbeddedDriver").save()
    db = tables.Database(url, parts=5, properties={"driver": "org.apache.derby.jdbc.EmbeddedDriver"})
    key = lambda df: sorted(map(str, df.collect()))
    one, two = (tables.read_tables(spark, where, ["documents"])["documents"] for where in (str(tmp_path), db))
    assert one.schema.simpleString() == two.schema.simpleString() and key(one) == key(two) and len(key(one)) == 500
    assert two.rdd.getNumPartitions() == 5
    assert two.select(F.spark_partition_id().alias("p")).groupBy("p").count().count() == 5, "every part has rows"
    whole = tables.read_tables(spark, db._replace(column="none"), ["documents"])["documents"]
    assert whole.rdd.getNumPartitions() == 1 and key(whole) == key(one)


def test_documents_are_published_together(spark, tmp_path):
    import pytest

    from larkspur.sources import documents

    path, key = str(tmp_path / "d"), lambda df: sorted(map(tuple, df.collect()))
    rows = [(f"v/{k} %é~"[:-1], "p 1", f'{{"k": {k}, "t": "é\\n"}}') for k in range(40)]
    df = spark.createDataFrame(rows, "version_id string, pipeline_version string, json string").repartition(3)
    documents.write_documents(df, path)
    assert key(documents.read_documents(spark, path)) == sorted(rows)
    bad = df.withColumn("json", F.when(F.col("json").contains("7"), F.raise_error(F.lit("stop here"))).otherwise(F.lit("{}")))
    with pytest.raises(Exception, match="stop here"):
        documents.write_documents(bad, path)
    assert key(documents.read_documents(spark, path)) == sorted(rows)
    documents.write_documents(df.limit(2), path)
    assert documents.read_documents(spark, path).count() == 2
    documents.write_documents(df.limit(0), path)
    assert documents.read_documents(spark, path).count() == 0
