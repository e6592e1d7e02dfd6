"""Written tables and the scope that deletes them."""

from weftgraph.storage import scope, written


def test_a_scope_deletes_what_was_written_inside(spark):
    stays = written(spark.range(3).toDF("a"), "stays")
    with scope(spark):
        goes = written(spark.range(5).toDF("a"), "goes")
        path = goes.inputFiles()[0].rsplit("/", 1)[0]
        assert goes.count() == 5
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    assert not place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)
    assert stays.count() == 3
