"""Row ranges, pushed predicates, and streams of vector files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from velarium.sources import vectors
from velarium.sources.vectors import PushedReader, VectorReader, VectorStreamWriter, Written, pushdown, register
from velarium.streaming import jobs


@pytest.fixture
def folder(spark, tmp_path):
    register(spark)
    df = spark.range(1000).selectExpr("id AS vec_id", "array(cast(id AS float), cast(1 AS float)) AS embedding")
    df.repartitionByRange(3, "vec_id").sortWithinPartitions("vec_id").write.format("vectors").mode("append").save(f"file://{tmp_path}/v")
    return f"file://{tmp_path}/v"


def ids(df):
    return sorted(r["vec_id"] for r in df.collect())


@pytest.mark.parametrize(
    ("condition", "wanted", "partitions"),
    [
        ("vec_id BETWEEN 250 AND 359", range(250, 360), 3),
        ("vec_id < 10", range(10), 1),
        ("vec_id >= 990", range(990, 1000), 1),
        ("vec_id > 998", [999], 1),
        ("vec_id = 500", [500], 1),
        ("vec_id IN (3, 7, 999, 5000)", [3, 7, 999], 3),
        ("vec_id < 5 AND vec_id > 7", [], 1),
        ("vec_id < -1", [], 1),
        ("vec_id = 3 OR vec_id = 4", [3, 4], None),
        ("vec_id % 500 = 0 AND vec_id <= 500", [0, 500], None),
    ],
)
def test_pushed_predicates(spark, folder, condition, wanted, partitions):
    df = spark.read.format("vectors").option("rows", 100).option("push", True).load(folder).where(condition)
    with pushdown(spark):
        assert ids(df) == list(wanted)
        if partitions is not None:
            assert df.rdd.getNumPartitions() <= partitions


def test_rows_read(spark, folder):
    from pyspark.sql.datasource import GreaterThanOrEqual, In, LessThan, StringContains

    reader = PushedReader(folder, "fbin", 100)
    left = list(reader.pushFilters([GreaterThanOrEqual(("vec_id",), 250), LessThan(("vec_id",), 360), StringContains(("other",), "x")]))
    assert [type(f) for f in left] == [StringContains]
    assert sum(p.count for p in reader.partitions()) == 110
    reader = PushedReader(folder, "fbin", 100)
    assert not list(reader.pushFilters([In(("vec_id",), (1, 2, 900))]))
    assert [(p.first + p.start, p.count) for p in reader.partitions()] == [(1, 1), (2, 1), (900, 1)]
    assert sum(p.count for p in VectorReader(folder, "fbin", 100).partitions()) == 1000


def test_range_options(spark, folder):
    load = lambda **o: spark.read.format("vectors").options(rows=100, **o).load(folder)
    assert ids(load(start=330, count=10)) == list(range(330, 340))
    assert ids(load(start=995)) == list(range(995, 1000))
    assert ids(load(start=2000)) == [] and ids(load(start=5, count=0)) == []


def test_second_append_stays_behind_the_first(spark, folder):
    more = spark.range(5).selectExpr("id AS vec_id", "array(cast(-1 AS float), cast(id AS float)) AS embedding").coalesce(1)
    more.write.format("vectors").mode("append").save(folder)
    back = spark.read.format("vectors").load(folder)
    assert back.count() == 1005 and back.where("vec_id >= 1000 AND embedding[0] = -1").count() == 5


@pytest.mark.parametrize("layout", ["fbin", "fvecs"])
def test_faulty_rows_leave_nothing_behind(spark, tmp_path, layout):
    register(spark)
    path = f"file://{tmp_path}/bad"
    for bad in ("array(cast(id AS float), cast(null AS float))", "if(id = 3, array(cast(1 AS float)), array(cast(1 AS float), cast(2 AS float)))", "cast(null AS array<float>)"):
        with pytest.raises(Exception, match="null vector|dimensions"):
            spark.range(10).selectExpr("id AS vec_id", f"{bad} AS embedding").coalesce(1).write.format("vectors").option("layout", layout).mode("append").save(path)
    assert vectors.files_of(path) == []


def stream(spark, path):
    return spark.readStream.format("vectors").load(path)


def test_stream_goes_on_where_it_ended(spark, folder, tmp_path):
    batch = []

    def run():
        query = stream(spark, folder).writeStream.foreachBatch(lambda df, n: batch.append((n, ids(df)))).option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
        query.awaitTermination()

    run()
    spark.range(7).selectExpr("id AS vec_id", "array(cast(0 AS float), cast(0 AS float)) AS embedding").coalesce(1).write.format("vectors").mode("append").save(folder)
    run()
    run()
    assert [x for _, rows in batch for x in rows] == list(range(1007)) and len(batch) == 2


def test_stream_refuses_a_file_in_the_past(spark, folder, tmp_path):
    query = lambda: stream(spark, folder).writeStream.format("noop").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start().awaitTermination()
    query()
    first = f"{tmp_path}/v/{vectors.files_of(folder)[0].rsplit('/', 1)[1]}"
    with open(first, "rb") as f:
        data = f.read()
    with open(f"{tmp_path}/v/aaa.fbin", "wb") as f:
        f.write(data)
    with open(f"{tmp_path}/v/zzz.fbin", "wb") as f:
        f.write(data)
    with pytest.raises(Exception, match="have changed"):
        query()


def test_sink_commits_once(tmp_path):
    path = f"file://{tmp_path}/out"
    writer = VectorStreamWriter(path, "fbin")
    (tmp_path / "out").mkdir()

    def written(part, value):
        name = tmp_path / "out" / f".{part}-{value}"
        name.write_bytes(np.array([1, 1], "<i4").tobytes() + np.float32(value).tobytes())
        return Written(part, str(name))

    # A commit that died after its first file: the batch is not noted, so nothing of it is read.
    writer._publish([written(0, 1.0)], "batch-000000000")
    assert vectors.files_of(path) == []
    writer.commit([written(1, 2.0), None, Written(2, "")], 0)
    values = lambda: [float(vectors.read_rows(f, "fbin", 1, 0, 1)[0, 0]) for f in vectors.files_of(path)]
    assert values() == [2.0]
    writer.commit([written(0, 3.0)], 0)  # the same batch once more
    assert values() == [2.0] and not [f for f in (tmp_path / "out").iterdir() if f.name.startswith(".")]
    writer.commit([written(0, 4.0)], 1)
    writer.abort([written(5, 5.0)], 2)
    assert values() == [2.0, 4.0]


def test_stream_to_files(spark, tmp_path):
    register(spark)
    df = spark.range(100).selectExpr("id AS vec_id", "array(cast(id AS float)) AS embedding")
    jobs.to_files(jobs.replay(df, f"file://{tmp_path}/a", 3), "fbin", f"file://{tmp_path}/out", f"file://{tmp_path}/a")
    back = spark.read.format("vectors").load(f"file://{tmp_path}/out")
    assert sorted(r["embedding"][0] for r in back.collect()) == list(range(100))
    assert back.agg(F.max("vec_id")).first()[0] == 99


