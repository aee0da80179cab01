"""The shared folder, row keys and components."""

import pytest
from pyspark.sql import functions as F

from strata.llm import common


class _Unset:
    """A session that names no shared folder."""

    class conf:
        get = staticmethod(lambda key, default=None: default)

    class sparkContext:
        applicationId = "an application"
        master = "local[2]"
        getConf = staticmethod(dict)


def test_folder_where_none_is_named():
    first = common.shared_dir(_Unset)
    assert first.startswith("file:///") and common.shared_dir(_Unset) == first


def test_no_folder_of_one_machine_on_a_cluster(monkeypatch):
    monkeypatch.setattr(_Unset.sparkContext, "master", "spark://a:7077")
    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_dir(_Unset)


def test_row_keys(spark):
    ids = spark.createDataFrame([(3, "b"), (None, "a"), (3, "a"), (3, "a"), (1, None)], "i long, t string")
    rows = common.keyed(ids, "i", "t").orderBy("row_key").collect()
    assert [(r.i, r.t) for r in rows] == [(None, "a"), (1, None), (3, "a"), (3, "a"), (3, "b")]
    assert len({r.row_key for r in rows}) == 5
    plain = ids.where("i = 1")
    assert [r.row_key for r in common.keyed(plain, "i", "t").collect()] == [1]


def test_components_of_a_chain(spark):
    edges = spark.range(0, 200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).union(spark.createDataFrame([(500, 400), (7, 7)], "a long, b long"))
    found = {r.node: r.component for r in common.components(edges).collect()}
    assert found == {i: 0 for i in range(201)} | {500: 400, 400: 400}
