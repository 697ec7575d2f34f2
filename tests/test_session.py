"""Where intermediate tables go, and when they go."""

import os
from types import SimpleNamespace

import pytest
from pyspark.sql import functions as F

from chronoweave import session


def test_an_unset_folder_is_one_of_the_warehouse():
    of = lambda **conf: session.shared_dir(SimpleNamespace(conf=SimpleNamespace(get=lambda k, *d: conf.get(k.replace(".", "_"), *d))))
    assert of(spark_sql_warehouse_dir="s3a://b/w/") == "s3a://b/w/checkpoints"
    assert of(spark_sql_warehouse_dir="s3a://b/w", spark_checkpoint_dir="hdfs://c/shared") == "hdfs://c/shared"


@pytest.mark.parametrize("fails", [False, True])
def test_finished_tables_are_removed(spark, tmp_path, monkeypatch, fails):
    monkeypatch.setattr(session, "shared_dir", lambda _: str(tmp_path))
    left = lambda: sorted(x.split("-")[0] for x in os.listdir(tmp_path / "chronoweave"))
    with pytest.raises(ZeroDivisionError):
        with session.intermediate(spark):
            with session.intermediate(spark) as keep:
                one, two = session.materialise(spark.range(3), "one"), session.materialise(spark.range(4), "two")
                out = keep(two.withColumnRenamed("id", "n").join(spark.range(2), F.col("n") == F.col("id")))
                assert one.count() == 3 and left() == ["one", "two"]
                if fails:
                    raise ZeroDivisionError
            assert left() == ["two"] and out.count() == 2
            raise ZeroDivisionError
    assert left() == []
    session.materialise(spark.range(1), "three")
    assert left() == ["three"]
