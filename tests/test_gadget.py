"""A Gadget file is written by parts, never as one frame on the driver."""

import numpy as np
from pyspark.sql import functions as F

from meshlark.plans import registry
from meshlark.sources import snapshot


def test_query_holds_no_frame(spark, sf_dir, monkeypatch):
    def refuse(self):
        raise AssertionError("the driver holds all rows")

    monkeypatch.setattr(type(spark.range(1)), "toPandas", refuse)
    assert registry.queries()["S08_gadget"](spark, sf_dir).count() == spark.read.parquet(f"{sf_dir}/orders.parquet").count()


def test_many_parts(spark, tmp_path):
    """More rows than a part that is read at once, in order of key over several partitions."""
    n = 150_000
    df = spark.range(1, n + 1, 1, 7).select("id", *[((F.col("id") * p) % 512 / 16).alias(c) for c, p in zip(snapshot.COLUMNS, (3, 5, 7, 11, 13, 17), strict=True)])
    snapshot.write_gadget(df.orderBy(F.desc("id")), str(tmp_path), 0.5, 32.0)
    got = snapshot.read_gadget(spark, f"{tmp_path}/gadget.*", 32).orderBy("row").toPandas()
    ids = np.arange(1, n + 1)
    assert (got["row"].to_numpy() == ids - 1).all()
    for c, p in zip(snapshot.COLUMNS[:3], (3, 5, 7), strict=True):
        assert np.allclose(got[c], (ids * p) % 512 / 16 + 1)
    for c, p in zip(snapshot.COLUMNS[3:], (11, 13, 17), strict=True):
        assert np.allclose(got[c], (ids * p) % 512 / 16 * 0.005)
