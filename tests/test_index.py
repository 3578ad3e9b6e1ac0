"""The persistent index of vectors: exactness over all lists, recall, appends, what it refuses."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tilecohort.operators import index, vectors


def test_index(spark, tmp_path):
    rng = np.random.default_rng(4)
    centres = rng.normal(size=(12, 16))
    x = np.repeat(centres, 50, axis=0) + rng.normal(size=(600, 16)) * 0.6
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(x.tolist())] + [(None, x[0].tolist()), (900, None)], "id long, vector array<double>")
    path = str(tmp_path / "index")
    index.build(rows.filter("id % 4 > 0 OR id IS NULL"), path, extractor="a")
    index.append(rows.filter("id % 4 = 0"), path)
    index.append(rows, path)
    assert index.vectors_of(spark, path).count() == 600 and index.opened(spark, path)[0] == {"space": "cosine", "dim": 16, "lists": 21, "extractor": "a"}
    exact = {(r.id, r.ref) for r in vectors.nearest(rows.filter("id IS NOT NULL"), rows.filter("id IS NOT NULL"), 7, skip_self=True).collect()}
    whole = {(r.id, r.ref) for r in index.search(rows, path, 7, 1000, skip_self=True).collect()}
    assert whole == exact and len(exact) == 4200
    few = {(r.id, r.ref) for r in index.search(rows, path, 7, 5, skip_self=True).collect()}
    assert len(few & exact) >= 0.9 * len(exact)
    assert index.search(rows.filter("id < 0"), path, 7).count() == 0
    with pytest.raises(ValueError, match="extractor"):
        index.search(rows, path, 7, extractor="b")
    with pytest.raises(ValueError, match="dim"):
        index.append(rows.select("id", F.slice("vector", 1, 8).alias("vector")), path)
    with pytest.raises(ValueError, match="vectors of 8 to 16"):
        index.build(rows.withColumn("vector", F.when(F.col("id") == 3, F.slice("vector", 1, 8)).otherwise(F.col("vector"))), str(tmp_path / "b"))
    with pytest.raises(ValueError, match="no vectors"):
        index.build(rows.filter("id < 0"), str(tmp_path / "c"))
