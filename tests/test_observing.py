import numpy as np
import pytest
from pyspark.sql import functions as F

from tessellar.operators import cells, ising, variational
from tessellar.operators.tensor import Tensor

from .test_networks import found


def network(spark, tensor, beta=0.3):
    t = tensor(spark.createDataFrame([(beta,)], "beta double"), "dgeb")
    df = t.df.select(*t.index, F.lit(1).cast("long").alias("problem"), F.lit(0).alias("i"), F.lit(0).alias("j"), "re", "im")
    return Tensor(df, t.index, t.dims, cells.KEYS)


def test_whole_and_split_steps_are_the_same(spark):
    bulk = network(spark, ising.bulk, 0.6)
    first = variational.start(bulk, 4, 1, 1)
    split, errors = variational.step(first, 1, 1)
    whole, other = variational.solve_whole(first, 1, 1, maxiter=1)
    a, b = found(split), found(whole)
    for k in a:
        assert np.allclose(a[k], b[k], atol=1e-9)
    assert other.first().error == pytest.approx(errors.first().error, rel=1e-6)


def test_observable_environment_is_kept_and_starts_warm(spark, tmp_path):
    bulk, chi = network(spark, ising.bulk), 4
    folder = str(tmp_path)
    up, down, env = variational.observable_environment(bulk, chi, 1, 1, outfolder=folder, tol=1e-9, maxiter=20)
    value = lambda *s: variational.expectation(s[0], s[2], network(spark, ising.energy), bulk, chi, 1, s[1]).first().re
    first = value(up, down, env)
    again = variational.observable_environment(bulk, chi, 1, 1, folder=folder, tol=1e-7, maxiter=1)
    assert value(*again) == pytest.approx(first, abs=1e-8)
    for name in ("up", "down", "observed"):
        assert (tmp_path / f"direction={name}").exists()
    # one state for both sides
    same = variational.observable_environment(bulk, chi, 1, 1, updown=False, folder=folder, tol=1e-7, maxiter=1)
    assert same[1] is None and value(*same) == pytest.approx(first, abs=1e-7)
    with pytest.raises(ValueError, match="4 indices"):
        variational.start(Tensor(bulk.df.drop("b"), ("d", "g", "e"), bulk.dims, cells.KEYS), chi, 1, 1)
