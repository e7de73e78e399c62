import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from escrutinio.operators.ordering import (
    average_ranks,
    dense_index,
    exact_quantiles,
    order_bucket,
    previous_row,
)


def sample(seed, n=400):
    rng = random.Random(seed)
    kinds = [
        lambda: rng.uniform(-1e6, 1e6),
        lambda: float(rng.randint(-5, 5)),
        lambda: rng.uniform(0, 1e-7),
        lambda: 0.0,
        lambda: 2.0 ** rng.randint(-20, 20),
    ]
    return [(rng.choice("abb"), rng.choice(kinds)()) for _ in range(n)]


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_bucket_never_decreases_with_the_value(frame, seed):
    values = sorted({v for _, v in sample(seed)})
    got = [r.b for r in frame([(v,) for v in values], "v double").select(order_bucket(F.col("v")).alias("b")).collect()]
    assert got == sorted(got)


@pytest.mark.parametrize("seed", [1, 2])
def test_average_ranks_match_pandas(frame, seed):
    data = sample(seed)
    got = average_ranks(frame(data, "g string, v double"), ["g"], "v").toPandas()
    pdf = pd.DataFrame(data, columns=["g", "v"])
    pdf["posto"] = pdf.groupby("g").v.rank(method="average")
    expected = pdf.drop_duplicates(["g", "v"])
    merged = expected.merge(got, on=["g", "v"], suffixes=("_e", ""))
    assert len(merged) == len(expected)
    assert np.allclose(merged.posto, merged.posto_e)


def test_weighted_ranks_count_repeats(frame):
    df = frame([(1.0, 3), (2.0, 1)], "v double, w int")
    got = {r.v: r.posto for r in average_ranks(df, [], "v", weight="w").collect()}
    assert got == {1.0: 2.0, 2.0: 4.0}


@pytest.mark.parametrize("seed", [1, 2, 3])
def test_quantiles_match_numpy(frame, seed):
    data = sample(seed)
    names = {"a": 0.0, "b": 0.25, "c": 0.5, "d": 0.9, "e": 1.0}
    got = exact_quantiles(frame([*data, ("a", None)], "g string, v double"), ["g"], "v", names, "n").toPandas()
    for g, part in pd.DataFrame(data, columns=["g", "v"]).groupby("g"):
        row = got[got.g == g].iloc[0]
        assert row.n == len(part)
        expected = np.quantile(part.v, list(names.values()))
        assert np.allclose([row[k] for k in names], expected, rtol=1e-12, atol=1e-12)


def test_quantiles_of_nothing(frame):
    empty = frame([(None, "a")], "v double, g string")
    assert exact_quantiles(empty, [], "v", {"m": 0.5}).first().m is None
    assert exact_quantiles(empty, ["g"], "v", {"m": 0.5}).collect() == []


def test_one_dominant_value_and_group(frame):
    data = [("g", 7.0)] * 900 + [("g", float(i)) for i in range(300)] + [("h", 1.0)]
    got = exact_quantiles(frame(data, "g string, v double"), ["g"], "v", {"m": 0.5}).toPandas()
    assert dict(zip(got.g, got.m)) == {"g": 7.0, "h": 1.0}


def test_dense_index_is_a_permutation(frame):
    data = [("a", f"k{i}") for i in range(57)] + [("b", "only")]
    got = dense_index(frame(data, "g string, k string"), ["g"], "k").toPandas()
    assert sorted(got[got.g == "a"].indice) == list(range(57))
    assert list(got[got.g == "b"].indice) == [0]


def test_previous_row_crosses_buckets(frame):
    data = [("a", t, t * 10) for t in (1, 2, 11, 12, 31)] + [("b", 5, 1)]
    df = frame(data, "g string, t int, x int")
    got = previous_row(df, ["g"], "t", F.floor(F.col("t") / 10), ["x"]).orderBy("g", "t")
    assert [r.x_anterior for r in got.collect()] == [None, 10, 20, 110, 120, None]
