import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from corpuslens.plans import prefix


@pytest.fixture(scope="module")
def skewed(spark):
    """A third of the rows in one group, the rest in many small ones."""
    rng = np.random.RandomState(0)
    n = 3000
    grp = np.where(rng.rand(n) < 0.34, "hot", np.char.add("g", rng.randint(0, 200, n).astype(str)))
    pdf = pd.DataFrame({"id": np.arange(n), "grp": grp, "w": rng.randint(1, 5, n), "x": rng.permutation(n) / 7.0})
    return pdf, spark.createDataFrame(pdf)


def test_running_totals_match_pandas(skewed):
    pdf, df = skewed
    want = pdf.sort_values("x").copy()
    want["before"] = want.groupby("grp").w.cumsum() - want.w
    got = prefix.running_totals(df.select("grp", "x", "w"), "x", ["w"], ["grp"]).toPandas()
    both = got.merge(want, on=["grp", "x"], suffixes=("", "_p"))
    assert len(both) == len(pdf)
    assert (both.w_before == both.before).all()
    assert (both.w_total == both.groupby("grp").w.transform("sum")).all()


def test_global_running_totals(skewed):
    pdf, df = skewed
    got = prefix.running_totals(df.select("x", "w"), "x", ["w"]).toPandas().sort_values("x")
    assert (got.w_before == got.w.cumsum() - got.w).all()


@pytest.mark.parametrize("by", [[], ["grp"]])
def test_seeded_rank_is_a_permutation_and_ignores_partitioning(skewed, by):
    pdf, df = skewed
    a = prefix.seeded_rank(df, ["id"], "t", 1, by=by, total="n").toPandas().set_index("id")
    b = prefix.seeded_rank(df.repartition(5, "w"), ["id"], "t", 1, by=by).toPandas().set_index("id")
    assert (a["rank"].sort_index() == b["rank"].sort_index()).all()
    groups = a.groupby(by) if by else [((), a)]
    for _, g in groups:
        assert sorted(g["rank"]) == list(range(1, len(g) + 1))
        assert (g["n"] == len(g)).all()


def test_keep_below_is_exact_for_hot_and_small_groups(skewed):
    pdf, df = skewed
    cap = F.when(F.col("grp") == "hot", 100).otherwise(3)
    got = prefix.seeded_rank(df, ["id"], "t", 1, by=["grp"], keep_below=cap).toPandas().grp.value_counts()
    want = pdf.grp.value_counts()
    for g, n in want.items():
        assert got[g] == min(n, 100 if g == "hot" else 3)


def test_only_large_groups_are_cut(skewed):
    _, df = skewed
    big = prefix.big_groups(df, ["grp"], 32).collect()
    assert [r.grp for r in big] == ["hot"]


def test_small_cap_drops_buckets_before_the_shuffle(skewed):
    _, df = skewed
    plan = prefix.seeded_rank(df, ["id"], "t", 1, keep_below=F.lit(5))._jdf.queryExecution().executedPlan().toString()
    window, filt = plan.index("Window [row_number"), plan.index("coalesce(_drop")
    assert window < filt  # printed top-down: the filter is below the window
