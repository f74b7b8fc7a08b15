"""Allocation, split, coverage swaps and length statistics against brute force."""

import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from marginalia.operators import coverage as CV, split as SP, stats

GOLDEN = {"0": 45, "1": 158, "2": 64, "3+": 50}


def allocate(spark, sizes, eval_size):
    df = spark.createDataFrame(list(sizes.items()), "stratum string, size long")
    return {r.stratum: r.n_eval for r in SP.allocate(df, eval_size=eval_size).collect()}


def test_golden_allocation(spark):
    assert allocate(spark, GOLDEN, 32) == {"0": 5, "1": 16, "2": 6, "3+": 5}
    df = spark.createDataFrame(list(GOLDEN.items()), "stratum string, size long")
    assert sum(r.n_eval for r in SP.allocate(df, ratio=0.1).collect()) == 32


def test_singletons_and_surplus(spark):
    assert allocate(spark, {"a": 1, "b": 9}, 1) == {"a": 0, "b": 1}
    many = {f"s{i:02d}": 2 for i in range(20)}
    got = allocate(spark, many, 4)
    assert sum(got.values()) == 4 and set(got.values()) == {0, 1}


def test_impossible_size_fails(spark):
    with pytest.raises(Exception, match="cannot allocate"):
        allocate(spark, {"a": 3}, 5)


def test_random_allocations_meet_size_and_limits(spark):
    rng = random.Random(5)
    for _ in range(4):
        sizes = {f"k{i}": rng.choice([1, 2, 3, 10, 200]) for i in range(rng.randint(2, 9))}
        size = max(1, round(sum(sizes.values()) * 0.1))
        got = allocate(spark, sizes, size)
        assert sum(got.values()) == size and all(0 <= got[k] <= n for k, n in sizes.items())


def test_split_is_exact_seeded_and_disjoint(spark):
    rows = spark.range(3000).select("id", F.when(F.col("id") % 3 > 0, "hot").otherwise(F.concat(F.lit("s"), F.col("id") % 4)).alias("stratum"))
    one = SP.stratified(rows, "id", 7, eval_size=300)
    ids = {r.id for r in one.where("split = 'eval'").collect()}
    assert len(ids) == 300
    again = SP.stratified(rows.repartition(7), "id", 7, eval_size=300)
    assert ids == {r.id for r in again.where("split = 'eval'").collect()}
    assert ids != {r.id for r in SP.stratified(rows, "id", 8, eval_size=300).where("split = 'eval'").collect()}
    check = SP.set_checks(one, rows, "id").collect()[0]
    assert check.ok and check.overlap == 0


def brute_swaps(train, evals, minimum=3):
    """Sequential swaps on lists of (id, stratum, categories), as described for the operator."""
    every = [c for r in train + evals for c in r[2]]
    wanted = sorted({c for c in every if c != SP.NO_EVENTS and every.count(c) >= minimum})
    swaps = []
    for category in wanted:
        counts = [c for r in evals for c in r[2]]
        if category in counts:
            continue
        d = next((i for i, r in enumerate(train) if category in r[2]), None)
        fits = lambda r: r[1] == train[d][1] and all(c == SP.NO_EVENTS or counts.count(c) > 1 for c in r[2])
        e = next((i for i, r in enumerate(evals) if fits(r)), None) if d is not None else None
        if e is None:
            continue
        swaps.append((category, train[d][0], evals[e][0]))
        train[d], evals[e] = evals[e], train[d]
    return swaps


def test_coverage_swaps_match_brute_force(spark):
    rng = random.Random(11)
    rows = [
        (i, rng.choice("ab"), [f"c{rng.randint(0, 14)}" for _ in range(rng.choice([1, 1, 2]))] if i % 9 else [SP.NO_EVENTS])
        for i in range(120)
    ]
    df = spark.createDataFrame(rows, "id long, stratum string, cats array<string>")
    parts = SP.stratified(df, "id", 3, eval_size=14)
    ordered = parts.orderBy("stratum", SP.order_hash(F.col("id"), 3), "id").collect()
    lists = {s: [(r.id, r.stratum, list(r.cats)) for r in ordered if r.split == s] for s in ("train", "eval")}
    expected = brute_swaps(lists["train"], lists["eval"])
    covered, swaps = CV.cover_categories(parts, "id", "cats", 3)
    assert expected and [(s.category, s.train_to_eval, s.eval_to_train) for s in swaps.orderBy("number").collect()] == expected
    assert {r.id for r in covered.where("split = 'eval'").collect()} == {r[0] for r in lists["eval"]}


@pytest.mark.parametrize("seed", range(2))
def test_replay_over_candidates_is_the_replay_over_all_rows(spark, seed):
    """Rows that repeat a category can take it out of eval again before its turn."""
    rng = random.Random(seed)
    rows = [(f"n{i}", rng.choice("abc"), [f"c{min(rng.randint(0, 60), rng.randint(0, 60)):02d}" for _ in range(rng.choice([1, 2, 3]))] * rng.choice([1, 1, 2]))
            for i in range(400)]
    df = spark.createDataFrame(rows, "id string, stratum string, cats array<string>")
    parts = SP.stratified(df, "id", seed, eval_size=40)
    ordered = parts.orderBy("stratum", SP.order_hash(F.col("id"), seed), "id").collect()
    lists = {s: [(r.id, r.stratum, list(r.cats)) for r in ordered if r.split == s] for s in ("train", "eval")}
    expected = brute_swaps(lists["train"], lists["eval"])
    covered, swaps = CV.cover_categories(parts, "id", "cats", seed)
    assert expected and [(s.category, s.train_to_eval, s.eval_to_train) for s in swaps.orderBy("number").collect()] == expected
    assert {r.id for r in covered.where("split = 'eval'").collect()} == {r[0] for r in lists["eval"]}


def test_lost_category_is_reported():
    rows = [dict(id=k, stratum="s", hash=str(k), cats=c, split=s) for k, (c, s) in enumerate(
        [(["a"], "train"), (["b", "b"], "eval"), (["b"], "train"), (["z"], "eval")])]
    swaps, lost = CV.replay(["a"], rows, Counter({"b": 2, "z": 1}), {"a", "b"})
    assert swaps == [(1, "a", 0, 1, "s")] and lost == "b"


def test_bucket_digits_follow_from_the_size():
    assert [SP.bucket_digits(n) for n in (0, 20_000, 20_001, 10**9, 10**13)] == [0, 0, 1, 4, 8]


@pytest.mark.parametrize("n", [1, 2, 7, 101])
def test_length_statistics(spark, n):
    rng = random.Random(n)
    values = sorted(rng.randint(1, 60) for _ in range(n))
    df = spark.createDataFrame([("g", v) for v in values], "g string, v long")
    floor = stats.len_stats_floor(df, ["g"], "v").collect()[0]
    assert floor.p95 == values[int(0.95 * (n - 1))] and (floor.min, floor.max) == (values[0], values[-1])
    upper = stats.len_stats_upper(df, ["g"], "v").collect()[0]
    assert upper.p95 == values[min(int(0.95 * (n - 1)) + 1, n - 1)]
    linear = stats.len_stats_linear(df, ["g"], "v").collect()[0]
    for q, got in ((0.5, linear.p50), (0.9, linear.p90), (0.99, linear.p99)):
        pos = q * (n - 1)
        low, high = values[int(pos)], values[min(int(pos) + 1, n - 1)]
        assert got == round(low * (1 - (pos - int(pos))) + high * (pos - int(pos)))
    mean = sum(values) / n
    assert linear.stdev == round(math.sqrt(sum((v - mean) ** 2 for v in values) / n), 2)
    assert linear.median == int((values[(n - 1) // 2] + values[n // 2]) / 2)


def test_spread_deals_rows_whose_file_has_more_splits_than_row_groups(spark, tmp_path):
    from marginalia.session import spread

    path = str(tmp_path / "one_group.parquet")
    spark.range(400).selectExpr("id", "repeat(md5(CAST(id AS STRING)), 20) AS text").coalesce(1).write.parquet(path)
    before = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", "1000")
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        dealt = spread(spark.read.parquet(path))
        sizes = dealt.groupBy(F.spark_partition_id()).count().collect()
        assert sum(r["count"] for r in sizes) == 400 and max(r["count"] for r in sizes) <= 150
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", before[0])
        spark.conf.set("spark.sql.files.openCostInBytes", before[1])
