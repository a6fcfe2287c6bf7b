"""Reproducible samples, splits, blocks and folds.

Draws come from :func:`hash01` over a row's key, so they do not depend on partitioning.
Where the number of rows is fixed, a group's rows are ordered by that draw, and ties
go to the key. Orders over a whole table or a large group use range partitions and
offsets, never a window on one partition.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gridloom.functions.stats import hash01
from gridloom.sources.scratch import durable


def bernoulli(df: DataFrame, keys: list[str], p: float, seed: int) -> DataFrame:
    if not 0 < p <= 1:
        raise ValueError("the probability must be in (0, 1]")
    return df.filter(hash01(*keys, seed=seed) < p)


def grid_stride(p: float) -> int:
    """Rows and columns between grid points for a sampling probability."""
    if not 0 < p <= 1:
        raise ValueError("the probability must be in (0, 1]")
    return max(1, round(math.sqrt(1 / p)))


def grid(df: DataFrame, p: float, row: str = "image_row", col: str = "image_col") -> DataFrame:
    s = grid_stride(p)
    return df.filter((F.col(row) % s == 0) & (F.col(col) % s == 0))


def pixel_centres(df: DataFrame, tiles: DataFrame) -> DataFrame:
    """x, y and tile-relative row and column, from each tile's offset and affine coefficients (a, b, c, d, e, f).

    The tile table joins by name; the planner broadcasts it by its size.
    """
    tile_row, tile_col = F.col("image_row") - F.col("row_off"), F.col("image_col") - F.col("col_off")
    out = df.join(tiles, "tile").withColumn("tile_row", tile_row).withColumn("tile_col", tile_col)
    x, y = F.col("tile_col") + 0.5, F.col("tile_row") + 0.5
    return out.withColumn("x", F.col("c") + F.col("a") * x + F.col("b") * y).withColumn("y", F.col("f") + F.col("d") * x + F.col("e") * y).drop("a", "b", "c", "d", "e", "f", "row_off", "col_off")


def ranks_within(df: DataFrame, group: list[str], order: list[Column | str], name: str, total: str | None = None) -> DataFrame:
    """Ranks 1, 2, ... of each group's rows in the given order, which must be total, and the group's size as ``total``.

    Rows are range-partitioned by group and order, so a group of any size is spread over
    tasks. Each part numbers its own rows; only counts, one row for each part and group,
    are summed up across parts.
    """
    spread = durable(df.repartitionByRange(*group, *order).withColumn("_part", F.spark_partition_id()))
    counts = spread.groupBy("_part", *group).count()
    own = Window.partitionBy(*group)
    offsets = counts.select(F.col("_part").alias("_p"), *[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], (F.sum("count").over(own.orderBy("_part")) - F.col("count")).alias("_offset"), F.sum("count").over(own).alias("_total"))
    same = F.col("_part") == F.col("_p")
    for i, g in enumerate(group):
        same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
    numbered = spread.withColumn("_row", F.row_number().over(Window.partitionBy("_part", *group).orderBy(*order))).join(offsets, same)
    out = numbered.withColumn(name, (F.col("_row") + F.col("_offset")).cast("long"))
    out = out.withColumn(total, F.col("_total").cast("long")) if total else out
    return out.drop("_part", "_p", "_row", "_offset", "_total", *[f"_g{i}" for i in range(len(group))])


def consecutive_ids(df: DataFrame, order: list[Column | str], name: str = "sample_id") -> DataFrame:
    """0, 1, 2, ... in the given order, which must be total."""
    return ranks_within(df, [], order, name).withColumn(name, F.col(name) - 1)


def random_holdout(df: DataFrame, key: str, share: float, seed: int) -> DataFrame:
    """``split``: the ceil(share * n) rows of least draw are test, others train."""
    ordered = consecutive_ids(df.withColumn("_u", hash01(key, seed=seed)), ["_u", key], "_at")
    n = df.agg(F.ceil(F.count("*") * F.lit(share)).alias("_test"))
    return ordered.crossJoin(F.broadcast(n)).withColumn("split", F.when(F.col("_at") < F.col("_test"), "test").otherwise("train")).drop("_u", "_at", "_test")


def per_stratum(df: DataFrame, strata: list[str], key: str, quota: Column | int, seed: int) -> DataFrame:
    """Flag ``_taken``: the first ``quota`` rows of a stratum by draw. ``quota`` may use ``_n``, the stratum's size."""
    ranked = ranks_within(df.withColumn("_u", hash01(key, seed=seed)), strata, ["_u", key], "_rank", "_n")
    return ranked.withColumn("_taken", F.col("_rank") <= (quota if isinstance(quota, Column) else F.lit(quota))).drop("_rank", "_u")


def stratified_sample(df: DataFrame, strata: list[str], key: str, n: int, seed: int = 42) -> DataFrame:
    """At most ``n`` rows of each stratum. The rank filter is pushed into the sort, so each task keeps n rows a group."""
    ranked = df.withColumn("_rank", F.row_number().over(Window.partitionBy(*strata).orderBy(hash01(key, seed=seed), key)))
    return ranked.filter(F.col("_rank") <= n).drop("_rank")


def stratified_holdout(df: DataFrame, strata: list[str], key: str, share: float, seed: int) -> DataFrame:
    """``split`` with round(share * n) test rows in each stratum, half to even."""
    flagged = per_stratum(df, strata, key, F.bround(F.col("_n") * F.lit(share)), seed)
    return flagged.withColumn("split", F.when(F.col("_taken"), "test").otherwise("train")).drop("_n", "_taken")


def stratified_fraction(df: DataFrame, strata: list[str], key: str, fraction: float, seed: int) -> DataFrame:
    """max(1, round(n * fraction)) rows of each stratum; all of them at 1."""
    if fraction >= 1:
        return df
    flagged = per_stratum(df, strata, key, F.greatest(F.lit(1), F.bround(F.col("_n") * F.lit(fraction))), seed)
    return flagged.filter("_taken").drop("_n", "_taken")


def validation_and_pool(df: DataFrame, key: str, share: float, seed: int) -> DataFrame:
    """``part``: round(share * n) rows are validation, the rest the pool; ``position`` numbers the rows of each from 0."""
    ordered = consecutive_ids(df.withColumn("_u", hash01(key, seed=seed)), ["_u", key], "_at")
    n = df.agg(F.bround(F.count("*") * F.lit(share)).cast("long").alias("_v"))
    out = ordered.crossJoin(F.broadcast(n))
    held = F.col("_at") < F.col("_v")
    return out.withColumn("part", F.when(held, "validation").otherwise("pool")).withColumn("position", F.when(held, F.col("_at")).otherwise(F.col("_at") - F.col("_v"))).drop("_u", "_at", "_v")


def draw_exactly(df: DataFrame, key: str, m: int, seed: int) -> DataFrame:
    """The ``m`` rows of least draw, without replacement."""
    return df.orderBy(hash01(key, seed=seed), key).limit(m)


def sweep_rows(percent: float, n_all: int, pool: int) -> int:
    return min(round(percent / 100 * n_all), pool)


def random_baseline(split: DataFrame, key: str, target: str, seed: int) -> DataFrame:
    """For each validation row a target drawn with replacement from the pool: an equality join on the pool's positions."""
    pool = split.filter("part = 'pool'").select(F.col("position").alias("_pick"), F.col(target).alias("predicted"))
    n = pool.agg(F.count("*").alias("_size"))
    queries = split.filter("part = 'validation'").crossJoin(F.broadcast(n)).withColumn("_pick", F.floor(hash01(key, seed=seed) * F.col("_size")).cast("long"))
    return queries.join(pool, "_pick").drop("_pick", "_size", "part", "position")


def capped(df: DataFrame, group: list[str], key: str, cap: int, seed: int) -> DataFrame:
    """At most ``cap`` rows of each group (a sampling operator)."""
    return stratified_sample(df, group, key, cap, seed)


def nested_bins(df: DataFrame, strata: list[str], key: str, quotas: list[Column], seed: int, name: str) -> DataFrame:
    """Column ``name``: the number of the first quota that takes the row, ``len(quotas)`` if none does.

    A quota takes that many rows of each stratum by the order of their draws; quotas rise and may use ``_n``, the
    stratum's size, so the samples are nested. Only keys and draws are ranked; each stratum's last
    draw within each quota, one row for a stratum, then tells where its rows belong, which move at most once.
    """
    u = hash01(key, seed=seed)
    place = F.struct(u.alias("u"), F.col(key).alias("k"))
    ranked = ranks_within(df.select(*strata, key).withColumn("_u", u), strata, ["_u", key], "_rank", "_n")
    cuts = ranked.groupBy(*strata).agg(F.array(*[F.max(F.when(F.col("_rank") <= q, F.struct(F.col("_u").alias("u"), F.col(key).alias("k")))) for q in quotas]).alias("_cuts"))
    if strata:
        same = F.lit(True)
        for i, g in enumerate(strata):
            cuts = cuts.withColumnRenamed(g, f"_g{i}")
            same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
        out = df.join(cuts, same, "left").drop(*[f"_g{i}" for i in range(len(strata))])
    else:
        out = df.crossJoin(F.broadcast(cuts))
    beyond = F.size(F.filter("_cuts", lambda c: c.isNull() | (c < place)))
    return out.withColumn(name, beyond).drop("_cuts")


def pair_draw(df: DataFrame, key: str, m: int, seed: int, group: list[str] = ()) -> DataFrame:
    """(group, a, b): exactly min(m, all) distinct unordered pairs of keys of each group, without replacement; a stands before b by key.

    All n (n - 1) / 2 pairs are numbered by l and r as in a round-robin tournament, with n of l and (n - 1) / 2 of r where n is odd,
    n / 2 and n - 1 where it is even. Adding, by turns, a hash of the one to the other is a bijection of
    these numbers, so the images of 0 to m - 1 are m different pairs, each made by itself.
    """
    group = list(group)
    numbered = durable(ranks_within(df.select(*group, key), group, [key], "_at", "_n").withColumn("_at", F.col("_at") - 1))
    n, odd = F.col("_n"), F.col("_n") % 2 == 1
    sizes = numbered.select(*group, "_n").distinct().filter("_n > 1")
    sizes = sizes.withColumn("_a", F.when(odd, n).otherwise(F.expr("_n div 2"))).withColumn("_b", F.when(odd, F.expr("(_n - 1) div 2")).otherwise(n - 1))
    last = F.least(F.lit(m), F.col("_a") * F.col("_b")) - 1
    step = 1000
    chunks = sizes.withColumn("_s", F.explode(F.sequence(F.lit(0).cast("long"), last, F.lit(step).cast("long")))).repartition(*group, "_s")
    drawn = chunks.withColumn("_j", F.explode(F.sequence(F.col("_s"), F.least(F.col("_s") + step - 1, last))))
    turned = lambda to, by, turn, of: (to + F.floor(hash01(by, turn, seed=seed) * of).cast("long")) % of
    even = lambda turn: turn % 2 == 0
    start = F.struct((F.col("_j") % F.col("_a")).alias("l"), F.expr("_j div _a").alias("r"))
    turn = lambda s, t: F.struct(F.when(even(t), turned(s["l"], s["r"], t, F.col("_a"))).otherwise(s["l"]).alias("l"), F.when(even(t), s["r"]).otherwise(turned(s["r"], s["l"], t, F.col("_b"))).alias("r"))
    # A fold, as six nested columns would make the expression grow with every turn; exploded, so that what follows doesn't fold again.
    drawn = drawn.select("*", F.explode(F.array(F.aggregate(F.sequence(F.lit(0), F.lit(PAIR_TURNS - 1)), start, turn))).alias("_p")).withColumns({"_l": F.col("_p")["l"], "_r": F.col("_p")["r"]})
    one = F.when(odd, F.col("_l")).when(F.col("_l") == 0, n - 1).otherwise((F.col("_r") + F.col("_l")) % (n - 1))
    two = F.when(odd, (F.col("_l") + F.col("_r") + 1) % n).when(F.col("_l") == 0, F.col("_r")).otherwise((F.col("_r") - F.col("_l") + n - 1) % (n - 1))
    pairs = drawn.select(*group, one.alias("_x"), two.alias("_y")).select(*group, F.least("_x", "_y").alias("_x"), F.greatest("_x", "_y").alias("_y"))
    for at, name in (("_x", "a"), ("_y", "b")):
        side = numbered.select(*[F.col(g).alias(f"_g{i}") for i, g in enumerate(group)], F.col("_at").alias("_to"), F.col(key).alias(name))
        same = F.col(at) == F.col("_to")
        for i, g in enumerate(group):
            same = same & F.col(g).eqNullSafe(F.col(f"_g{i}"))
        pairs = pairs.join(side, same).drop(at, "_to", *[f"_g{i}" for i in range(len(group))])
    return pairs


#: Turns of the bijection of :func:`pair_draw`.
PAIR_TURNS = 6


def quantile_bin(df: DataFrame, group: list[str], value: str, key: str, bins: int, name: str) -> DataFrame:
    """Quantile bins of a group's ranks (ties by key), by the edges that interpolation gives; not ntile."""
    ranked = ranks_within(df, group, [value, key], "_r", "_n")
    r, n = F.col("_r"), F.col("_n")
    return ranked.withColumn(name, F.when(n == 1, 0).otherwise(F.greatest(F.ceil((r - 1) * bins / F.nullif(n - 1, F.lit(0))) - 1, F.lit(0))).cast("int")).drop("_r", "_n")


def spatial_blocks(df: DataFrame, key: str, region: str = "region", lat: str = "latitude", lon: str = "longitude", bins: int = 4) -> DataFrame:
    """lat_bin, lon_bin and spatial_block = region__lat_lon."""
    out = quantile_bin(quantile_bin(df, [region], lat, key, bins, "lat_bin"), [region], lon, key, bins, "lon_bin")
    return out.withColumn("spatial_block", F.concat(F.col(region), F.lit("__"), F.col("lat_bin"), F.lit("_"), F.col("lon_bin")))


def block_folds(df: DataFrame, block: str, stratum: str, folds: int, seeds: list[int]) -> DataFrame:
    """(block, fold_<seed>, ...): a fold for every block and seed, with rows and strata balanced.

    The blocks of a main stratum, that of most rows, stand in order of their size and are dealt in rounds of ``folds``.
    Of two rounds the largest of the first and the smallest of the second are one fold's, and so on; which fold's is drawn
    anew for each two rounds. What is left of the strata, fewer than ``folds`` small blocks of each, is dealt in the
    same way together. Only one row for each block is ranked, whatever the rows and however many blocks there are.
    A null block is one block, a null stratum one stratum.
    """
    counts = df.groupBy(F.col(block).alias("_b"), F.col(stratum).alias("_s")).count()
    totals = counts.groupBy("_b").agg(F.sum("count").alias("_rows"), F.min(F.struct((-F.col("count")).alias("c"), F.col("_s").alias("s")))["s"].alias("_main"))
    each = totals.withColumn("_seed", F.explode(F.array(*map(F.lit, seeds))))
    draws = F.lit(None)
    for seed in seeds:
        draws = F.when(F.col("_seed") == seed, hash01("_b", seed=seed)).otherwise(draws)
    size_order = [F.desc("_rows"), "_u", "_b"]
    ranked = durable(ranks_within(each.withColumn("_u", draws), ["_seed", "_main"], size_order, "_at", "_n"))
    whole = F.col("_at") <= F.floor(F.col("_n") / folds) * folds
    rest = ranks_within(ranked.filter(~whole).drop("_at", "_n"), ["_seed"], ["_main", *size_order], "_at").withColumn("_deal", F.lit("rest"))
    ranked = ranked.filter(whole).drop("_n").withColumn("_deal", F.coalesce(F.col("_main").cast("string"), F.lit(""))).unionByName(rest)
    place = (F.col("_at") - 1) % (2 * folds)
    ranked = ranked.withColumn("_round", F.floor((F.col("_at") - 1) / (2 * folds))).withColumn("_slot", F.when(place < folds, place).otherwise(2 * folds - 1 - place))

    def slots_before(seed: int) -> Column:
        return F.size(F.filter(F.sequence(F.lit(0), F.lit(folds - 1)), lambda t: hash01("_deal", "_round", t, seed=seed) < hash01("_deal", "_round", "_slot", seed=seed)))

    order = F.lit(None)
    for seed in seeds:
        order = F.when(F.col("_seed") == seed, slots_before(seed)).otherwise(order)
    ranked = ranked.withColumn("_fold", order)
    return ranked.groupBy(F.col("_b").alias(block)).agg(*[F.max(F.when(F.col("_seed") == seed, F.col("_fold"))).alias(f"fold_{seed}") for seed in seeds])


def repeated_folds(df: DataFrame, block: str, stratum: str, folds: int, seeds: list[int]) -> DataFrame:
    """``fold_<seed>`` for each seed: whole blocks in one fold, drawn anew for each seed."""
    found = block_folds(df, block, stratum, folds, seeds).withColumnRenamed(block, "_block")
    return df.join(found, F.col(block).eqNullSafe(F.col("_block")), "left").drop("_block")


def grouped_folds(df: DataFrame, block: str, stratum: str, folds: int, seed: int) -> DataFrame:
    """``fold``: whole blocks in one fold, with rows and strata balanced."""
    return repeated_folds(df, block, stratum, folds, [seed]).withColumnRenamed(f"fold_{seed}", "fold")
