"""Splits, sampling and leakage audits. Random order is always the order of a hash."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from busward.functions.columns import digest_number, safe_divide
from busward.operators.ordering import attach, number_by_hash, number_rows

SPLITS = ("train", "validation", "test")
RATIOS = {"train": 0.70, "validation": 0.15, "test": 0.15}


def signature(columns: Sequence[str]) -> Column:
    """Exact signature of a row over ordered columns, as hex text that other engines can rebuild."""
    return F.md5(F.concat_ws("|", *[F.col(c).cast("string") for c in columns]))


def hash_split(digest: Column) -> Column:
    """70/15/15 by the hash modulo 100."""
    bucket = F.pmod(digest, F.lit(100))
    return F.when(bucket < 70, "train").when(bucket < 85, "validation").otherwise("test")


def position_split(df: DataFrame, keys: Sequence[str], position: str, bounds: Sequence[tuple[str, float]],
                   last: str, into: str = "split") -> DataFrame:
    """Split by position within the keys at fractions of the count; no sort, the position is a column."""
    size = df.groupBy(*keys).agg(F.count(F.lit(1)).alias("_n"))
    named = None
    for name, bound in bounds:
        hit = F.col(position) < F.floor(F.col("_n") * F.lit(float(bound)))
        named = F.when(hit, name) if named is None else named.when(hit, name)
    return attach(df, size, keys).withColumn(into, named.otherwise(last)).drop("_n")


def chronological_split(windows: DataFrame, keys: Sequence[str] = ("capture",), position: str = "window_index") -> DataFrame:
    return position_split(windows, keys, position, (("train", 0.70), ("validation", 0.85)), "test")


def healthy_roles(windows: DataFrame, healthy: str, key: str = "capture", position: str = "window_index") -> DataFrame:
    """Reference, calibration and holdout in time order; every other capture is evaluated."""
    roles = position_split(windows, [key], position,
                           (("healthy_reference", 0.50), ("healthy_calibration", 0.75)), "healthy_holdout", "evaluation_role")
    return roles.withColumn("evaluation_role", F.when(F.col(key) == healthy, F.col("evaluation_role"))
                            .otherwise("external_attack_capture_evaluation"))


def greedy_split(rows: DataFrame, signature: str, label: str) -> DataFrame:
    """Split (signature -> split) that keeps signatures whole and follows 70/15/15 within each class.

    Signatures of several classes go to train. Within a class the groups come largest first, then by
    signature; each empty split gets one group, then each group goes to the split with the largest
    (target - assigned) / target. Groups of equal size are interchangeable for that rule, so only the
    distinct sizes are walked in order (at most sqrt(2 rows) of them per class); which group of a size
    gets which split is a rank join.
    """
    groups = rows.groupBy(label, signature).agg(F.count(F.lit(1)).alias("size"))
    classes = groups.groupBy(signature).agg(F.count(F.lit(1)).alias("_classes"))
    marked = groups.join(classes, signature)
    shared = marked.where(F.col("_classes") > 1)
    single = marked.where(F.col("_classes") == 1).select(label, signature, "size")
    blocks = single.groupBy(label, "size").agg(F.count(F.lit(1)).alias("groups"), F.lit(0).alias("shared"))
    # Shared groups enter as one marker row of their class: their row total in `groups`.
    fixed = shared.groupBy(label).agg(F.lit(0).cast("bigint").alias("size"), F.sum("size").alias("groups"),
                                      F.lit(1).alias("shared"))
    order = rows.select(label).schema[label].dataType.simpleString()
    plan = blocks.unionByName(fixed).groupBy(label).applyInPandas(
        lambda pdf: _walk_sizes(pdf, label),
        f"{label} {order}, size bigint, first bigint, seeds bigint, k0 bigint, k1 bigint, k2 bigint, "
        "a0 double, a1 double, a2 double, t0 double, t1 double, t2 double")
    prefix = F.conv(F.substring(signature, 1, 3), 16, 10).cast("int")
    items = number_rows(single, [label, "size"], [signature], prefix, "_i").join(plan, [label, "size"])
    seeded = items.withColumn("_at", F.col("first") + F.col("_i"))
    has_shared = F.col("seeds") == 2
    seed_split = F.when(has_shared, F.element_at(F.array(F.lit("validation"), F.lit("test")), (F.col("_at") + 1).cast("int"))) \
        .otherwise(F.element_at(F.array(*[F.lit(s) for s in SPLITS]), (F.col("_at") + 1).cast("int")))
    seeds = seeded.where(F.col("_at") < F.col("seeds")).select(signature, seed_split.alias("split"))
    rest = seeded.where(F.col("_at") >= F.col("seeds")).withColumn(
        "_i", F.col("_at") - F.greatest(F.col("first"), F.col("seeds")))
    slot = F.when(F.col("_i") < F.col("k0"), F.struct(F.lit(0).alias("j"), F.col("_i").alias("k"))) \
        .when(F.col("_i") < F.col("k0") + F.col("k1"), F.struct(F.lit(1).alias("j"), (F.col("_i") - F.col("k0")).alias("k"))) \
        .otherwise(F.struct(F.lit(2).alias("j"), (F.col("_i") - F.col("k0") - F.col("k1")).alias("k")))
    slots = rest.withColumn("_slot", slot).withColumn("_j", F.col("_slot.j"))
    target = F.element_at(F.array("t0", "t1", "t2"), F.col("_j") + 1)
    taken = F.element_at(F.array("a0", "a1", "a2"), F.col("_j") + 1) + F.col("_slot.k") * F.col("size")
    slots = slots.withColumn("_need", -((target - taken) / F.greatest(target, F.lit(1.0))))
    ranked = number_rows(slots.select(label, "size", "_need", "_j"), [label, "size"], ["_need", "_j"],
                         F.floor((F.col("_need") + 1.0) * 4096), "_i")
    placed = rest.select(label, "size", "_i", signature).join(ranked, [label, "size", "_i"]).select(
        signature, F.element_at(F.array(*[F.lit(s) for s in SPLITS]), F.col("_j") + 1).alias("split"))
    return shared.select(signature).distinct().withColumn("split", F.lit("train")).unionByName(seeds).unionByName(placed)


def _walk_sizes(pdf: pd.DataFrame, label: str) -> pd.DataFrame:
    """Assigned rows at the start of each size and how many groups of it each split takes."""
    fixed = int(pdf.loc[pdf["shared"] == 1, "groups"].sum())
    blocks = pdf[pdf["shared"] == 0].sort_values("size", ascending=False)
    total = int((blocks["size"] * blocks["groups"]).sum()) + fixed
    targets = [total * r for r in RATIOS.values()]
    assigned = [float(fixed), 0.0, 0.0]
    open_splits = [j for j in range(3) if not (j == 0 and fixed > 0)]
    seeds = len(open_splits)
    first, out = 0, []
    for size, count in zip(blocks["size"], blocks["groups"]):
        size, left = int(size), int(count)
        while left and open_splits:
            assigned[open_splits.pop(0)] += size
            left -= 1
        taken = _fill(left, size, assigned, targets)
        out.append((pdf[label].iloc[0], size, first, seeds, *taken, *assigned, *targets))
        assigned = [a + k * size for a, k in zip(assigned, taken)]
        first += int(count)
    return pd.DataFrame(out, columns=[label, "size", "first", "seeds", "k0", "k1", "k2", "a0", "a1", "a2", "t0", "t1", "t2"])


def _fill(count: int, size: int, assigned: Sequence[float], targets: Sequence[float]) -> list[int]:
    """How many of `count` equal groups each split takes when the largest relative need goes first."""

    def need(j: int, k: int) -> float:
        return (targets[j] - (assigned[j] + k * size)) / max(targets[j], 1.0)

    def above(level: float) -> list[int]:
        taken = []
        for j in range(3):
            k = max(0, min(count, int((targets[j] - assigned[j] - level * max(targets[j], 1.0)) // size)))
            while k < count and need(j, k) > level:
                k += 1
            while k > 0 and need(j, k - 1) <= level:
                k -= 1
            taken.append(k)
        return taken

    low, high = min(need(j, count) for j in range(3)) - 1.0, max(need(j, 0) for j in range(3))
    best = [0, 0, 0]
    for _ in range(80):
        middle = (low + high) / 2.0
        taken = above(middle)
        if sum(taken) <= count:
            best, high = taken, middle
        else:
            low = middle
    while sum(best) < count:
        j = max(range(3), key=lambda x: (need(x, best[x]), -x))
        best[j] += 1
    return best


def stratified_split(df: DataFrame, signature: str, truth: str, source: str, fraction: float, seed: int) -> DataFrame:
    """Signatures to calibration or test within benign-only, attack-only and conflicting strata."""
    groups = df.groupBy(signature).agg(
        F.count(F.lit(1)).alias("rows"), F.sum(truth).alias("attack_rows"), F.countDistinct(source).alias("source_count"))
    stratum = (F.when(F.col("attack_rows") == 0, "benign_only")
               .when(F.col("attack_rows") == F.col("rows"), "attack_only").otherwise("label_conflict"))
    groups = groups.withColumn("label_stratum", stratum)
    size = groups.groupBy("label_stratum").agg(F.count(F.lit(1)).alias("_n"))
    ranked = number_by_hash(groups, ["label_stratum"], digest_number(seed, F.col(signature)), [signature], "_rank")
    wanted = F.rint(F.col("_n") * F.lit(float(fraction)))
    number = F.when(F.col("_n") >= 2, F.least(F.greatest(wanted, F.lit(1)), F.col("_n") - 1)).otherwise(F.col("_n"))
    return ranked.join(size, "label_stratum").withColumn(
        "split", F.when(F.col("_rank") < number, "calibration").otherwise("test")).drop("_rank", "_n")


def crossing_signatures(df: DataFrame, signature: str, column: str) -> DataFrame:
    """Signatures with more than one value of a column, and their rows."""
    return df.groupBy(signature).agg(
        F.countDistinct(column).alias("values"), F.count(F.lit(1)).alias("rows")).where(F.col("values") > 1)


def overlap_audit(df: DataFrame, signature: str, split: str, label: str) -> DataFrame:
    """Totals of repeated, split-crossing and label-conflicting signatures in one pass per signature."""
    per = df.groupBy(signature).agg(F.count(F.lit(1)).alias("_n"), F.countDistinct(split).alias("_s"),
                                    F.countDistinct(label).alias("_l"))
    cross, conflict = F.col("_s") > 1, F.col("_l") > 1
    return per.agg(
        F.sum("_n").alias("total_rows"), F.count(F.lit(1)).alias("unique_signatures"),
        (100.0 * (1 - F.count(F.lit(1)) / F.sum("_n"))).alias("repeated_percentage"),
        F.sum(cross.cast("int")).alias("crossing_signatures"), F.sum(F.when(cross, F.col("_n")).otherwise(0)).alias("crossing_rows"),
        F.sum(conflict.cast("int")).alias("conflicting_signatures"),
        F.sum(F.when(conflict, F.col("_n")).otherwise(0)).alias("conflicting_rows"))


def repetition_audit(df: DataFrame, signature: str, label: str) -> DataFrame:
    """Rows, unique signatures and repetition per class, with a total row."""
    counted = df.groupBy(label, signature).agg(F.count(F.lit(1)).alias("_n"))
    per_class = counted.groupBy(label).agg(F.sum("_n").alias("rows"), F.count(F.lit(1)).alias("unique_signatures"))
    whole = counted.groupBy(signature).agg(F.sum("_n").alias("_n")).agg(
        F.sum("_n").alias("rows"), F.count(F.lit(1)).alias("unique_signatures")).select(
        F.lit("__TOTAL__").alias(label), "rows", "unique_signatures")
    total = counted.agg(F.sum("_n").alias("_all"))
    return attach(per_class.unionByName(whole), total, []).withColumn(
        "repeated_rows", F.col("rows") - F.col("unique_signatures")).withColumn(
        "repetition_percentage", 100.0 * F.col("repeated_rows") / F.col("rows")).withColumn(
        "dataset_percentage", 100.0 * F.col("rows") / F.col("_all")).drop("_all")


def capture_roles(names: DataFrame, name: str, salt: str, bounds: Sequence[tuple[str, int]]) -> DataFrame:
    """Roles by the order of sha256(salt:name); each role takes its count of captures in turn."""
    hashed = names.select(name).distinct().withColumn("_h", F.sha2(F.concat(F.lit(f"{salt}:"), F.col(name)), 256))
    ranked = number_rows(hashed, [], ["_h"], F.conv(F.substring("_h", 1, 3), 16, 10).cast("int"), "_rank")
    role, upto = None, 0
    for value, count in bounds:
        upto += count
        hit = F.col("_rank") < upto
        role = F.when(hit, value) if role is None else role.when(hit, value)
    return ranked.select(name, role.otherwise("unused").alias("role"))


def run_partitions(runs: DataFrame, run: str, develop: int, confirm: int) -> DataFrame:
    """First runs develop, last runs confirm. Each end is a top-k, so runs are never sorted whole."""
    names = runs.select(run).distinct()
    first = names.orderBy(F.col(run).asc()).limit(develop).withColumn("partition", F.lit("development"))
    last = names.orderBy(F.col(run).desc()).limit(confirm).withColumn("partition", F.lit("confirmation"))
    return first.unionByName(last.join(first, run, "left_anti"))


def shuffled_labels(df: DataFrame, key: Sequence[str], label: str, seed: int, into: str = "shuffled") -> DataFrame:
    """Labels permuted over all rows: two independent hash orders are joined by rank."""
    text = [F.col(k).cast("string") for k in key]
    rows = number_by_hash(df, [], digest_number(seed, "row", *text), key, "_r")
    labels = number_by_hash(df.select(*key, label), [], digest_number(seed, "label", *text), key, "_r")
    return rows.join(labels.select("_r", F.col(label).alias(into)), "_r").drop("_r")


def leave_one_out(df: DataFrame, split: str, label: str, benign: str) -> DataFrame:
    """Every held-out class with its training, validation and test rows."""
    classes = df.where(F.col(label) != benign).agg(F.array_sort(F.collect_set(label))).scalar()
    held = df.withColumn("held_out", F.explode(classes))
    fits = (F.col(split) != "test") & (F.col(label) != F.col("held_out"))
    tests = (F.col(split) == "test") & ((F.col(label) == benign) | (F.col(label) == F.col("held_out")))
    return held.where(fits | tests)


def disjoint_allocation(pool: DataFrame, runs: Sequence[str], keys: Sequence[str], item: str, need: Mapping[str, int],
                        band: str, seed: int) -> DataFrame:
    """Windows for every run so that no window serves twice; scarce bands draw first.

    `need` maps bands to windows per run, scarce ones first; the last entry draws from what they leave.
    Runs take consecutive slices of one hash order per (keys, band), so nothing is shared between tasks.
    """
    *scarce, rest = need
    digest = digest_number(seed, *[F.col(k) for k in keys], F.col(item).cast("string"))
    ranked = number_by_hash(pool, [*keys, band], digest, [item], "_rank")
    names = F.array(*[F.lit(r) for r in runs])
    quota = F.lit(0)
    for name in scarce:
        quota = F.when(F.col(band) == name, need[name]).otherwise(quota)
    slot = F.floor(F.col("_rank") / F.when(quota > 0, quota))
    first = ranked.where(slot < len(runs)).select(*keys, item, F.col(band).alias("drawn_for"),
                                                  F.get(names, slot.cast("int")).alias("run"))
    left = ranked.where((quota == 0) | (slot >= len(runs))).drop("_rank")
    again = number_by_hash(left, list(keys), digest, [item], "_rank")
    slot = F.floor(F.col("_rank") / need[rest])
    second = again.where(slot < len(runs)).select(*keys, item, F.lit(rest).alias("drawn_for"),
                                                  F.get(names, slot.cast("int")).alias("run"))
    return first.unionByName(second)


def allocation_shortages(pool: DataFrame, allocated: DataFrame, runs: Sequence[str], keys: Sequence[str], need: Mapping[str, int]) -> DataFrame:
    """keys, drawn_for, run, asked, got: the runs for which a pool had fewer windows than were asked for."""
    grid = F.array(*[F.struct(F.lit(b).alias("drawn_for"), F.lit(r).alias("run"), F.lit(n).alias("asked")) for b, n in need.items() for r in runs])
    asked = pool.select(*keys).distinct().select(*keys, F.explode(grid).alias("_g")).select(*keys, "_g.*")
    got = allocated.groupBy(*keys, "drawn_for", "run").agg(F.count(F.lit(1)).alias("got"))
    joined = asked.join(got, [*keys, "drawn_for", "run"], "left").withColumn("got", F.coalesce("got", F.lit(0)))
    return joined.where(F.col("got") < F.col("asked"))


def capacity_audit(pool: DataFrame, used: DataFrame, keys: Sequence[str], item: str, band: str, required: DataFrame) -> DataFrame:
    """Unique, used and unseen windows per pool against the requirement (columns band, required)."""
    whole = pool.groupBy(*keys, band).agg(F.countDistinct(item).alias("total_unique"))
    unseen = pool.join(used.select(*keys, item).distinct(), [*keys, item], "left_anti").groupBy(*keys, band).agg(
        F.countDistinct(item).alias("unseen_unique"))
    return whole.join(unseen, [*keys, band], "left").join(required, band).fillna(0, ["unseen_unique"]).withColumn(
        "used_unique", F.col("total_unique") - F.col("unseen_unique")).withColumn(
        "exhaustion_rate", safe_divide(F.col("used_unique"), F.col("total_unique"))).withColumn(
        "feasible", (F.col("unseen_unique") >= F.col("required")).cast("int"))


def contaminated_baselines(baseline: DataFrame, pool: DataFrame, keys: Sequence[str], position: str, value: str,
                           counts: Sequence[int], repetitions: int, seed: int) -> DataFrame:
    """Baselines with c of their k windows replaced by attack windows, r times for every c.

    A baseline has k rows. The pool keeps one hash order; every (c, repetition) draws a slice of it.
    """
    grid = F.array(*[F.struct(F.lit(c).alias("contaminated"), F.lit(r).alias("repetition"))
                     for c in counts for r in range(repetitions)])
    rows = baseline.select(*keys, position, value, F.explode(grid).alias("_g")).select(*keys, position, value, "_g.*")
    parts = [*[F.col(k) for k in keys], F.col("contaminated").cast("string"), F.col("repetition").cast("string")]
    ranked = number_by_hash(rows, [*keys, "contaminated", "repetition"],
                            digest_number(seed, *parts, F.col(position).cast("string")), [position], "_order")
    text = [*[F.col(k) for k in keys], F.col("_item").cast("string")]
    pooled = number_by_hash(pool, keys, digest_number(seed, "pool", *text), ["_item"], "_pick")
    size = pool.groupBy(*keys).agg(F.count(F.lit(1)).alias("_size"))
    asked = ranked.join(size, list(keys)).withColumn("_pick", F.when(
        F.col("_order") < F.col("contaminated"), F.pmod(digest_number(seed, "offset", *parts) + F.col("_order"), F.col("_size"))))
    drawn = asked.join(pooled.select(*keys, "_pick", F.col(value).alias("_drawn")), [*keys, "_pick"], "left")
    return drawn.select(*keys, "contaminated", "repetition", position,
                        F.coalesce("_drawn", value).alias(value),
                        F.col("_drawn").isNotNull().cast("int").alias("replaced"))


def reservoir(df: DataFrame, keys: Sequence[str], item: Sequence[str], capacity: int, seed: int) -> DataFrame:
    """Uniform sample of at most `capacity` rows per key: the smallest hashes.

    Rows are first counted by the level of their hash (a 64th of a power of two), at most 2 048 levels of a
    key. These counts fix each key's last level, and only the rows up to it are ranked: `capacity` and a few
    per cent, whatever the key holds.
    """
    keys = list(keys)
    rows = df.withColumn("_d", digest_number(seed, *[F.col(c).cast("string") for c in item]))
    rows = rows.withColumn("_level", F.floor(64 * F.log2(F.col("_d") + 1)))
    upto = Window.partitionBy(*keys).orderBy("_level").rowsBetween(Window.unboundedPreceding, -1)
    levels = rows.groupBy(*keys, "_level").agg(F.count(F.lit(1)).alias("_n")).withColumn("_below", F.coalesce(F.sum("_n").over(upto), F.lit(0)))
    last = levels.where(F.col("_below") < capacity).groupBy(*keys).agg(F.max("_level").alias("_last"))
    near = attach(rows, last, keys).where(F.col("_level") <= F.col("_last"))
    order = Window.partitionBy(*keys).orderBy("_d", *item)
    return near.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= capacity).select(*df.columns)


def balanced_sample(df: DataFrame, key: str, position: str) -> DataFrame:
    """Evenly spaced rows of each capture, as many as the smallest capture has.

    Whether a position is one of round(i (n-1)/(target-1)) is decided from the position alone.
    """
    size = df.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    least = size.agg(F.min("_n")).scalar()
    rows = df.join(size, key).withColumn("_target", least)
    step = (F.col("_n") - 1) / (F.col("_target") - 1)
    near = F.floor(F.col(position) / step)
    hit = (F.col("_n") == F.col("_target"))
    for shift in (0, 1):
        i = near + shift
        hit = hit | ((i < F.col("_target")) & (F.rint(i * step) == F.col(position)))
    return rows.where(hit).drop("_n", "_target")
