"""Which runs to merge, as queries over the manifest, and the merge itself."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from palimpsest.operators.versions import newest

MOST = 2**64 - 1


def level_capacity(base: int, level: int) -> int:
    """Ten times that of the level above, up to the greatest unsigned number of 64 bits."""
    return min(base * 10 ** (level - 1), MOST)


def base_size(memtable: int, trigger: int) -> int:
    """The capacity of level 1; an error beyond 64 bits."""
    size = memtable * trigger * 10
    if size > MOST:
        raise OverflowError("the base size exceeds 64 bits")
    return size


def tiered_plan(files: DataFrame, trigger: int) -> DataFrame:
    """(file_id, output_level): all runs of level 0 once there are as many as the trigger."""
    fresh = files.where("level = 0")
    enough = fresh.agg(F.count("*").alias("n")).where(F.col("n") >= trigger)
    return fresh.select("file_id").join(F.broadcast(enough), how="left_semi").select("file_id", F.lit(1).alias("output_level"))


def _overlapping(inputs: DataFrame, files: DataFrame, level) -> DataFrame:
    """Runs of a level that overlap the range of all inputs taken together."""
    hull = inputs.agg(F.min("smallest_key").alias("lo"), F.max("largest_key").alias("hi"))
    return files.where(level).join(F.broadcast(hull), (F.col("smallest_key") <= F.col("hi")) & (F.col("largest_key") >= F.col("lo")), "left_semi")


def leveled_l0_plan(files: DataFrame, trigger: int) -> DataFrame:
    """Level 0, once it has as many runs as the trigger, and the runs of level 1 that overlap it."""
    fresh = files.where("level = 0")
    enough = fresh.agg(F.count("*").alias("n")).where(F.col("n") >= trigger)
    chosen = fresh.unionByName(_overlapping(fresh, files, F.col("level") == 1))
    return chosen.join(F.broadcast(enough), how="left_semi").select("file_id", F.lit(1).alias("output_level"))


def leveled_overflow_plan(files: DataFrame, trigger: int, base: int) -> DataFrame:
    """While level 0 is below the trigger: of the shallowest level beyond its capacity the oldest run, and what it overlaps one level down."""
    sizes = files.where("level > 0").groupBy("level").agg(F.sum("data_bytes").alias("bytes"))
    # beyond 20 levels every capacity is at its ceiling
    capacity = F.element_at(F.array(*(F.lit(str(level_capacity(base, k))).cast("decimal(20,0)") for k in range(1, 22))), F.least("level", F.lit(21)).cast("int"))
    full = sizes.where(F.col("bytes").cast("decimal(38,0)") > capacity).agg(F.min("level").alias("full"))
    calm = files.agg(F.count_if(F.expr("level = 0")).alias("n")).where(F.col("n") < trigger)
    tagged = files.join(F.broadcast(full)).join(F.broadcast(calm), how="left_semi").where("full IS NOT NULL")
    oldest = tagged.where("level = full").agg(F.min("file_id").alias("file_id"))
    first = tagged.join(F.broadcast(oldest), "file_id", "left_semi")
    chosen = first.unionByName(_overlapping(first, tagged, F.col("level") == F.col("full") + 1))
    return chosen.select("file_id", (F.col("full") + 1).cast("int").alias("output_level"))


def merge_runs(runs: DataFrame, plan: DataFrame) -> DataFrame:
    """The newest version of each key in the planned runs, deletes kept, at the output level."""
    chosen = runs.drop("level").join(F.broadcast(plan.select("file_id", "output_level")), "file_id")
    return newest(chosen).select("user_key", "seq", "op", "value", F.col("output_level").alias("level"))


def after(runs: DataFrame, plan: DataFrame, new_file_id: int) -> DataFrame:
    """All runs once the plan has been carried out."""
    rest = runs.join(F.broadcast(plan.select("file_id")), "file_id", "left_anti")
    merged = merge_runs(runs, plan).withColumn("file_id", F.lit(new_file_id).cast("long"))
    return rest.select("file_id", "level", "user_key", "seq", "op", "value").unionByName(merged.select("file_id", "level", "user_key", "seq", "op", "value"))


def orphans(listing: DataFrame, files: DataFrame, durable_epoch: int) -> DataFrame:
    """Of files (name, kind, id): runs that no manifest names, and logs that are durable already."""
    runs = listing.where("kind = 'sst'").join(files.select(F.col("file_id").alias("id")), "id", "left_anti")
    logs = listing.where("kind = 'wal'").where(F.col("id") <= durable_epoch)
    return runs.select("name", "kind", "id").unionByName(logs.select("name", "kind", "id"))


def recovered(frames: DataFrame, durable_epoch: int) -> DataFrame:
    """Frames (epoch, pos, good, ...) that replay applies: in each epoch that is not durable yet, those before its first bad one."""
    live = frames.where(F.col("epoch") > durable_epoch)
    first_bad = live.where("NOT good").groupBy("epoch").agg(F.min("pos").alias("bad_pos"))
    return live.join(first_bad, "epoch", "left").where("bad_pos IS NULL OR pos < bad_pos").drop("bad_pos")


def to_fixpoint(runs: DataFrame, plan_of, store, new_file_id: int, most_rounds: int = 1000) -> DataFrame:
    """Runs after as many plans as it takes until plan_of(runs) is empty; store() writes each round's runs and returns them as read."""
    for k in range(most_rounds):
        plan = store(plan_of(runs))
        if plan.isEmpty():
            return runs
        runs = store(after(runs, plan, new_file_id + k))
    raise RuntimeError("compaction did not settle")
