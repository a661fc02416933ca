"""Attributes as they were known at event time.

A version of an entity counts from the moment it is both in force and recorded. Replaying versions
in that order of availability, and leaving out those that a better one precedes, gives current-state
versions, and then an ordinary as-of join finds the state at each event. The join runs in embedded DuckDB, bucket
by bucket. Buckets hash the entity together with a slice of availability time; slice bounds are
quantiles over all versions and the state carried into each slice comes from a pre-aggregated
maximum per entity and slice, so that one entity with a third of all rows is spread over the slices.

Defined results: versions without entity, valid_from or recorded_at are never known; repeated
versions count once; of versions with equal times the greatest of the remaining values is taken
(`order_by` first); an event with a null entity or time knows nothing; an event that repeats gives a
row each time.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema

from fixtura.session import cut_lineage

ROWS_PER_BUCKET = 250_000
MAX_SLICES = 4096
#: Versions that are superseded when they become available are left out; a key orders (valid, recorded).
_JOIN = """
    WITH keyed AS (SELECT *, valid::HUGEINT * 18446744073709551616::HUGEINT + recorded AS key FROM versions),
    states AS (
        SELECT * FROM keyed
        QUALIFY key >= coalesce(max(key) OVER (PARTITION BY entity, slice ORDER BY available ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), key)
    )
    SELECT {columns}, s.entity IS NOT NULL AS known
    FROM events e
    ASOF LEFT JOIN states s
    ON e.entity = s.entity AND e.slice = s.slice AND e.moment >= s.available
"""


def _join_bucket(columns: list[str], out: pa.Schema):  # noqa: ANN202
    """The join of one bucket, in DuckDB; `columns` are taken of the event (e.) or of the state (s.)."""
    query = _JOIN.format(columns=", ".join(columns))

    def join(events: pa.Table, versions: pa.Table) -> pa.Table:
        import duckdb

        with duckdb.connect(":memory:", config={"threads": 1, "memory_limit": "400MB"}) as con:
            con.register("events", events)
            con.register("versions", versions)
            return con.sql(query).to_arrow_table().select(out.names).cast(out)

    return join


def state_as_of(
    events: DataFrame,
    versions: DataFrame,
    entity: str,
    event_id: str,
    event_time: str,
    values: list[str],
    valid_from: str = "valid_from",
    recorded_at: str = "recorded_at",
    order_by: list[str] | None = None,
    kept: list[str] | None = None,
    rows_per_bucket: int = ROWS_PER_BUCKET,
) -> DataFrame:
    """(event_id, entity, *kept, known, *values) for each row of `events`; `kept` are columns of it.

    Known at an event is the version of its entity with valid_from and recorded_at both at or before
    the event, of several the one with the latest valid_from, then the latest recorded_at.
    """
    kept = kept or []
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    rest = [*(order_by or []), *values]
    offset = len(order_by or [])
    usable = versions.filter(F.col(entity).isNotNull() & F.col(valid_from).isNotNull() & F.col(recorded_at).isNotNull())
    rank = F.struct(micros(valid_from).alias("valid"), micros(recorded_at).alias("recorded"), *[F.col(c).alias(f"r{i}") for i, c in enumerate(rest)])
    # ties of availability are settled before the join: one state per entity and moment
    moments = usable.select(F.col(entity).cast("string").alias("entity"), F.greatest(micros(valid_from), micros(recorded_at)).alias("available"), rank.alias("rank")).groupBy("entity", "available").agg(F.max("rank").alias("rank"))
    moments = cut_lineage(moments)
    asked = events.select(F.col(event_id).alias("event_id"), F.col(entity).cast("string").alias("entity"), micros(event_time).alias("moment"), *[F.col(c).alias(f"k{i}") for i, c in enumerate(kept)])
    size = moments.count()
    slices = min(MAX_SLICES, max(4, size // rows_per_bucket * 4))
    bounds = moments.agg(F.percentile_approx("available", [i / slices for i in range(1, slices)], 10_000)).first()[0] or []
    bounds = F.array(*[F.lit(b) for b in sorted(set(bounds))]) if bounds else F.array().cast("array<bigint>")
    # slice of a moment: how many bounds lie at or below it
    slice_of = lambda c: F.size(F.filter(bounds, lambda b: b <= c)) if slices <= 64 else _slot(bounds, c)
    moments = moments.withColumn("slice", slice_of(F.col("available")))
    answerable = F.col("entity").isNotNull() & F.col("moment").isNotNull()
    ours = asked.filter(answerable).withColumn("slice", slice_of(F.col("moment")))
    # the state carried into a slice: the greatest rank of the slices before it, for all slices in use
    in_use = moments.select("entity", "slice", "rank").unionByName(ours.select("entity", "slice").distinct().withColumn("rank", F.lit(None).cast(moments.schema["rank"].dataType)))
    before = Window.partitionBy("entity").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    carried = in_use.groupBy("entity", "slice").agg(F.max("rank").alias("rank")).withColumn("rank", F.max("rank").over(before)).filter("rank is not null")
    # the replay within a slice is left to the join, which has all of it at hand
    theirs = moments.select("entity", "slice", "available", "rank").unionByName(carried.select("entity", "slice", F.lit(-(1 << 62)).alias("available"), "rank"))
    buckets = max(8, (size // rows_per_bucket + 1) * 2)
    bucket = F.pmod(F.xxhash64("entity", "slice"), F.lit(buckets))
    theirs = theirs.select(bucket.alias("bucket"), "entity", "slice", "available", "rank.valid", "rank.recorded", *[F.col(f"rank.r{i + offset}").alias(f"v{i}") for i in range(len(values))])
    types = dict(asked.dtypes) | {f"v{i}": versions.schema[c].dataType.simpleString() for i, c in enumerate(values)} | {"known": "boolean"}
    names = ["event_id", "entity", *[f"k{i}" for i in range(len(kept))], "known", *[f"v{i}" for i in range(len(values))]]
    schema = ", ".join(f"{n} {types[n]}" for n in names)
    columns = ["e.event_id", "e.entity", *[f"e.k{i}" for i in range(len(kept))], *[f"s.v{i}" for i in range(len(values))]]
    spark = events.sparkSession
    join = _join_bucket(columns, to_arrow_schema(spark.createDataFrame([], schema).schema))
    found = ours.withColumn("bucket", bucket).groupBy("bucket").cogroup(theirs.groupBy("bucket")).applyInArrow(join, schema)
    unknown = asked.filter(~answerable).select("event_id", "entity", *[f"k{i}" for i in range(len(kept))], F.lit(False).alias("known"), *[F.lit(None).cast(types[f"v{i}"]).alias(f"v{i}") for i in range(len(values))])
    both = found.unionByName(unknown)
    return both.select("event_id", "entity", *[F.col(f"k{i}").alias(c) for i, c in enumerate(kept)], "known", *[F.col(f"v{i}").alias(c) for i, c in enumerate(values)])


def _slot(bounds, value):  # noqa: ANN001, ANN202
    """Number of sorted bounds at or below a value, by halving instead of scanning."""
    zero = F.struct(F.lit(0).alias("low"), F.size(bounds).alias("high"))
    step = lambda s, _: F.when(s["low"] >= s["high"], s).otherwise(
        F.when(F.element_at(bounds, F.floor((s["low"] + s["high"]) / 2).cast("int") + 1) <= value, F.struct((F.floor((s["low"] + s["high"]) / 2) + 1).cast("int").alias("low"), s["high"].alias("high"))).otherwise(
            F.struct(s["low"].alias("low"), F.floor((s["low"] + s["high"]) / 2).cast("int").alias("high"))
        )
    )
    return F.aggregate(F.sequence(F.lit(1), F.lit(13)), zero, step)["low"]
