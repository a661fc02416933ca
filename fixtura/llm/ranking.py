"""One global ranking from paired comparisons with ties and an advantage of the first position.

The model (Davidson 1970, with an order effect): first wins ~ exp(s_i + h), second wins ~ exp(s_j), a
tie ~ exp(d + (s_i + s_j + h) / 2), each strength with a normal penalty. The log-likelihood is
concave and only needs counts per ordered pair, which Spark aggregates with map-side combine. Newton
steps solve a system whose matrix is a weighted graph Laplacian, by conjugate gradients.

Everything that a Newton step or a product with the matrix needs is a sum over pairs. Up to
`most_pairs` pairs lie in one task that adds them up in memory; more of them stay spread over the
cluster, where each sum is a pass over the partitions with the strengths broadcast (their number is
checked) and partial sums combined in pieces of bounded size. The steps are the same code in both
cases, and a fit that does not reach the tolerance raises.

Defined results: comparisons without both items, with itself, or without a known outcome count for
nothing; repeated rows count each time (deduplicate before); no comparisons give an empty ranking;
an item that only ever won or lost has a finite strength because of the penalty.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from fixtura.operators.joins import join_lookup
from fixtura.session import cut_lineage

MOST_PAIRS, MOST_ITEMS = 1_000_000, 2_000_000
#: Items of one piece of a partial sum.
PIECE = 65_536
PENALTY = 0.25
GAP_BUCKETS = 4096


def pair_counts(comparisons: DataFrame, first: str, second: str, outcome: str, wins: tuple[str, str, str] = ("H", "D", "A")) -> DataFrame:
    """(first, second, won, tied, lost) per ordered pair, `won` by the first."""
    kept = comparisons.select(F.col(first).cast("string").alias("first"), F.col(second).cast("string").alias("second"), F.col(outcome).alias("o"))
    kept = kept.filter((F.col("first") != F.col("second")) & F.col("o").isin(*wins))
    return kept.groupBy("first", "second").agg(*[F.count_if(F.col("o") == w).cast("double").alias(n) for w, n in zip(wins, ("won", "tied", "lost"), strict=True)])


def _probabilities(gap: np.ndarray, tie: float) -> tuple[np.ndarray, np.ndarray]:
    """P(first wins), P(tie) for s_i + h - s_j = gap."""
    top = np.maximum(np.maximum(gap, 0.0), tie + gap / 2)
    a, d, b = np.exp(gap - top), np.exp(tie + gap / 2 - top), np.exp(-top)
    total = a + d + b
    return a / total, d / total


def pair_sums(i: np.ndarray, j: np.ndarray, won: np.ndarray, tied: np.ndarray, lost: np.ndarray, s: np.ndarray, extra: np.ndarray, along: tuple[np.ndarray, np.ndarray] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sums over pairs, (per item, for all): of the log-likelihood, its slope and the parts of its
    curvature at (s, extra), or, given a direction, of the curvature's product with it."""
    items, n, points = len(s), won + tied + lost, won + tied / 2
    gap = s[i] + extra[0] - s[j]
    first, tie = _probabilities(gap, extra[1])
    mean = first + tie / 2
    weight, cross = n * (first + tie / 4 - mean**2), n * tie * (0.5 - mean)
    spread = lambda x: np.bincount(i, x, items) - np.bincount(j, x, items)
    if along is not None:
        step = along[0][i] - along[0][j]
        flow = weight * (step + along[1][0]) + cross * along[1][1]
        return spread(flow)[None], np.array([flow.sum(), cross @ (step + along[1][0]) + (n * tie * (1 - tie)).sum() * along[1][1]])
    top = np.maximum(np.maximum(gap, 0.0), extra[1] + gap / 2)
    log_total = top + np.log(np.exp(gap - top) + np.exp(extra[1] + gap / 2 - top) + np.exp(-top))
    off = points - n * mean
    ends = np.bincount(i, weight, items) + np.bincount(j, weight, items)
    value = points @ gap + tied.sum() * extra[1] - n @ log_total
    return np.stack([spread(off), ends]), np.array([value, off.sum(), (tied - n * tie).sum(), weight.sum(), (n * tie * (1 - tie)).sum()])


def maximise(sums: Callable[..., tuple[np.ndarray, np.ndarray]], items: int, penalty: float = PENALTY, steps: int = 60, tolerance: float = 1e-9) -> tuple[np.ndarray, float, float]:
    """(strengths, advantage, tie parameter) at the maximum of the penalised likelihood: Newton steps
    with backtracking, each solved by preconditioned conjugate gradients, ever more exactly.
    `sums(s, extra, along)` gives the sums of `pair_sums` over all pairs."""
    s, extra = np.zeros(items), np.zeros(2)
    small = penalty * 1e-3

    def at(s: np.ndarray, extra: np.ndarray) -> tuple[float, np.ndarray, np.ndarray, np.ndarray]:
        (slope, ends), (value, *slope_all, hh, dd) = sums(s, extra, None)
        value -= penalty / 2 * (s @ s) + small / 2 * (extra @ extra)
        return value, np.r_[slope - penalty * s, np.array(slope_all) - small * extra], np.r_[ends + penalty, hh + small + 1e-9, dd + small + 1e-9], np.abs(np.r_[s, extra])

    now, slope, diagonal, _ = at(s, extra)
    scale = max(1.0, float(diagonal.max(initial=0)))
    for _ in range(steps):
        off = float(np.abs(slope).max(initial=0))
        if off <= tolerance * scale:
            return s, float(extra[0]), float(extra[1])

        def times(v: np.ndarray) -> np.ndarray:
            per_item, for_all = sums(s, extra, (v[:-2], v[-2:]))  # noqa: B023
            return np.r_[per_item[0] + penalty * v[:-2], for_all + (small + 1e-9) * v[-2:]]

        x, r = np.zeros(items + 2), slope.copy()
        z = r / diagonal
        p, rz = z.copy(), float(r @ z)
        goal = rz * min(0.01, off / scale) ** 2
        for _ in range(500):
            q = times(p)
            a = rz / float(p @ q)
            x, r = x + a * p, r - a * q
            z = r / diagonal
            rz, before = float(r @ z), rz
            if rz <= max(goal, 1e-30):
                break
            p = z + rz / before * p
        size = 1.0
        while True:
            after, slope_after, diagonal_after, _ = at(s + size * x[:-2], extra + size * x[-2:])
            if after >= now - 1e-12 * max(1.0, abs(now)):
                break
            size /= 2
            if size < 1e-9:
                raise ArithmeticError("the likelihood does not rise along the Newton step")
        s, extra, now, slope, diagonal = s + size * x[:-2], extra + size * x[-2:], after, slope_after, diagonal_after
    raise ArithmeticError(f"no maximum within {steps} Newton steps")


def fit_strengths(i: np.ndarray, j: np.ndarray, won: np.ndarray, tied: np.ndarray, lost: np.ndarray, items: int, penalty: float = PENALTY) -> tuple[np.ndarray, float, float]:
    """(strengths, advantage, tie parameter) of pairs in memory; i, j are codes of their items."""
    return maximise(lambda s, extra, along: pair_sums(i, j, won, tied, lost, s, extra, along), items, penalty)


def _fit_in_task(penalty: float):  # noqa: ANN202
    def fit(pairs: pa.Table) -> pa.Table:
        both = pa.chunked_array(pairs["first"].chunks + pairs["second"].chunks, pa.string()).dictionary_encode().unify_dictionaries()
        names = both.chunk(0).dictionary if both.num_chunks else pa.array([], pa.string())
        codes = np.concatenate([c.indices.to_numpy() for c in both.chunks])
        half = pairs.num_rows
        won, tied, lost = (pairs[c].to_numpy() for c in ("won", "tied", "lost"))
        i, j = codes[:half], codes[half:]
        s, _, _ = fit_strengths(i, j, won, tied, lost, len(names), penalty)
        met = np.bincount(i, won + tied + lost, len(names)) + np.bincount(j, won + tied + lost, len(names))
        return pa.table({"item": names, "strength": pa.array(s, pa.float64()), "comparisons": pa.array(np.rint(met).astype(np.int64))})

    return fit


def rank_items(comparisons: DataFrame, first: str, second: str, outcome: str, wins: tuple[str, str, str] = ("H", "D", "A"), penalty: float = PENALTY, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """(item, strength, comparisons) of every item that was compared."""
    pairs = cut_lineage(pair_counts(comparisons, first, second, outcome, wins))
    if pairs.limit(most_pairs + 1).count() > most_pairs:
        return _fit_in_place(pairs, penalty)
    return pairs.withColumn("_all", F.lit(0)).groupBy("_all").applyInArrow(_fit_in_task(penalty), "item string, strength double, comparisons long")


def _coded(pairs: DataFrame) -> tuple[DataFrame, DataFrame, int]:
    """(items with dense codes, pairs by codes, number of items)."""
    total = F.col("won") + F.col("tied") + F.col("lost")
    ends = pairs.select(F.explode(F.array("first", "second")).alias("item"), total.alias("n"))
    items = cut_lineage(ends.groupBy("item").agg(F.sum("n").alias("n")).withColumn("part", F.spark_partition_id()))
    sizes = sorted(items.groupBy("part").count().collect())  # one row per partition
    before, number = {}, 0
    for part, size in sizes:
        before[part] = number
        number += size
    if number > MOST_ITEMS:
        raise ValueError(f"more than {MOST_ITEMS} items: their strengths are broadcast")
    offset = F.create_map(*[F.lit(x) for pair in before.items() for x in pair])
    code = (F.row_number().over(Window.partitionBy("part").orderBy("item")) - 1 + F.try_element_at(offset, F.col("part"))).cast("int")
    items = cut_lineage(items.select("item", "n", code.alias("code")))
    codes = lambda side: items.select(F.col("item").alias(side), F.col("code").alias(f"{side}_code"))
    coded = join_lookup(join_lookup(pairs, codes("first"), ["first"]), codes("second"), ["second"])
    return items, cut_lineage(coded.select("first_code", "second_code", "won", "tied", "lost")), number


def _fit_in_place(pairs: DataFrame, penalty: float) -> DataFrame:
    """The same fit with the pairs left where they are: a sum is a pass over their partitions."""
    items, coded, number = _coded(pairs)
    spark = pairs.sparkSession

    def sums(s: np.ndarray, extra: np.ndarray, along: tuple | None) -> tuple[np.ndarray, np.ndarray]:
        shared = spark.sparkContext.broadcast((s, extra, along))

        def part(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            per_item = for_all = None
            for batch in batches:
                i, j, *counts = (c.to_numpy(zero_copy_only=False) for c in batch.columns)
                a, b = pair_sums(i, j, *counts, *shared.value)
                per_item, for_all = (a, b) if per_item is None else (per_item + a, for_all + b)
            if per_item is not None:
                pieces = [np.ascontiguousarray(per_item[:, k : k + PIECE]).tobytes() for k in range(0, number, PIECE)] + [for_all.tobytes()]
                yield pa.RecordBatch.from_arrays([pa.array(range(len(pieces)), pa.int32()), pa.array(pieces, pa.binary())], names=["piece", "sums"])

        def together(rows: pa.Table) -> pa.Table:
            total = sum(np.frombuffer(b.as_py()) for b in rows["sums"])
            return pa.table({"piece": rows["piece"][:1], "sums": pa.array([total.tobytes()], pa.binary())})

        rows = dict(coded.mapInArrow(part, "piece int, sums binary").groupBy("piece").applyInArrow(together, "piece int, sums binary").collect())
        shared.destroy()
        for_all = np.frombuffer(rows.pop(max(rows)))
        height = 2 if along is None else 1
        return np.concatenate([np.frombuffer(rows[k]).reshape(height, -1) for k in sorted(rows)], axis=1), for_all

    strengths, _, _ = maximise(sums, number, penalty)
    fitted = spark.createDataFrame(pa.table({"code": pa.array(np.arange(number, dtype=np.int32)), "strength": pa.array(strengths)}))
    return items.join(fitted, "code").select("item", "strength", F.col("n").cast("long").alias("comparisons"))


def cut_at_gap(least: np.ndarray, most: np.ndarray, n: np.ndarray) -> float:
    """The strength that ends the top group, of ascending buckets (least, most, n).

    Noise fills a gap between many items, so the widest step between neighbours is not it: the gap is
    the deepest valley of the smoothed density below a top mode (at most half of all lie above), and
    within the valley the cut is the widest step.
    """
    total, middle = n.sum(), (least + most) / 2
    mean = (n @ middle) / total
    width = 0.5 * np.sqrt(n @ (middle - mean) ** 2 / total) * total**-0.2
    grid = np.linspace(least[0], most[-1], 2000)
    density = np.zeros(len(grid))
    for m, k in zip(middle, n, strict=True):
        density += k * np.exp(-0.5 * ((grid - m) / width) ** 2)
    below, above = np.maximum.accumulate(density), np.maximum.accumulate(density[::-1])[::-1]
    tail = np.array([n[least >= g].sum() for g in grid])
    depth = np.minimum(below, above) - density
    depth[(tail > total / 2) | (tail == 0)] = -1
    at = grid[int(depth.argmax())]
    steps = least[1:] - most[:-1]
    near = np.nonzero((least[1:] >= at - width) & (most[:-1] <= at + width))[0]
    if not len(near):
        near = np.arange(len(steps))
    return float(least[1:][near[int(steps[near].argmax())]])


def above_widest_gap(ranking: DataFrame, buckets: int = GAP_BUCKETS) -> DataFrame:
    """(item) of the items above the one wide gap in strength, sought in the upper half.

    Strengths are reduced to (least, greatest, count) of equal-width buckets, so that only a table of
    bounded size comes together in one place.
    """
    ranking = cut_lineage(ranking.filter("strength is not null"))
    low, high, items = ranking.agg(F.min("strength"), F.max("strength"), F.count("*")).first()
    if not items or high == low:
        return ranking.limit(0).select("item")
    slot = F.least(F.floor((F.col("strength") - low) / ((high - low) / buckets)), F.lit(buckets - 1))
    reduced = ranking.groupBy(slot.alias("slot")).agg(F.min("strength").alias("least"), F.max("strength").alias("most"), F.count("*").alias("n"))
    rows = np.array([(r["least"], r["most"], r["n"]) for r in sorted(reduced.collect(), key=lambda r: r["slot"])])
    return ranking.filter(F.col("strength") >= cut_at_gap(rows[:, 0], rows[:, 1], rows[:, 2])).select("item")
