"""The kernel step and its iteration."""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from fluxfield.functions.scalar import sgn_deadzone
from fluxfield.plans.staging import BROADCAST_BYTES, Rounds, bucketed, counted, observed, row_bytes, stored, wide

EPS = 0.0
#: Whole multiples of 2^-k add up exactly in any order while sums stay below 2^53; values and their changes are below 2^8.
EXACT_SUM, SHIFTS = 2.0**45, (0, 16, 32)


@dataclass(frozen=True)
class KernelParams:
    """hops: walk lengths summed. coupling: rows (c_out, c_in, coef) over channels. deadzone: a number, a column
    over the state's columns, or a number for each run id."""

    hops: int = 1
    coupling: DataFrame | None = None
    deadzone: float | Column | dict[str, float] = EPS


def _deadzone(params: KernelParams) -> Column | float:
    eps = params.deadzone
    if not isinstance(eps, dict):
        return eps
    if min(eps.values()) < 0:
        raise ValueError("the dead zone is negative")
    return F.element_at(F.create_map(*[F.lit(x) for k, v in eps.items() for x in (k, float(v))]), F.col("run_id"))


def _keys(state: DataFrame) -> list[str]:
    return [c for c in ("run_id", "channel") if c in state.columns]


def _products(edges: DataFrame, values: DataFrame, keys: list[str], hint: str | None = None) -> DataFrame:
    """(src, keys, total): a row for each edge to a node with a value other than zero. hint: how to join, if known."""
    on = [F.col("dst") == F.col("_node")]
    shared = [k for k in keys if k in edges.columns]
    some = values.where("value <> 0").select(F.col("node").alias("_node"), F.col("value").alias("_value"), *[F.col(k).alias(f"_{k}") for k in keys])
    on += [F.col(k) == F.col(f"_{k}") for k in shared]
    joined = edges.join(some.hint(hint) if hint else some, on)
    return joined.select("src", *[F.col(f"_{k}").alias(k) for k in keys], (F.col("weight") * F.col("_value")).alias("total"))


def neighbour_sums(edges: DataFrame, values: DataFrame, keys: list[str], hint: str | None = None) -> DataFrame:
    """(src, keys, total): weighted sums over out-neighbours. Zero values are left out of the join."""
    return _products(edges, values, keys, hint).groupBy("src", *keys).agg(F.sum("total").alias("total"))


def kernel_step(edges: DataFrame, state: DataFrame, params: KernelParams = KernelParams(), hint: str | None = None) -> DataFrame:
    """The state's columns with `value` replaced by the sign of the weighted sum over out-neighbours.

    With hops of 2 or more the sums over longer walks are added by repeated joins, without a table of walks; that is
    the sum over k_hop's table as long as no weight is negative. Coupling mixes channels before the sign; with one
    channel it is ignored. A state has a row for each node (and run and channel). Products and the state's own rows are
    added up in one grouping, so a step of one hop shuffles partial sums once and joins nothing to the state.
    """
    return _stepped(edges, state, params, hint).select(*state.columns)


def _stepped(edges: DataFrame, state: DataFrame, params: KernelParams, hint: str | None = None) -> DataFrame:
    """kernel_step, and the sums that the signs are taken of as `total`."""
    if "value" not in state.columns or "node" not in state.columns:
        raise ValueError("a state has the columns node and value")
    keys = _keys(state)
    coupled = params.coupling is not None and "channel" in keys
    if params.hops <= 1 and not coupled:
        parts = [_products(edges, state, keys, hint)]
    else:
        parts = [neighbour_sums(edges, state, keys, hint)]
        for _ in range(params.hops - 1):
            before = parts[-1].select(F.col("src").alias("node"), *keys, F.col("total").alias("value"))
            parts.append(neighbour_sums(edges, before, keys))
    if coupled:
        sums = reduce(DataFrame.unionByName, parts).groupBy("src", *keys).agg(F.sum("total").alias("total"))
        c = params.coupling.select(F.col("c_in").alias("channel"), "c_out", "coef")
        # As many rows as pairs of channels.
        mixed = sums.join(F.broadcast(c), "channel")
        parts = [mixed.select("src", *[k for k in keys if k != "channel"], F.col("c_out").alias("channel"), (F.col("coef") * F.col("total")).alias("total"))]
    more = [c for c in state.columns if c not in ("node", *keys)]
    own = state.select(F.col("node").alias("src"), *keys, *[F.col(c).alias(f"_{c}") for c in more], F.lit(True).alias("_own"))
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [own, *parts])
    # Sums have nulls where the state's row has its columns, and max passes over them.
    found = rows.groupBy("src", *keys).agg(F.sum("total").alias("total"), *[F.max(f"_{c}").alias(c) for c in more], F.max("_own").alias("_own"))
    found = found.where("_own").select(F.col("src").alias("node"), *keys, *more, F.coalesce("total", F.lit(0.0)).alias("total"))
    return found.withColumn("value", sgn_deadzone(F.col("total"), _deadzone(params))).select(*state.columns, "total")


@dataclass(frozen=True)
class Flow:
    """status: (run_id, status, step, cycle_start); curve: (run_id, step, defect); changes: (run_id, step, node,
    [channel,] prev, new); state: the last state of each run; first: the state it began with."""

    status: DataFrame
    curve: DataFrame
    changes: DataFrame
    state: DataFrame
    first: DataFrame


def _row_hash(keys: list[str], value: str) -> Column:
    return F.xxhash64("node", *[k for k in keys if k != "run_id"], value)


def _sums(new: Column, old: Column | None = None, among: Column | None = None) -> dict[str, Column]:
    """The exact sum of hashes, or of what they differ by, as the sums of their halves: of longs, up to 2^31 rows."""
    halves = [lambda x: F.shiftright(x, 32), lambda x: x.bitwiseAND(F.lit(0xFFFFFFFF))]
    parts = [f(new) if old is None else f(new) - f(old) for f in halves]
    return {k: F.sum(p if among is None else F.when(among, p)) for k, p in zip(("high", "low"), parts, strict=True)}


def _total(seen: dict) -> int:
    return ((seen["high"] or 0) << 32) + (seen["low"] or 0)


def _marks(keys: list[str], width: Column) -> dict[str, Column]:
    """Over the rows of a run's state: sums that tell it from others, its cells, how many of them have changed, and the
    bytes of these."""
    row = _row_hash(keys, "value")
    changed = F.count_if(F.col("prev") != F.col("value"))
    return _sums(row) | {"x": F.bit_xor(row), "n": F.count(F.lit(1)), "d": changed, "w": F.sum(F.when(~F.col("prev").eqNullSafe(F.col("value")), width))}


def _turns(keys: list[str], width: Column) -> dict[str, Column]:
    """Over the rows that a step has reached: what _marks' sums change by, the rows, and how many have changed."""
    old, new, changed = _row_hash(keys, "prev"), _row_hash(keys, "value"), F.col("prev") != F.col("value")
    return _sums(new, old, changed) | {"x": F.bit_xor(F.when(changed, new.bitwiseXOR(old))), "n": F.count(F.lit(1)), "d": F.count_if(changed), "w": F.sum(F.when(changed, width))}


def _add(table: Rounds, rows: DataFrame, step: int, runs: list[str], marks: dict[str, Column]) -> tuple[DataFrame, dict[str, dict]]:
    """The written step and each run's marks: of one run as it is written, of more by a grouped pass over the step, so
    that plans do not grow with the number of runs."""
    if len(runs) == 1:
        now, seen = table.add(rows, step, **marks)
        return now, {runs[0]: seen}
    now, _ = table.add(rows, step)
    # As many rows as runs.
    return now, {r["run_id"]: r.asDict() for r in now.groupBy("run_id").agg(*[c.alias(k) for k, c in marks.items()]).collect()}


class _Edges:
    """Edges of a flow, written once, and how states join them: one that fits, by its rows' weight, is broadcast. For
    larger ones edges are dealt to buckets by their targets, if more than one is to come, so that no step shuffles them.
    Nor are they sorted: a task keeps the rows of a state, of which a partition has a bounded number (see wide), by key."""

    def __init__(self, edges: DataFrame, keys: list[str], rows: int | None = None) -> None:
        self.plain, self.rows = counted(edges, "flow-edges") if rows is None else (edges, rows)
        self.on, self.dealt = ["dst", *[k for k in keys if k in edges.columns]], None

    def joined_by(self, size: int, again: bool = True) -> tuple[DataFrame, str]:
        if size <= BROADCAST_BYTES:
            return self.plain, "broadcast"
        if self.dealt is None and again:
            self.dealt = bucketed(self.plain, self.on, "flow-edges")
        return (self.plain if self.dealt is None else self.dealt), "shuffle_hash"


def exact_sums(edges: DataFrame) -> bool:
    """Whether sums of weights times values are exact in doubles whatever their order, so that they can be kept up to
    date by adding changes: all weights are whole multiples of one power of two, and small enough."""
    w = F.col("weight").cast("double")
    off = [F.count_if(w * 2.0**k != F.rint(w * 2.0**k)).alias(f"off_{k}") for k in SHIFTS]
    found = edges.agg(F.sum(F.abs(w)).alias("total"), *off).first()
    return any(found[f"off_{k}"] == 0 and (found["total"] or 0.0) * 2.0**k < EXACT_SUM for k in SHIFTS)


class _Base:
    """A state of all cells with their sums, written, and the step it is of: what increments are added to.

    Steps only scan it: the cells that a change reaches are told by a broadcast of them, and it is shuffled only if they
    are too many. Once the rows that steps have written since are more than its own, they are folded into a new one, so
    steps read a bounded number of rows.
    """

    def __init__(self, table: DataFrame, cells: int, step: int, keys: list[str], columns: list[str]) -> None:
        self.keys, self.columns, self.step, self.cells, self.since = keys, columns, step, cells, 0
        self.table = table.select(F.col("node").alias("src"), *keys, *[F.col(c).alias(f"_{c}") for c in [*self._more(), "value", "total"]])

    def _more(self) -> list[str]:
        return [c for c in self.columns if c not in ("node", "value", *self.keys)]

    def _log(self, table: Rounds) -> DataFrame:
        """(src, keys, past, turned): what later steps have added to sums and values."""
        rows = table.all().where(F.col("round") > self.step)
        return rows.select(F.col("node").alias("src"), *self.keys, F.col("added").alias("past"), (F.col("value") - F.col("prev")).alias("turned"))

    def _summed(self, parts: list[DataFrame]) -> DataFrame:
        """The cells that have a row among parts of the base: columns without value, prev, added and total."""
        rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
        sums = [F.sum(c).alias(c) for c in ("past", "turned", "more") if c in rows.columns]
        found = rows.groupBy("src", *self.keys).agg(*sums, *[F.max(f"_{c}").alias(f"_{c}") for c in [*self._more(), "value", "total"]])
        of = lambda c: F.coalesce(c, F.lit(0.0)) if c in rows.columns else F.lit(0.0)
        prev = F.col("_value") + (F.coalesce("turned", F.lit(0)) if "turned" in rows.columns else F.lit(0))
        added = F.col("more") if "more" in rows.columns else F.lit(None).cast("double")
        # Sums have nulls where the base's row has its columns, and a cell's sum is never null.
        found = found.where("_total is not null")
        return found.select(F.col("src").alias("node"), *self.keys, *[F.col(f"_{c}").alias(c) for c in self._more()], prev.cast("tinyint").alias("prev"), added.alias("added"), (F.col("_total") + of("past") + of("more")).alias("total"))

    def reached(self, edges: DataFrame, changed: DataFrame, hint: str, table: Rounds, params: KernelParams) -> DataFrame:
        """The next step's rows of cells with a neighbour among the changed rows (node, keys, prev, value): columns,
        prev and added. What has reached them is written and weighed; their cells and what earlier steps have added meet
        it in one grouping."""
        by = changed.select("node", *self.keys, (F.col("value") - F.coalesce("prev", F.lit(0))).cast("tinyint").alias("value"))
        sums = neighbour_sums(edges, by, self.keys, hint).withColumnRenamed("total", "more")
        sums, seen = observed(sums, "flow-sums", bytes=F.sum(row_bytes(sums.drop("more"))))
        near = sums.select("src", *self.keys).hint("broadcast" if (seen["bytes"] or 0) <= BROADCAST_BYTES else "shuffle_hash")
        among = lambda rows: rows.join(near, ["src", *self.keys], "left_semi")
        found = self._summed([sums, among(self.table), *([among(self._log(table))] if self.since else [])])
        value = sgn_deadzone(F.col("total"), _deadzone(params)).cast("tinyint")
        return found.where("added is not null").withColumn("value", value).select(*self.columns, "prev", "added")

    def folded(self, table: Rounds, step: int) -> _Base:
        cells, n = counted(self._summed([self.table, self._log(table)]).withColumn("value", F.col("prev")).select(*self.columns, "total"), "flow-cells")
        return _Base(cells, n, step, self.keys, self.columns)


def kernel_flow(edges: DataFrame, state: DataFrame, params: KernelParams = KernelParams(), steps: int = 20, cycle_check: bool = True, rows: int | None = None) -> Flow:
    """Iterate kernel_step until nothing changes, a state comes back, or steps have been made.

    State may hold several runs under run_id, which are stepped together in one set of joins; a run leaves when it has
    ended. Each step is a part of one table, written with both values, which changes and last states are read from.
    A state that comes back is told by a fingerprint and confirmed cell by cell: nothing may have changed on balance.

    The first step works on all cells. With one hop, no coupling and weights whose sums are exact in any order (see
    exact_sums), later ones only work on cells that an out-neighbour's change has reached: their sums grow by weight
    times change, only they are written, and the fingerprint moves by what they turn. Rows written follow the defect
    then, and are the same as those of whole steps. Other flows make whole steps.

    rows: how many edges there are, if they are a written table, which is read as it is then; else they are written.
    """
    spark = state.sparkSession
    # One run without an id is stepped without it, so that joins and groupings are by nodes alone.
    lone = "run_id" not in state.columns and "run_id" not in edges.columns and not isinstance(params.deadzone, dict)
    if "run_id" not in state.columns and not lone:
        state = state.withColumn("run_id", F.lit("0"))
    columns, keys, table = state.columns, _keys(state), Rounds(spark, "flow")
    state = state.withColumn("value", F.col("value").cast("tinyint")).withColumn("prev", F.col("value"))
    width = row_bytes(state.select("node", *keys, "value"))
    edges = edges.select(*[c for c in ("run_id", "channel", "src", "dst", "weight") if c in edges.columns])
    sides, exact = _Edges(edges, keys, rows), params.hops <= 1 and not (params.coupling is not None and "channel" in keys)
    # A first field that is worked out as it is written takes joins over the edges.
    with wide(spark, sides.rows):
        now, whole = table.add(state, 0, bytes=F.sum(row_bytes(state.drop("prev"))), **_marks(keys, width))
    exact = exact and exact_sums(sides.plain)
    if lone:
        first = {"0": whole} if whole["n"] else {}
    else:
        # As many rows as runs.
        first = {r["run_id"]: r for r in now.groupBy("run_id").agg(*[c.alias(k) for k, c in _marks(keys, width).items()]).collect()}
    runs = sorted(first)
    marks = {run: (_total(r), r["x"], r["n"]) for run, r in first.items()}
    active, seen, base, changed_bytes, turned_bytes = set(runs), {run: {mark: [0]} for run, mark in marks.items()}, None, 0, 0
    ended, curve = {}, []
    with wide(spark, max(whole["n"], sides.rows)):
        for step in range(1, steps + 1):
            if not active:
                break
            left = now.where(F.col("run_id").isin(*active)) if len(active) < len(runs) else now
            names = sorted(active)
            if base:
                changed = left.where("prev <> value" if step > 2 else "not prev <=> value").select("node", *keys, "prev", "value")
                by, hint = sides.joined_by(changed_bytes)
                now, got = _add(table, base.reached(by, changed, hint, table, params), step, names, _turns(keys, width))
                base.since += sum(m["n"] for m in got.values())
                for run in names:
                    s, x, n = marks[run]
                    turn = got.get(run) or {"high": None, "low": None, "x": None, "d": 0, "w": None}
                    marks[run], got[run] = (s + _total(turn), x ^ (turn["x"] or 0), n), turn
            else:
                by, hint = sides.joined_by(whole["bytes"] or 0, not exact)
                found = _stepped(by, left.select(*columns, F.col("value").alias("prev")), params, hint)
                now, got = _add(table, found.withColumn("value", F.col("value").cast("tinyint")), step, names, _marks(keys, width))
                marks |= {run: (_total(got[run]), got[run]["x"], got[run]["n"]) for run in names}
            for run in names:
                defect = got[run]["d"]
                curve.append((run, step, defect))
                if defect == 0:
                    ended[run] = ("converged", step, None)
                elif cycle_check:
                    for start in seen[run].get(marks[run], []):
                        since = table.all().where((F.col("round") > start) & (F.lit(True) if lone else F.col("run_id") == run) & (F.col("prev") != F.col("value")))
                        if since.groupBy("node", *keys).agg(F.sum(F.col("value") - F.col("prev")).alias("turned")).where("turned <> 0").isEmpty():
                            ended[run] = ("cycle", step, start)
                            break
                seen[run].setdefault(marks[run], []).append(step)
            active -= ended.keys()
            changed_bytes = sum(got[run]["w"] or 0 for run in active)
            turned_bytes += sum(got[run]["w"] or 0 for run in names) if base else 0
            if exact and active and step < steps:
                if not base:
                    base = _Base(now, sum(m["n"] for m in got.values()), step, keys, columns)
                elif base.since > base.cells:
                    base = base.folded(table, step)
    ended |= {run: ("max_steps", steps, None) for run in active}
    status = spark.createDataFrame([(run, *end) for run, end in sorted(ended.items())], "run_id string, status string, step int, cycle_start int")
    parts, prev = table.all(), F.col("prev")
    changes = parts.where((F.col("round") > 0) & (prev != F.col("value")))
    run_id = F.lit("0") if lone else F.col("run_id")
    last = F.create_map(*[F.lit(x) for run, end in ended.items() for x in (run, end[1])])[run_id] if ended else F.lit(0)
    # The first step is the last with rows of all cells, if increments follow it.
    whole = 1 if base else steps
    ends = sorted({min(end[1], whole) for end in ended.values()})
    final = parts.where(F.col("round").isin(ends) & (F.col("round") == F.least(last, F.lit(whole)))).select(*columns)
    if base:
        later = changes.where((F.col("round") > whole) & (F.col("round") <= last)).groupBy("node", *keys).agg(F.sum(F.col("value") - prev).alias("_turned"))
        if turned_bytes <= BROADCAST_BYTES:
            later = stored(later.where("_turned <> 0"), "flow-turned")
            value = (F.col("value") + F.coalesce("_turned", F.lit(0))).cast("tinyint")
            final = final.join(later.hint("broadcast"), ["node", *keys], "left").withColumn("value", value).select(*columns)
        else:
            # Cells and what they turn by meet in one grouping, so neither is sorted. Sums pass over nulls, as does max.
            more = [c for c in columns if c not in ("node", "value", *keys)]
            cells = final.unionByName(later.select("node", *keys, F.col("_turned").alias("value")), allowMissingColumns=True)
            final = cells.groupBy("node", *keys).agg(*[F.max(c).alias(c) for c in more], F.sum("value").cast("tinyint").alias("value")).select(*columns)
    return Flow(
        status,
        spark.createDataFrame(curve, "run_id string, step int, defect bigint"),
        changes.select(run_id.alias("run_id"), F.col("round").alias("step"), "node", *[k for k in keys if k != "run_id"], prev.alias("prev"), F.col("value").alias("new")),
        final.withColumn("run_id", run_id),
        parts.where("round = 0").select(*columns).withColumn("run_id", run_id),
    )


def flips(first: DataFrame, last: DataFrame) -> DataFrame:
    """One row: how many cells differ between two states."""
    keys = ["node", *[k for k in _keys(first) if k in last.columns]]
    both = first.select(*keys, F.col("value").alias("a")).join(last.select(*keys, F.col("value").alias("b")), keys)
    return both.agg(F.count_if(F.col("a") != F.col("b")).alias("flips"))
