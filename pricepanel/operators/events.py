"""Level-interaction events of a path.

A path is packed into one row of arrays first (a horizon's steps, however many paths there are), which the detector of
:mod:`pricepanel.operators.automaton` folds step by step; one fold gives events, states and the state to go on from.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from pricepanel.functions.expressions import ratio
from pricepanel.operators import automaton
from pricepanel.operators.gates import EXPERTS, P

#: Names of the events in tables; a timeout has none.
NAMES = {"HOVER": "Hover", "BREAKOUT": "Break", "PULLBACK": "Bounce"}
EVENTS = tuple(NAMES.values())


@dataclass(frozen=True)
class Rules:
    tolerance: float = 0.02
    min_dwell: int = 3
    confirmation: int = 10
    max_dwell: int = 20

    def __post_init__(self) -> None:
        if self.tolerance < 0 or min(self.min_dwell, self.confirmation, self.max_dwell) < 1 or self.max_dwell < self.min_dwell:
            raise ValueError(f"invalid rules: {self}")


def path_faults(paths: DataFrame, keys: list[str]) -> DataFrame:
    """``keys, n_steps, n_missing, fault`` of each path ``(keys, step, price, levels)``: why the detector would refuse it, null if it takes it.

    ``empty``: no price that isn't null; ``price``: one isn't finite; ``levels``: none, or one that isn't finite. Sums only, so a
    path's prices are never brought together.
    """
    odd = lambda c: F.isnan(c) | (F.abs(c) == float("inf"))
    level = F.coalesce(F.size("levels") < 1, F.lit(True)) | F.coalesce(F.exists("levels", lambda v: v.isNull() | odd(v)), F.lit(True))
    found = paths.groupBy(*keys).agg(
        F.count("price").alias("n_steps"),
        F.count(F.when(F.col("price").isNull(), 1)).alias("n_missing"),
        F.count(F.when(odd(F.col("price")), 1)).alias("n_odd"),
        F.max(level).alias("no_levels"),
    )
    fault = F.when(F.col("n_steps") == 0, "empty").when(F.col("n_odd") > 0, "price").when(F.col("no_levels"), "levels")
    return found.select(*keys, "n_steps", "n_missing", fault.alias("fault"))


def packed(paths: DataFrame, keys: list[str]) -> DataFrame:
    """Each path as one row: arrays of its steps and prices in order, null prices dropped, and its levels."""
    rows = paths.where("price is not null").groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("step", "price"))).alias("p"), F.first("levels").alias("levels"))
    return rows.select(*keys, F.col("p.step").alias("steps"), F.col("p.price").alias("prices"), "levels")


def traced(paths: DataFrame, keys: list[str], rules: Rules = Rules(), before: DataFrame | None = None) -> DataFrame:
    """Events and states of each path ``(keys, step, price, levels)`` in one row ``(keys, step, state, event, levels)`` of arrays, and the state it ends with.

    ``before(keys, end)`` are the ends of earlier parts of the same paths, from which they go on: step numbers, open interactions and awaited
    confirmations are carried over, so a path cut anywhere gives the events of the whole. A path without one begins anew. States are those of the own steps; an
    exit too late to be confirmed leaves the steps from there on idle, also if a later part confirms it.
    """
    rows = packed(paths, keys)
    if before is None:
        rows = rows.withColumn("begin", automaton.beginning())
    else:
        rows = rows.join(before.select(*keys, F.col("end").alias("begin")), keys, "left").withColumn("begin", automaton.carried(F.col("begin")))
    rows = rows.withColumn("end", automaton.folded(F.col("prices"), F.col("levels"), F.col("begin"), rules))
    return rows.select(*keys, F.col("steps").alias("step"), automaton.states(F.col("end"), F.col("begin.n") + F.size("begin.tail")).alias("state"), F.col("end.events").alias("event"), "levels", "end")


def events_of(traces: DataFrame, keys: list[str]) -> DataFrame:
    """One row per event of :func:`traced` paths."""
    return traces.select(*keys, F.explode("event").alias("e")).select(*keys, "e.*")


def states_of(traces: DataFrame, keys: list[str]) -> DataFrame:
    """One row per step of :func:`traced` paths."""
    return traces.select(*keys, F.explode(F.arrays_zip("step", "state")).alias("s")).select(*keys, "s.*")


def interactions(paths: DataFrame, keys: list[str], rules: Rules = Rules()) -> DataFrame:
    """Events of each path ``(keys, step, price, levels)``."""
    return events_of(traced(paths, keys, rules), keys)


def state_trace(paths: DataFrame, keys: list[str], rules: Rules = Rules()) -> DataFrame:
    """State of every step of each path."""
    return states_of(traced(paths, keys, rules), keys)


def state_runs(trace: DataFrame, events: DataFrame, keys: list[str]) -> DataFrame:
    """Runs of one state with the events whose output falls in them, joined by a comma."""
    w = Window.partitionBy(*keys).orderBy("step")
    rows = trace.withColumn("_new", F.coalesce((F.col("state") != F.lag("state").over(w)).cast("int"), F.lit(0))).withColumn("run", F.sum("_new").over(w))
    rows = rows.join(events.select(*keys, F.col("output_index").alias("step"), "event_type"), [*keys, "step"], "left")
    notes = F.array_join(F.transform(F.sort_array(F.collect_list(F.when(F.col("event_type").isNotNull(), F.struct("step", "event_type")))), lambda s: s["event_type"]), ",")
    return rows.groupBy(*keys, "run", "state").agg(F.min("step").alias("start"), F.max("step").alias("end"), notes.alias("events"))


def integrity(events: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of violations over all paths: all are 0 for what :func:`interactions` returns."""
    w = Window.partitionBy(*keys).orderBy("output_index", "entry_index", "event_type")
    rows = events.withColumns({"_back": F.lag("output_index").over(w), "_entry": F.lag("entry_index").over(w), "_kind": F.lag("event_type").over(w)})
    per = events.groupBy(*keys, "entry_index").agg(
        F.count(F.when(F.col("event_type") == "HOVER", 1)).alias("h"), F.count(F.when(F.col("is_terminal"), 1)).alias("t"),
        F.max("hover_index").alias("hover"), F.min(F.when(F.col("is_terminal"), F.col("output_index"))).alias("final"),
    )
    n = lambda ok: F.count(F.when(ok, 1))
    a = rows.agg(n(F.col("_back") >= F.col("output_index")).alias("out_of_order"), n((F.col("_entry") != F.col("entry_index")) & (F.col("entry_index") <= F.col("_back"))).alias("overlapping"))
    b = per.agg(n(F.col("h") > 1).alias("hovers"), n(F.col("t") > 1).alias("terminals"), n(F.col("hover") > F.col("final")).alias("hover_after_end"))
    return a.crossJoin(b)


def aligned(events: DataFrame, gates: DataFrame, keys: list[str]) -> DataFrame:
    """Gates at the event and at its entry: a hover is read at its output, others at the exit, not at its confirmation."""
    name = F.create_map(*(F.lit(x) for kv in NAMES.items() for x in kv))
    at = F.when(F.col("event_type") == "HOVER", F.col("output_index")).otherwise(F.col("exit_index"))
    rows = events.where(F.col("event_type") != "TIMEOUT").withColumns({"event": name[F.col("event_type")], "gate_index": at})
    rows = rows.withColumn("duration", F.col("gate_index") - F.col("entry_index"))
    here = gates.select(*keys, F.col("step").alias("gate_index"), *P)
    entry = gates.select(*keys, F.col("step").alias("entry_index"), *(F.col(c).alias(f"{c}_entry") for c in P))
    rows = rows.join(here, [*keys, "gate_index"]).join(entry, [*keys, "entry_index"])
    return rows.withColumns({f"{c}_change": F.col(c) - F.col(f"{c}_entry") for c in P})


def unresolved(traces: DataFrame, keys: list[str], horizon: int, rules: Rules = Rules(), pad: int = 32) -> DataFrame:
    """Per path of :func:`traced`, the entries within the horizon that have an event beyond it and no end within it.

    A path is continued from its end by ``pad`` repeats of its last price; one that ends idle has nothing to come.
    """
    end = F.col("end")
    last = F.when(F.size(end["tail"]) > 0, F.element_at(end["tail"], -1)).otherwise(end["last"])
    more = automaton.folded(F.array_repeat(last, pad), F.col("levels"), automaton.carried(end), rules)["events"]
    events = F.when(end["mode"] != automaton.IDLE, F.concat("event", more)).otherwise(F.col("event"))
    rows = traces.select(*keys, F.explode(events).alias("e")).where(F.col("e.entry_index") <= horizon)
    late, over = F.col("e.output_index") > horizon, F.col("e.is_terminal") & (F.col("e.output_index") <= horizon)
    entries = rows.groupBy(*keys, F.col("e.entry_index").alias("entry_index")).agg(F.max(late).alias("late"), F.max(over).alias("over"))
    return entries.where("late and not over").groupBy(*keys).agg(F.count(F.lit(1)).alias("unresolved"))


def typical_examples(rows: DataFrame) -> DataFrame:
    """One row per event: of lower-median duration, then the first by security, date and entry. Durations are counted, not sorted row by row."""
    counts = rows.groupBy("event", "duration").agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy("event")
    cum = F.sum("_c").over(w.orderBy("duration"))
    middle = F.floor((F.sum("_c").over(w) + 1) / 2)
    chosen = counts.withColumns({"_up": cum, "_mid": middle}).where((F.col("_up") >= F.col("_mid")) & (F.col("_up") - F.col("_c") < F.col("_mid"))).select("event", "duration")
    first = F.min(F.struct("issue_id", "origin_date", "entry_index")).alias("_f")
    return rows.join(F.broadcast(chosen), ["event", "duration"]).groupBy("event", "duration").agg(first).select("event", "duration", "_f.*")


def counts_by_path(paths: DataFrame, events: DataFrame, keys: list[str]) -> DataFrame:
    """Per path, events or not: counts by type, evaluated outcomes, their shares and ratio (NULL over 0)."""
    n = lambda kind: F.count(F.when(F.col("event_type") == kind, 1)).alias(kind.lower())
    found = events.groupBy(*keys).agg(*(n(k) for k in ("HOVER", "BREAKOUT", "PULLBACK", "TIMEOUT")))
    rows = paths.select(*keys).distinct().join(found, keys, "left").na.fill(0, ["hover", "breakout", "pullback", "timeout"])
    rows = rows.withColumn("evaluated", F.col("breakout") + F.col("pullback"))
    c = F.col
    return rows.withColumns(
        {"breakout_share": ratio(c("breakout"), c("evaluated")), "pullback_share": ratio(c("pullback"), c("evaluated")), "breakout_ratio": ratio(c("breakout"), c("pullback"))}
    )


def counts_by_source(by_path: DataFrame) -> DataFrame:
    kinds = ("hover", "breakout", "pullback", "timeout", "evaluated")
    return by_path.groupBy("source").agg(F.count(F.lit(1)).alias("paths"), *(F.sum(k).alias(k) for k in kinds), *(F.avg(k).alias(f"mean_{k}") for k in kinds))


def level_histogram(events: DataFrame, labels: int = 7) -> DataFrame:
    """Counts by event, level place (from the lowest) and source, dense. ``events`` has ``level_index``."""
    found = events.groupBy("event_type", "level_index", "source").agg(F.count(F.lit(1)).alias("n"))
    axes = events.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, ("HOVER", "BREAKOUT", "PULLBACK", "TIMEOUT")))).alias("event_type"))
    grid = axes.withColumn("level_index", F.explode(F.sequence(F.lit(0), F.lit(labels - 1)))).withColumn("source", F.explode(F.array(F.lit("real"), F.lit("synthetic"))))
    return grid.join(found, ["event_type", "level_index", "source"], "left").na.fill(0, ["n"])


def jensen_shannon(counts: DataFrame, keys: list[str], a: str, b: str) -> DataFrame:
    """Base-2 distance of the histograms of sources ``a`` and ``b``; NULL if either is empty."""
    wide = counts.groupBy(*keys, "level_index").agg(*(F.sum(F.when(F.col("source") == s, F.col("n")).otherwise(0)).alias(x) for x, s in (("_a", a), ("_b", b))))
    w = Window.partitionBy(*keys)
    wide = wide.withColumns({"p": ratio(F.col("_a"), F.sum("_a").over(w)), "q": ratio(F.col("_b"), F.sum("_b").over(w))}).withColumn("m", (F.col("p") + F.col("q")) / 2)
    term = lambda x: F.when(F.col(x) > 0, F.col(x) * F.log2(F.col(x) / F.col("m"))).when(F.col(x) == 0, 0.0)
    empty = F.max(F.col("m").isNull().cast("int")) == 1
    total = F.sum(term("p") + term("q")) / 2
    return wide.groupBy(*keys).agg(F.when(~empty, F.sqrt(F.greatest(total, F.lit(0.0)))).alias("distance"))


def event_summary(rows: DataFrame) -> DataFrame:
    """Per event and expert, dense: events, stocks, support, mean gate at the event and at entry, and change."""
    cells = F.array(*(F.struct(F.lit(e).alias("expert"), F.col(c).alias("at"), F.col(f"{c}_entry").alias("before")) for e, c in zip(EXPERTS, P, strict=True)))
    long = rows.select("event", "issue_id", F.explode(cells).alias("c")).select("event", "issue_id", "c.*")
    found = long.groupBy("event", "expert").agg(
        F.count(F.lit(1)).alias("n"), F.countDistinct("issue_id").alias("stocks"), F.avg("at").alias("mean_event"), F.avg("before").alias("mean_entry"), F.avg(F.col("at") - F.col("before")).alias("mean_change")
    )
    grid = rows.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, EVENTS))).alias("event")).withColumn("expert", F.explode(F.array(*map(F.lit, EXPERTS))))
    full = grid.join(found, ["event", "expert"], "left").na.fill(0, ["n", "stocks"])
    return full.withColumn("supported", (F.col("n") >= 30) & (F.col("stocks") >= 5))


def event_winners(summary: DataFrame) -> DataFrame:
    """Expert of the highest mean per event, and each expert's spread over events."""
    spread = F.max("mean_event").over(Window.partitionBy("expert")) - F.min("mean_event").over(Window.partitionBy("expert"))
    rows = summary.where("mean_event is not null").withColumn("spread", spread)
    best = F.max_by(F.struct("expert", "mean_event", "spread"), F.struct("mean_event", "expert"))
    return rows.groupBy("event").agg(best.alias("b")).select("event", "b.*")
