"""The level-interaction detector as a fold over a path's steps, in Spark expressions only.

An exit that awaits its confirmation, and a timeout that is awaited, are states of their own, so no step looks ahead; only the path's length is known. A step can
fail a confirmation, leave or hold a zone, complete an event, and enter a zone, in this order; each of these is one small function of the state.

An exit whose confirmation would reach beyond the path's end stops the detector: the steps from there on are kept in ``tail``, fewer than a
confirmation has. The fold's state with its tail holds all that later steps need to know, so a path may end anywhere and go on from the state it ended with.

Modes: 0 idle; 1 in a zone and not settled; 2 left it on the side it came from, before it settled, awaiting confirmation; 3 settled in the zone; 4 left
the zone, awaiting confirmation; 5 left the zone too late to be confirmed before the timeout; -1 an event ended with this step.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

IDLE, APPROACHING, LEAVING, HOLDING, EXITING, WAITING, DONE = 0, 1, 2, 3, 4, 5, -1
EVENT = (
    "event_type string, fib_level double, entry_index int, approach_side string, approach_direction string, consolidation_index int, hover_index int, "
    "dwell_time int, is_terminal boolean, output_index int, pullback_stage string, exit_direction string, exit_index int, confirmation_end_index int, "
    "exit_price double, max_price_after double, min_price_after double"
)
MARK = "a int, b int, state string"
#: Steps so far, the interaction's level, entry and so on, the last price, and what the fold has found: events, and stretches of one state.
STATE = {
    "n": "int", "mode": "int", "level": "double", "came": "int", "entry": "int", "settled": "int", "exit": "int", "side": "int", "dwell": "int", "held": "int",
    "exit_price": "double", "high": "double", "low": "double", "last": "double", "tail": "array<double>",
    "events": "array<struct<" + ", ".join(f.replace(" ", ": ", 1) for f in EVENT.split(", ")) + ">>",
    "marks": "array<struct<" + ", ".join(f.replace(" ", ": ", 1) for f in MARK.split(", ")) + ">>",
}


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def changed(state: Column, when: Column | None = None, **fields: Column) -> Column:
    """The state with other fields, where ``when`` holds."""
    own = {k: fields[k].cast(kind) if k in fields else state[k] for k, kind in STATE.items()}
    new = F.struct(*(v.alias(k) for k, v in own.items()))
    return new if when is None else F.when(when, new).otherwise(state)


def beginning() -> Column:
    """The state before a path's first step."""
    first = {"n": F.lit(0), "mode": F.lit(IDLE), "tail": F.array(), "events": F.array(), "marks": F.array()}
    return F.struct(*(first.get(k, F.lit(None)).cast(kind).alias(k) for k, kind in STATE.items()))


def carried(state: Column) -> Column:
    """The state that a path goes on from: an earlier end without what was found up to there, or the beginning."""
    none = {k: F.array().cast(STATE[k]) for k in ("events", "marks")}
    return F.when(state.isNull(), beginning()).otherwise(changed(state, **none))


def _marks(state: Column, *marks: tuple[Column, Column, str]) -> Column:
    """The marks of the state with more: stretches from a step to before another, those of no step left out."""
    own = [F.struct(a.cast("int").alias("a"), b.cast("int").alias("b"), F.lit(name).alias("state")) for a, b, name in marks]
    return F.concat(state["marks"], F.filter(F.array(*own), lambda m: m["a"] < m["b"]))


def _event(s: Column, kind: Column, out: Column, dwell: Column, confirmed: bool, stage: Column | None = None, settled: Column | None = None, leave: Column | None = None, price: Column | None = None) -> Column:
    none = F.lit(None)
    up = F.when(s["side"] > 0, "up").otherwise("down")
    fields = {
        "event_type": kind, "fib_level": s["level"], "entry_index": s["entry"], "approach_side": F.when(s["came"] < 0, "below").otherwise("above"),
        "approach_direction": F.when(s["came"] < 0, "up").otherwise("down"), "consolidation_index": none if settled is None else settled, "hover_index": none if settled is None else settled,
        "dwell_time": dwell, "is_terminal": kind != "HOVER", "output_index": out, "pullback_stage": none if stage is None else stage, "exit_direction": up if confirmed else none,
        "exit_index": none if leave is None else leave, "confirmation_end_index": out if confirmed else none, "exit_price": none if price is None else price,
        "max_price_after": s["high"] if confirmed else none, "min_price_after": s["low"] if confirmed else none,
    }
    kinds = dict(f.split() for f in EVENT.split(", "))
    return F.concat(s["events"], F.array(F.struct(*(v.cast(kinds[k]).alias(k) for k, v in fields.items()))))


def side(price: Column, level: Column, tolerance: float) -> Column:
    return F.when(price - level > tolerance, 1).when(price - level < -tolerance, -1).otherwise(0)


def step(state: Column, x: Column, total: Column, rules) -> Column:
    """The state after one more step ``x(price, level, near)`` of ``total``: its price, the nearest level, and whether it is within the zone of that."""
    price, i = x["price"], state["n"]
    unfinished = i + rules.confirmation - 1 >= total
    timeout = lambda s: s["settled"] + rules.max_dwell
    here = lambda s: side(price, s["level"], rules.tolerance)

    def failed(s: Column) -> Column:
        """A confirmation fails with the first step on another side; the step is then taken as if there had been none."""
        other = here(s) != s["side"]
        return (
            F.when((s["mode"] == LEAVING) & other, changed(s, mode=F.lit(IDLE), marks=_marks(s, (s["exit"], i, "APPROACHING"))))
            .when((s["mode"] == EXITING) & other, changed(s, mode=F.lit(HOLDING), held=i, marks=_marks(s, (s["exit"], i, "CONSOLIDATING"))))
            .otherwise(s)
        )

    def moved(s: Column) -> Column:
        """A zone is held or left, and a settled interaction times out."""
        leave = {"exit": i, "side": here(s), "exit_price": price, "high": price, "low": price}
        late = ((s["mode"] == HOLDING) | (s["mode"] == WAITING)) & (i >= timeout(s))
        settling = (s["mode"] == APPROACHING) & (here(s) == 0) & (i == s["settled"])
        ended = _marks(s, (F.when(s["mode"] == WAITING, s["exit"]).otherwise(s["held"]), i, "CONSOLIDATING"), (i, i + 1, "FINISHED"))
        out = F.when((s["mode"] == APPROACHING) & (here(s) == s["came"]) & unfinished, changed(s, tail=F.array(price)))
        out = out.when(
            (s["mode"] == APPROACHING) & (here(s) != 0),
            changed(s, mode=F.when(here(s) == s["came"], LEAVING).otherwise(IDLE), marks=_marks(s, (s["entry"], i, "APPROACHING")), **leave),
        )
        out = out.when(settling, _hovered(s, i, rules))
        out = out.when(late, changed(s, mode=F.lit(DONE), marks=ended, events=_event(s, F.lit("TIMEOUT"), i, s["dwell"], False, settled=s["settled"], leave=i, price=price)))
        out = out.when((s["mode"] == HOLDING) & (here(s) == 0), changed(s, dwell=s["dwell"] + 1))
        waits = (i + rules.confirmation - 1 >= timeout(s)) & (timeout(s) < total)
        out = out.when((s["mode"] == HOLDING) & ~waits & unfinished, changed(s, tail=F.array(price)))
        ahead = F.when(waits, WAITING).otherwise(EXITING)
        return out.when(s["mode"] == HOLDING, changed(s, mode=ahead, marks=_marks(s, (s["held"], i, "CONSOLIDATING")), **leave)).otherwise(s)

    def confirmed(s: Column) -> Column:
        """An exit is confirmed once it has lasted."""
        away = (s["mode"] == LEAVING) | (s["mode"] == EXITING)
        s2 = let(changed(s, away, high=F.greatest(s["high"], price), low=F.least(s["low"], price)), lambda t: t)
        return let(s2, _complete)

    def _complete(s: Column) -> Column:
        done = i == s["exit"] + rules.confirmation - 1
        early = changed(
            s, mode=F.lit(DONE), marks=_marks(s, (s["exit"], i, "APPROACHING"), (i, i + 1, "FINISHED")),
            events=_event(s, F.lit("PULLBACK"), i, s["exit"] - s["entry"], True, F.lit("approaching"), leave=s["exit"], price=s["exit_price"]),
        )
        back = s["side"] == s["came"]
        settled = changed(
            s, mode=F.lit(DONE), marks=_marks(s, (s["exit"], i, "CONSOLIDATING"), (i, i + 1, "FINISHED")),
            events=_event(s, F.when(back, "PULLBACK").otherwise("BREAKOUT"), i, s["dwell"], True, F.when(back, "consolidating"), s["settled"], s["exit"], s["exit_price"]),
        )
        return F.when((s["mode"] == LEAVING) & done, early).when((s["mode"] == EXITING) & done, settled).otherwise(s)

    def entered(s: Column) -> Column:
        """An idle path enters the zone of the nearest level from outside."""
        came = side(s["last"], x["level"], rules.tolerance)
        entry = (s["mode"] == IDLE) & x["near"] & s["last"].isNotNull() & (came != 0)
        new = changed(s, mode=F.lit(APPROACHING), level=x["level"], came=came, entry=i, settled=i + rules.min_dwell - 1)
        if rules.min_dwell == 1:
            new = let(new, lambda t: _hovered(t, i, rules))
        return F.when(entry, new).otherwise(s)

    def closed(s: Column) -> Column:
        return F.when(F.size(s["tail"]) > 0, s).otherwise(changed(s, n=i + 1, last=price, mode=F.when(s["mode"] == DONE, IDLE).otherwise(s["mode"])))

    taken = let(let(let(let(failed(state), moved), confirmed), entered), closed)
    return F.when(F.size(state["tail"]) > 0, changed(state, tail=F.concat(state["tail"], F.array(price)))).otherwise(taken)


def _hovered(s: Column, i: Column, rules) -> Column:
    """The interaction has settled at step ``i``."""
    return changed(
        s, mode=F.lit(HOLDING), held=i, dwell=F.lit(rules.min_dwell), marks=_marks(s, (s["entry"], i, "APPROACHING")),
        events=_event(s, F.lit("HOVER"), i, F.lit(rules.min_dwell), False, settled=i),
    )


def folded(prices: Column, levels: Column, before: Column, rules) -> Column:
    """The state after all ``prices``, from the state ``before`` them and its tail. Prices or levels that aren't finite, or missing, are an error."""
    prices = F.concat(before["tail"], prices)
    total = before["n"] + F.size(prices)
    odd = lambda v: v.isNull() | F.isnan(v) | (F.abs(v) == float("inf"))
    wrong = F.coalesce((F.size(levels) < 1) | (F.size(prices) < 1) | F.exists(prices, odd) | F.exists(levels, odd), F.lit(True))
    ordered = F.array_sort(F.array_distinct(levels))

    def placed(p: Column) -> Column:
        nearest = F.array_min(F.transform(ordered, lambda v: F.struct(F.abs(p - v).alias("gap"), v.alias("level"))))
        return let(nearest, lambda near: F.struct(p.alias("price"), near["level"].alias("level"), (near["gap"] <= rules.tolerance).alias("near")))

    steps = F.when(wrong, F.raise_error(F.lit("prices and levels must be finite and not empty"))).otherwise(F.transform(prices, placed))
    return F.aggregate(steps, changed(before, tail=F.array()), lambda state, x: step(state, x, total, rules))


def states(end: Column, first: Column) -> Column:
    """The state's name at each step from ``first`` on. Those of the tail are idle."""
    open_ = F.when(end["mode"] == APPROACHING, end["entry"]).when(end["mode"] == HOLDING, end["held"])
    name = F.when(end["mode"] == APPROACHING, "APPROACHING").otherwise("CONSOLIDATING")
    last = F.array(F.struct(F.coalesce(open_, end["n"]).alias("a"), end["n"].alias("b"), name.alias("state")))
    marks = F.transform(F.concat(end["marks"], last), lambda m: F.struct(F.greatest(m["a"], first).alias("a"), F.greatest(m["b"], first).alias("b"), m["state"].alias("state")))
    starts = F.concat(F.array(first), F.transform(marks, lambda m: m["b"]))
    named = F.zip_with(marks, F.slice(starts, 1, F.size(marks)), lambda m, before: F.concat(F.array_repeat(F.lit("IDLE"), m["a"] - before), F.array_repeat(m["state"], m["b"] - m["a"])))
    return F.concat(F.flatten(named), F.array_repeat(F.lit("IDLE"), end["n"] + F.size(end["tail"]) - F.greatest(end["n"], first)))
