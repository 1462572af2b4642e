"""One row per trial: codes, times and what they tell."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from trialspark.operators.segments import _keys, segment_contents, trial_segments


def first_time(codes, n: int = 1, events: str = "events", times: str = "times") -> Column:
    """Time of the ``n``-th event of a trial whose code is one of ``codes``, null if there is none."""
    wanted = F.array(*[F.lit(c) for c in (codes if isinstance(codes, (list, tuple, range, set)) else [codes])])
    pairs = F.filter(F.arrays_zip(F.col(events).alias("e"), F.col(times).alias("t")), lambda p: F.array_contains(wanted, p["e"]))
    return F.try_element_at(pairs, F.lit(n))["t"]


def first_code(codes, n: int = 1, events: str = "events") -> Column:
    wanted = F.array(*[F.lit(c) for c in (codes if isinstance(codes, (list, tuple, range, set)) else [codes])])
    return F.try_element_at(F.filter(F.col(events), lambda e: F.array_contains(wanted, e)), F.lit(n))


def has_code(codes, events: str = "events") -> Column:
    return F.arrays_overlap(F.col(events), F.array(*[F.lit(c) for c in (codes if isinstance(codes, (list, tuple, range, set)) else [codes])]))


@dataclass(frozen=True)
class Layout:
    """What a task's trial table has beside codes and times.

    ``times``: column -> (codes, which occurrence); ``flags``: column -> codes; ``targets``: column -> codes of targets in
    order (the index is 1 for the first of them, 0 if none occurs); ``spans``: column -> (from column, to column).
    """

    start: tuple
    end: tuple
    reward: tuple
    penalty: tuple = ()
    repeating: bool = False
    times: dict = field(default_factory=dict)
    flags: dict = field(default_factory=dict)
    targets: dict = field(default_factory=dict)
    spans: dict = field(default_factory=dict)


# Task codes of the recordings.
CENTER, PERIPHERAL = 80, tuple(range(81, 90))
TARGET_ON, TARGET_OFF, GO, REWARD, TRIAL_END, PAUSE = 16, 96, 32, 48, 239, 254
HOLD_PENALTY, DELAY_PENALTY, TIMEOUT = 64, 66, 65
CENTER_OUT = Layout(
    start=(16,), end=(239,), reward=(48,), penalty=(64, 65, 66),
    times={"hold_start_time": ((80,), 1), "delay_start_time": (tuple(range(17, 26)), 1), "go_cue_time": ((32,), 1), "reach_end_time": (PERIPHERAL, 1), "reward_start_time": ((48,), 1), "penalty_start_time": ((64, 65, 66), 1), "pause_start_time": ((254,), 1)},
    flags={"hold_completed": tuple(range(17, 26)), "delay_completed": (32,), "reach_completed": PERIPHERAL},
    targets={"target_idx": tuple(range(17, 26))},
    spans={"reaction_window": ("go_cue_time", "reach_end_time")},
)
OUT = Layout(start=tuple(range(17, 26)), end=(239,), reward=(48,), penalty=(64, 65, 66), times={"target_on_time": (tuple(range(17, 26)), 1), "reach_end_time": (PERIPHERAL, 1), "reward_start_time": ((48,), 1)}, flags={"reach_completed": PERIPHERAL}, targets={"target_idx": tuple(range(17, 26))})
CORNERS = Layout(start=tuple(range(16, 26)), end=(239,), reward=(48,), penalty=(64, 65, 66), repeating=True, times={"first_target_time": (tuple(range(81, 90)), 1), "delay_start_time": (tuple(range(16, 26)), 2), "go_cue_time": ((32,), 1), "reach_end_time": (tuple(range(81, 90)), 2)}, flags={"delay_completed": (32,)}, targets={"target_idx": tuple(range(17, 26))})
FLASH = Layout(start=(16,), end=(239,), reward=(48,), times={})
TRACKING = Layout(start=(2,), end=(239,), reward=(48,), penalty=(65,), times={"tracking_start_time": ((80,), 1), "reward_start_time": ((48,), 1), "penalty_start_time": ((65,), 1)}, flags={"tracked": (80,)})
RANDOM_TARGETS = Layout(start=(16,), end=(239,), reward=(48,), penalty=(64, 65), times={"target_on_time": ((16,), 1), "reach_end_time": (tuple(range(80, 90)), 1)}, flags={"reach_completed": tuple(range(80, 90))})
READY_SET = Layout(start=(16,), end=(239,), reward=(48,), penalty=(64, 65, 66), times={"ready_time": ((112,), 1), "set_time": ((113,), 1), "go_time": ((114,), 1), "reach_end_time": (PERIPHERAL, 1)}, flags={"go_given": (114,)}, targets={"target_idx": tuple(range(17, 26))})


def tabulate(events: DataFrame, key, order, code: str, time: str, layout: Layout, session_order: str | None = None) -> DataFrame:
    """One row per trial of every entry: codes, times, flags, targets, the end of the trial before.

    ``prev_trial_end_time`` is the end of the trial before in order of sessions, 0.0 if that isn't earlier (another entry's clock)
    or there is none.  Entries stay independent: it is taken within an entry unless ``session_order`` names a column that
    orders all entries of one recording chain.
    """
    keys = _keys(key)
    cut = trial_segments(events, keys, order, code, list(layout.start), list(layout.end), repeating=layout.repeating)
    rows = segment_contents(events, cut, keys, order, code, time)
    rows = rows.withColumns({"trial_start_time": F.element_at("times", 1), "trial_end_time": F.element_at("times", -1), "reward": has_code(layout.reward), "penalty": has_code(layout.penalty) if layout.penalty else F.lit(False)})
    for name, (codes, n) in layout.times.items():
        rows = rows.withColumn(name, first_time(codes, n))
    for name, codes in layout.flags.items():
        rows = rows.withColumn(name, has_code(codes))
    for name, codes in layout.targets.items():
        rows = rows.withColumn(name, F.coalesce(first_code(codes) - F.lit(codes[0]) + 1, F.lit(0)))
    for name, (a, b) in layout.spans.items():
        rows = rows.withColumn(name, F.col(b) - F.col(a))
    w = Window.partitionBy(*([session_order] if session_order else keys)).orderBy("start_i")
    before = F.lag("trial_end_time").over(w)
    return rows.withColumn("prev_trial_end_time", F.when(before < F.col("trial_start_time"), before).otherwise(F.lit(0.0)))


def tabulate_flash(events: DataFrame, key, order, code: str, time: str, layout: Layout = FLASH) -> DataFrame:
    """Rewarded flash trials with the flash's start and end and the bounds of the trials around it."""
    rows = tabulate(events, key, order, code, time, layout)
    w = Window.partitionBy(*_keys(key)).orderBy("start_i")
    rows = rows.withColumns({"flash_start_time": F.try_element_at("times", F.lit(1)), "flash_end_time": F.try_element_at("times", F.lit(3)), "next_trial_start_time": F.lead("trial_start_time").over(w)})
    return rows.where("reward")


def with_metadata(trials: DataFrame, sessions: DataFrame, key, columns: list[str], source: str = "params") -> DataFrame:
    """``trials`` with columns of their session's JSON ``source``; a column the session lacks is null."""
    keys = _keys(key)
    picked = sessions.select(*keys, *[F.get_json_object(source, f"$.{c}").alias(c) for c in columns])
    return trials.join(picked, keys, "left")


def target_locations(trials: DataFrame, order: str, index: str = "target_idx", location: str = "target", digits: int = 4) -> DataFrame:
    """``(index, location)``: the first location of each target with its (x, z, y) turned to (x, y, z) and rounded."""
    first = trials.groupBy(index).agg(F.min_by(location, order).alias("__l"))
    turned = F.array(*[F.round(F.element_at("__l", k), digits) for k in (1, 3, 2)])
    return first.select(index, turned.alias(location))


def poisson_trials(spans: DataFrame, key, start: str, end: str, mu: float = 0.25, refractory: float = 0.1, seed: int = 1) -> DataFrame:
    """Trigger times of a seeded Poisson process between each entry's first and last clock; intervals are at least ``refractory``.

    Exponential intervals are hashed from entry and number, as many as the span can hold, and summed.
    """
    keys = _keys(key)
    most = F.ceil((F.col(end) - F.col(start)) / F.lit(max(refractory, mu / 20))).cast("int")
    n = spans.withColumn("n", F.explode(F.sequence(F.lit(1), F.greatest(F.lit(1), most))))
    u = (F.pmod(F.xxhash64(*keys, "n", F.lit(seed)), F.lit(1 << 52)).cast("double") + 0.5) / F.lit(float(1 << 52))
    gap = F.greatest(F.lit(refractory), -F.lit(mu) * F.log(u))
    w = Window.partitionBy(*keys).orderBy("n").rowsBetween(Window.unboundedPreceding, 0)
    return n.withColumn("trigger", F.col(start) + F.sum(gap).over(w)).where(F.col("trigger") < F.col(end)).select(*keys, "n", "trigger")
