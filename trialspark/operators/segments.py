"""Event segmentation and trial alignment.

Tables are long: an event table has key columns (the entry), an order and an event column.  Window work is done within an
entry; markers are filtered before they are paired, and contents are fetched by equality joins on positions, so no plan
holds a whole entry in memory or compares all pairs.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _keys(key) -> list[str]:
    return [key] if isinstance(key, str) else list(key)


def _one_of(col: Column, values) -> Column:
    return F.coalesce(col.isin(*(values if isinstance(values, (list, tuple, set, range)) else [values])), F.lit(False))


def numbered(events: DataFrame, key, order, name: str = "i") -> DataFrame:
    """``events`` with each row's position (from 0) within its key."""
    order = _keys(order)
    return events.withColumn(name, (F.row_number().over(Window.partitionBy(*_keys(key)).orderBy(*order)) - 1).cast("long"))


def trial_segments(events: DataFrame, key, order, event: str, start, end, time: str | None = None, repeating: bool = False) -> DataFrame:
    """Segments from a start to an end event: ``key..., start_i, end_i, start_event, end_event`` (and times).

    Default: a start gives a segment if the next start or end event is an end and no start.  ``repeating``: a start gives one
    with the first end after it unless it lies inside the segment before.  A last start without an end gives none.
    """
    keys = _keys(key)
    rows = numbered(events, keys, order)
    rows = rows.withColumns({"__s": _one_of(F.col(event), start), "__x": _one_of(F.col(event), end)}).where("__s or __x")
    mark = F.struct(*([F.col("i")] + [F.col(event).alias("event")] + ([F.col(time).alias("time")] if time else []) + [F.col("__s").alias("s")]))
    if repeating:
        after = Window.partitionBy(*keys).orderBy(F.col("i").desc()).rowsBetween(Window.unboundedPreceding, -1)
        found = rows.withColumn("__e", F.last(F.when(F.col("__x"), mark), ignorenulls=True).over(after)).where(F.col("__s") & F.col("__e").isNotNull())
        first = Window.partitionBy(*keys, "__e.i").orderBy("i")
        found = found.withColumn("__n", F.row_number().over(first)).where("__n = 1")
    else:
        found = rows.withColumn("__e", F.lead(mark).over(Window.partitionBy(*keys).orderBy("i"))).where(F.col("__s") & F.col("__e").isNotNull() & ~F.col("__e.s"))
    cols = [F.col(k) for k in keys] + [F.col("i").alias("start_i"), F.col("__e.i").alias("end_i"), F.col(event).alias("start_event"), F.col("__e.event").alias("end_event")]
    if time:
        cols += [F.col(time).alias("start_time"), F.col("__e.time").alias("end_time")]
    return found.select(*cols)


def segment_contents(events: DataFrame, segments: DataFrame, key, order, event: str, time: str) -> DataFrame:
    """``segments`` with ``events`` and ``times``, lists of what each holds, endpoints included, in order."""
    keys = _keys(key)
    wide = segments.withColumn("i", F.explode(F.sequence("start_i", "end_i")))
    rows = numbered(events, keys, order).select(*keys, "i", F.col(event).alias("__event"), F.col(time).alias("__time"))
    got = wide.join(rows, [*keys, "i"]).groupBy(*segments.columns).agg(F.sort_array(F.collect_list(F.struct("i", "__event", "__time"))).alias("__c"))
    return got.select(*segments.columns, F.transform("__c", lambda c: c["__event"]).alias("events"), F.transform("__c", lambda c: c["__time"]).alias("times"))


def trial_separate(events: DataFrame, key, order, event: str, time: str, start, n_events: int = 8, offset: int = 0, pad=None) -> DataFrame:
    """The ``n_events`` events from each start event (plus ``offset``) on; ``pad`` where there are none."""
    keys = _keys(key)
    w = Window.partitionBy(*keys).orderBy(*_keys(order))
    at = lambda c, k: F.lead(c, k).over(w) if k >= 0 else F.lag(c, -k).over(w)
    fill = lambda c: F.coalesce(c, F.lit(pad)) if pad is not None else c
    rows = events.withColumns({
        "i": (F.row_number().over(w) - 1).cast("long"),
        "events": F.array(*[fill(at(event, k + offset)) for k in range(n_events)]),
        "times": F.array(*[at(time, k + offset) for k in range(n_events)]),
    })
    return rows.where(_one_of(F.col(event), start)).select(*keys, "i", "events", "times")


def trial_align_events(trials: DataFrame, event, events: str = "events", times: str = "times") -> DataFrame:
    """``aligned``: each trial's times less that of its first ``event``; padded (null) times become 0; no match raises."""
    at = F.array_position(F.col(events), F.lit(event))
    t0 = F.when(at > 0, F.element_at(times, at.cast("int"))).otherwise(F.raise_error(F.lit(f"a trial has no {event}")).cast("double"))
    return trials.withColumn("__t0", t0).withColumn("aligned", F.transform(times, lambda t: F.coalesce(t - F.col("__t0"), F.lit(0.0)))).drop("__t0")


def window_rows(triggers: DataFrame, trigger: str, before: float, after: float, samplerate: float) -> DataFrame:
    """``triggers`` exploded to the samples of their windows: ``k`` (from 0) and ``i``, the sample's number.

    floor((before + after) fs) samples from round-half-even((t - before) fs) on.  Null triggers keep their rows with null ``i``.
    """
    import math

    n = math.floor(round((before + after) * samplerate, 9))
    first = F.bround((F.col(trigger) - F.lit(before)) * F.lit(float(samplerate)), 0).cast("long")
    return triggers.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(max(0, n - 1))))).withColumn("i", first + F.col("k"))


def trial_align_data(samples: DataFrame, triggers: DataFrame, key, trigger: str, value: str, before: float, after: float, samplerate: float, sample: str = "i") -> DataFrame:
    """A row for each trigger and offset ``k`` with the sample there, null outside the recording.

    Windows are exploded to sample numbers and joined by equality, so the work is the windows' size, not triggers x samples.
    Triggers at or after the recording's end less ``after`` have only nulls.
    """
    keys = _keys(key)
    length = samples.groupBy(*keys).agg(((F.max(sample) + 1) / F.lit(float(samplerate)) - F.lit(after)).alias("__last"))
    grid = window_rows(triggers.join(length, keys, "left"), trigger, before, after, samplerate)
    grid = grid.withColumn("i", F.when(F.col(trigger) < F.col("__last"), F.col("i"))).drop("__last")
    return grid.join(samples.select(*keys, F.col(sample).alias("i"), F.col(value)), [*keys, "i"], "left")


def trial_align_times(stamps: DataFrame, triggers: DataFrame, key, stamp: str, trigger: str, before: float, after: float, subtract: bool = True) -> DataFrame:
    """Timestamps in (t - before, t + after] of each trigger t, relative to it if ``subtract``.

    Both sides are put into time bins as wide as the window, each trigger into the two or three it meets, and joined on the bin.
    """
    keys, width = _keys(key), float(before + after)
    lo, hi = F.col(trigger) - F.lit(before), F.col(trigger) + F.lit(after)
    t = triggers.withColumn("__bin", F.explode(F.sequence(F.floor(lo / width), F.floor(hi / width))))
    s = stamps.withColumn("__bin", F.floor(F.col(stamp) / width))
    out = t.join(s, [*keys, "__bin"]).where((F.col(stamp) > lo) & (F.col(stamp) <= hi)).drop("__bin")
    return out.withColumn("aligned", F.col(stamp) - F.col(trigger) if subtract else F.col(stamp))


def data_segments(samples: DataFrame, segments: DataFrame, key, start: str, end: str, samplerate: float, sample: str = "i") -> DataFrame:
    """Samples int(start fs) to int(end fs), the last excluded, of each segment, with their number ``k`` in it."""
    keys = _keys(key)
    a, b = F.greatest(F.lit(0), (F.col(start) * samplerate).cast("long")), (F.col(end) * samplerate).cast("long")
    grid = segments.where(b > a).withColumn("__a", a).withColumn("i", F.explode(F.sequence(a, b - 1)))
    rows = samples if sample == "i" else samples.withColumnRenamed(sample, "i")
    return grid.join(rows, [*keys, "i"]).withColumn("k", F.col("i") - F.col("__a")).drop("__a")


def unique_conditions(trials: DataFrame, conditions: list[str], name: str = "condition") -> DataFrame:
    """``trials`` with a dense index (from 0) of their conditions, rounded to 6 places, in their order.

    Only the distinct conditions are ranked in one place.
    """
    number = lambda c: trials.schema[c].dataType.typeName() in ("double", "float", "decimal")
    rounded = trials.withColumns({f"__{c}": F.round(c, 6) if number(c) else F.col(c) for c in conditions})
    cols = [f"__{c}" for c in conditions]
    ranked = rounded.select(*cols).distinct().withColumn(name, F.dense_rank().over(Window.orderBy(*cols)) - 1)
    joined = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in cols]
    on = joined[0]
    for j in joined[1:]:
        on = on & j
    return rounded.alias("a").join(ranked.alias("b"), on).select(*[f"a.{c}" for c in trials.columns], name)


def locate_trials_with_event(trials: DataFrame, codes: list, events: str = "events") -> DataFrame:
    """A row ``(code, ...)`` for each code and trial that holds it."""
    return trials.withColumn("code", F.explode(F.array(*[F.lit(c) for c in codes]))).where(F.array_contains(F.col(events), F.col("code")))


def sample_events(events: DataFrame, key, time: str, event: str, samplerate: float) -> DataFrame:
    """Events by frame: ``(key, frame, event)`` once each, frame = round-half-even(t fs); pivot for a matrix."""
    return events.select(*_keys(key), F.bround(F.col(time) * samplerate, 0).cast("long").alias("frame"), F.col(event)).distinct()


def onehot(frames: DataFrame, key, row: str, event: str, names: list) -> DataFrame:
    """A 0/1 column for each of ``names``, by (key, row)."""
    return frames.groupBy(*_keys(key), row).agg(*[F.max((F.col(event) == n).cast("int")).alias(str(n)) for n in names])


def reward_intervals(stamps: DataFrame, key, time: str, value: str) -> DataFrame:
    """``(on, off)`` of each rising and the falling stamp with the same number; unequal numbers raise."""
    keys = _keys(key)
    n = F.row_number().over(Window.partitionBy(*keys, "__up").orderBy(time))
    rows = stamps.withColumn("__up", F.col(value).cast("boolean")).withColumn("n", n)
    out = rows.groupBy(*keys, "n").agg(F.max(F.when(F.col("__up"), F.col(time))).alias("on"), F.max(F.when(~F.col("__up"), F.col(time))).alias("off"))
    whole = F.when(F.col("on").isNull() | F.col("off").isNull(), F.raise_error(F.lit("rising and falling stamps differ in number")).cast("double"))
    return out.withColumn("off", F.coalesce(whole, F.col("off")))


def target_events(events: DataFrame, key, order, target: str, on: Column, off: Column, location: str) -> DataFrame:
    """For each event and target, the target's location while it is on, else null: the last on or off decides."""
    w = Window.partitionBy(*_keys(key), target).orderBy(*_keys(order)).rowsBetween(Window.unboundedPreceding, 0)
    state = F.last(F.when(on, F.lit(True)).when(off, F.lit(False)), ignorenulls=True).over(w)
    return events.withColumn("shown", F.when(F.coalesce(state, F.lit(False)), F.col(location)))


#: Codes that become one literal; a longer table is met by the distinct codes of the events first.
LITERAL_CODES = 1000


def decode_events(events: DataFrame, codes: DataFrame, code: str = "code") -> DataFrame:
    """``event`` (the name with the largest base at most the code) and ``data`` (code less base); null below the least base.

    ``codes(name, base)`` is a configuration table of any length; of equal bases the last name counts.
    """
    table = [(int(r["base"]), r["name"]) for r in codes.select("name", "base").limit(LITERAL_CODES + 1).collect()]
    if len(table) <= LITERAL_CODES:
        bases = F.array(*[F.struct(F.lit(b).cast("long").alias("base"), F.lit(n).alias("name")) for b, n in sorted(table)])
        hit = F.array_max(F.filter(bases, lambda x: x["base"] <= F.col(code)))
        return events.withColumn("__h", hit).withColumns({"event": F.col("__h.name"), "data": F.col(code) - F.col("__h.base")}).drop("__h")
    named = codes.groupBy(F.col("base").cast("long").alias("__c")).agg(F.max("name").alias("__n"))
    seen = events.select(F.col(code).cast("long").alias("__c")).distinct().withColumn("__n", F.lit(None).cast("string"))
    both = named.withColumn("__base", F.col("__c")).unionByName(seen.withColumn("__base", F.lit(None).cast("long")))
    upto = Window.orderBy("__c", F.col("__base").isNull()).rowsBetween(Window.unboundedPreceding, 0)  # distinct codes only
    last = F.last(F.when(F.col("__base").isNotNull(), F.struct("__base", "__n")), ignorenulls=True).over(upto)
    known = both.withColumn("__h", last).where("__base is null").select("__c", "__h")
    got = events.join(known, F.col(code) == F.col("__c"), "left")
    return got.withColumns({"event": F.col("__h.__n"), "data": F.col(code) - F.col("__h.__base")}).drop("__c", "__h")
