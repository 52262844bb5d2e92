"""All active declarations as one aggregation plan.

Declarations that read the same event type, entity scope and window form a *group*. An event
becomes one row per group it belongs to, never one row per declaration or per sliding window, and
the declarations of a group share that row as numbered *slots*. Rows are reduced to *panes*: a
tumbling window is one pane, a sliding one consists of panes as long as the greatest common divisor
of size and slide. The shuffle carries one row per (entity, group, pane), already reduced on the map
side, so a hot entity costs one row per map task.

    scan -> explode groups -> partial agg -> exchange -> agg by pane -> unpivot slots

Only where windows slide are panes spread over the windows they belong to, and merged once more.
Every pane is then in ``size / slide`` windows, however many events it holds.

A DISTINCT_COUNT declaration is a group of its own whose distinct value is part of the
grouping key. Its values are spread over the cluster and counted in a second, small step;
no set of values is ever held in one place.
"""

from __future__ import annotations

import math
from collections.abc import Collection, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.definitions import ANY_ENTITY, FeatureDefinition
from tidemark.functions.fields import Resolver, compute_once, prepare_fields
from tidemark.functions.filters import compile_filter
from tidemark.functions.keys import key_problem
from tidemark.functions.windows import floor_to, pane_starts, window_expiry

# Slots per group row: wider rows save shuffled rows, but very wide ones leave codegen.
MAX_SLOTS = 8
# Windows to a pane from which on panes are brought together, and their windows made where they lie.
SPREAD = 8

ENTITY_KEYS = ["entity_type", "entity_id"]
FEATURE_KEYS = [*ENTITY_KEYS, "feature_name", "definition_version", "window_start"]


@dataclass(frozen=True)
class Contribution:
    """What one event adds to one declaration."""

    matches: Column
    num: Column
    den: Column
    distinct_value: Column
    problem: Column


@dataclass(frozen=True)
class Group:
    event_type: str
    entity_type: str
    window_type: str
    window: int | None
    slide: int | None
    positions: tuple[int, ...]
    members: tuple[FeatureDefinition, ...]

    @property
    def is_distinct(self) -> bool:
        return self.members[0].aggregation == "DISTINCT_COUNT"

    @property
    def is_sliding(self) -> bool:
        return self.window_type == "SLIDING" and self.window != self.slide

    @property
    def pane(self) -> int | None:
        """Millis that are always in the same windows together; None without windows."""
        return own_pane(self.members[0])


def own_pane(definition: FeatureDefinition) -> int | None:
    """The longest stretch that is always in the same windows of a declaration together."""
    if definition.window_type != "SLIDING":
        return definition.window
    return math.gcd(definition.window, definition.slide)


def active_only(definitions: Sequence[FeatureDefinition]) -> list[FeatureDefinition]:
    return [d for d in definitions if d.state == "ACTIVE"]


def event_scope(definition: FeatureDefinition) -> Column:
    """Event type and entity type of a declaration, without its field filter."""
    scope = F.col("event_type") == definition.event_type
    if definition.entity_type != ANY_ENTITY:
        scope = scope & (F.col("entity.type") == definition.entity_type)
    return F.coalesce(scope, F.lit(False))


def contribution(definition: FeatureDefinition, field: Resolver) -> Contribution:
    """The Columns one declaration needs from an event."""
    zero, one = F.lit(0.0), F.lit(1.0)
    none_text = F.lit(None).cast("string")
    scope = event_scope(definition)
    declared = compile_filter(definition.filter, field)
    matches = scope & declared.matches
    problem = F.when(scope & declared.unusable, F.lit("filter value is not a number"))

    if definition.aggregation == "COUNT":
        return Contribution(matches, one, zero, none_text, problem)

    value = field(definition.value_field)
    missing = F.when(matches & ~value.present, F.lit(f"missing {definition.value_field}"))
    if definition.aggregation == "DISTINCT_COUNT":
        return Contribution(matches, one, zero, value.text, F.coalesce(problem, missing))

    not_number = F.when(
        matches & ~value.is_number, F.lit(f"{definition.value_field} is not a number")
    )
    problem = F.coalesce(problem, missing, not_number)
    if definition.aggregation == "SUM":
        return Contribution(matches, value.number, zero, none_text, problem)

    if definition.aggregation == "AVG":
        if not definition.has_weight:
            return Contribution(matches, value.number, one, none_text, problem)
        weight = field(definition.weight_field)
        problem = F.coalesce(
            problem,
            F.when(matches & ~weight.present, F.lit(f"missing {definition.weight_field}")),
            F.when(
                matches & ~weight.is_number,
                F.lit(f"{definition.weight_field} is not a number"),
            ),
        )
        return Contribution(
            matches, value.number * weight.number, weight.number, none_text, problem
        )

    numerator = compile_filter(definition.numerator_filter, field)
    problem = F.coalesce(
        problem,
        F.when(matches & numerator.unusable, F.lit("numerator filter value is not a number")),
    )
    share = F.when(numerator.matches, value.number).otherwise(zero)
    return Contribution(matches, share, value.number, none_text, problem)


def _paths(definitions: Sequence[FeatureDefinition]) -> list[str]:
    found = []
    for d in definitions:
        found += [d.value_field, d.weight_field if d.has_weight else None]
        found += [f.field for f in (d.filter, d.numerator_filter) if f]
    return [path for path in found if path]


def _parts(
    events: DataFrame, definitions: Sequence[FeatureDefinition]
) -> tuple[DataFrame, list[Contribution]]:
    prepared, field = prepare_fields(events, _paths(definitions))
    return prepared, [contribution(d, field) for d in definitions]


def _any(conditions: Sequence[Column]) -> Column:
    """Whether one of them holds; a balanced tree, as a chain of hundreds overflows Spark's stack."""
    if not conditions:
        return F.lit(False)
    if len(conditions) == 1:
        return conditions[0]
    half = len(conditions) // 2
    return _any(conditions[:half]) | _any(conditions[half:])


def _verdict(definitions: Sequence[FeatureDefinition]) -> list[Column]:
    """``supported`` and ``failure`` from the columns ``_m{i}`` and ``_problem{i}``."""
    supported = _any([F.col(f"_m{i}") for i in range(len(definitions))])
    bad_key = F.when(supported, key_problem(F.col("entity.type"), F.col("entity.id")))
    problems = [F.col(f"_problem{i}") for i in range(len(definitions))]
    return [
        supported.alias("supported"),
        F.coalesce(bad_key, *problems, F.lit(None).cast("string")).alias("failure"),
    ]


def annotate(
    events: DataFrame,
    definitions: Sequence[FeatureDefinition],
    names: Collection[str] | None = None,
) -> DataFrame:
    """Events with what each active declaration makes of them.

    Adds, for the i-th active declaration, ``_m{i}`` (does it take the event), ``_num{i}``,
    ``_den{i}``, ``_dv{i}``; and ``supported`` (any takes it) and ``failure`` (the first
    problem a taking declaration has with it, or null). Every value is computed once per event;
    with ``names``, values only of declarations so named.
    """
    active = active_only(definitions)
    if not active:
        return events.select("*", *_verdict(active))
    prepared, parts = _parts(events, active)
    columns, kept = [], []
    for i, part in enumerate(parts):
        columns += [part.matches.alias(f"_m{i}"), part.problem.alias(f"_problem{i}")]
        if names is None or active[i].name in names:
            values = {"_num": part.num, "_den": part.den, "_dv": part.distinct_value}
            columns += [value.alias(f"{what}{i}") for what, value in values.items()]
            kept += [f"{what}{i}" for what in ("_m", *values)]
    # Behind a barrier: later filters and explodes read plain columns. Otherwise every use of a
    # declaration's match copies its conditions, and the plan grows with each copy.
    made = compute_once(prepared, *columns)
    verdict = compute_once(made, *_verdict(active))
    return verdict.select(*events.columns, *kept, "supported", "failure")


def with_failure(events: DataFrame, definitions: Sequence[FeatureDefinition]) -> DataFrame:
    """Events with ``supported`` and ``failure`` only: no value is read out, only judged."""
    active = active_only(definitions)
    if not active:
        return events.select("*", *_verdict(active))
    prepared, parts = _parts(events, active)
    judged = [p.matches.alias(f"_m{i}") for i, p in enumerate(parts)]
    judged += [p.problem.alias(f"_problem{i}") for i, p in enumerate(parts)]
    verdict = compute_once(compute_once(prepared, *judged), *_verdict(active))
    return verdict.select(*events.columns, "supported", "failure")


def match_definitions(
    events: DataFrame, definitions: Sequence[FeatureDefinition]
) -> DataFrame:
    """One row per (event, matching declaration)."""
    names = [
        F.when(
            F.col(f"_m{i}"),
            F.struct(
                F.lit(d.name).alias("feature_name"),
                F.lit(d.version).alias("definition_version"),
            ),
        )
        for i, d in enumerate(active_only(definitions))
    ]
    wanted = events.where(F.col("event_type").isin(_wanted_types(definitions)))
    return (
        annotate(wanted, definitions)
        .select(*events.columns, F.explode(F.array(*names)).alias("m"))
        .where(F.col("m").isNotNull())
        .select(*events.columns, "m.feature_name", "m.definition_version")
    )


def _wanted_types(definitions: Sequence[FeatureDefinition]) -> list[str]:
    # Not inferred through the explode, so stated: lets the scan skip other event types.
    return sorted({d.event_type for d in active_only(definitions)})


def group_definitions(
    definitions: Sequence[FeatureDefinition],
    max_slots: int = MAX_SLOTS,
    names: Collection[str] | None = None,
) -> list[Group]:
    """Active declarations (of these names) by shared event scope and window, ``max_slots`` each."""
    buckets: dict[tuple, list[int]] = {}
    groups: list[Group] = []
    active = active_only(definitions)
    for i, d in enumerate(active):
        if names is not None and d.name not in names:
            continue
        scope = (d.event_type, d.entity_type, d.window_type, d.window, d.slide)
        if d.aggregation == "DISTINCT_COUNT":
            groups.append(Group(*scope, (i,), (d,)))
        else:
            buckets.setdefault(scope, []).append(i)
    for scope, members in buckets.items():
        for start in range(0, len(members), max_slots):
            picked = tuple(members[start : start + max_slots])
            groups.append(Group(*scope, picked, tuple(active[i] for i in picked)))
    return groups


def _slots(group: Group, width: int) -> list[Column]:
    """Per slot the values an annotated event adds; null where the declaration passes."""
    values = []
    for slot in range(width):
        if slot < len(group.members):
            i = group.positions[slot]
            hit = F.col(f"_m{i}")
            n, num, den = F.lit(1), F.col(f"_num{i}"), F.col(f"_den{i}")
            at = F.col("arrival_time")
        else:
            hit, n, num, den, at = F.lit(False), *[F.lit(None)] * 4
        values += [
            F.when(hit, n.cast("bigint")).alias(f"n{slot}"),
            F.when(hit, num.cast("double")).alias(f"num{slot}"),
            F.when(hit, den.cast("double")).alias(f"den{slot}"),
            F.when(hit, at.cast("timestamp")).alias(f"at{slot}"),
        ]
    return values


def explode_groups(
    annotated: DataFrame,
    groups: Sequence[Group],
    carry: Sequence[str] = (),
    with_panes: bool = True,
) -> DataFrame:
    """One row per (annotated event, group) with slot values and the start of its pane, ``start_ms``.

    ``with_panes=False`` leaves the windows to the caller.
    """
    width = max(len(g.members) for g in groups)
    any_distinct = any(g.is_distinct for g in groups)
    rows = []
    for index, group in enumerate(groups):
        hit = F.lit(False)
        for i in group.positions:
            hit = hit | F.col(f"_m{i}")
        fields = [F.lit(index).alias("group_id")]
        if with_panes:
            millis = F.unix_millis("event_time")
            start = F.lit(None).cast("bigint") if group.pane is None else floor_to(millis, group.pane)
            fields.append(start.alias("start_ms"))
        if any_distinct:
            fields.append(F.col(f"_dv{group.positions[0]}").alias("distinct_value"))
        rows.append(F.when(hit, F.struct(*fields, *_slots(group, width))))
    return (
        annotated.select(
            F.col("entity.type").alias("entity_type"),
            F.col("entity.id").alias("entity_id"),
            *carry,
            F.explode(F.array(*rows)).alias("g"),
        )
        .where(F.col("g").isNotNull())
        .select(*ENTITY_KEYS, *carry, "g.*")
    )


def slide_panes(panes: DataFrame, groups: Sequence[Group]) -> DataFrame:
    """Pane rows -> one row per window a pane belongs to, ``start_ms`` being the window's start.

    With many windows to a pane, the panes are first brought together by stretches as long as their
    window (never a whole entity), so that the rows of neighbouring panes merge before they move.
    """

    def of_group(values: Sequence[int | None]) -> Column:
        return F.array(*[F.lit(v).cast("bigint") for v in values])[F.col("group_id")]

    size = of_group([g.window if g.is_sliding else None for g in groups])
    slide = of_group([g.slide if g.is_sliding else None for g in groups])
    pane = F.col("start_ms")
    if max(g.window // g.slide for g in groups if g.is_sliding) > SPREAD:
        stretch = F.floor(pane / size).alias("stretch")
        panes = panes.repartition(*ENTITY_KEYS, "group_id", stretch)
    starts = F.when(size.isNull(), F.array(pane)).otherwise(pane_starts(pane, size, slide))
    return panes.select(
        *[c for c in panes.columns if c != "start_ms"], F.explode(starts).alias("start_ms")
    )


def window_sums(panes: DataFrame, groups: Sequence[Group], width: int) -> DataFrame:
    """Pane rows -> one row per window, ``start_ms`` being its start: no window is shuffled or sorted.

    Windows are dealt to stretches of time as long as they are themselves, and a pane is copied to the
    two stretches at most whose windows hold it. The panes of one entity and stretch, a number fixed by
    the declaration, lie in one array. Between the starts at which a pane enters or leaves, all windows
    hold the same panes, so those are added up once and the windows spread last.
    """

    def of_group(values: Sequence[int | None]) -> Column:
        return F.array(*[F.lit(v).cast("bigint") for v in values])[F.col("group_id")]

    size = of_group([g.window if g.is_sliding else None for g in groups])
    slide = of_group([g.slide if g.is_sliding else None for g in groups])
    pane = F.col("start_ms")
    values = [f"{what}{slot}" for slot in range(width) for what in ("n", "num", "den", "at")]
    # Without sliding windows a pane is its own stretch and its own window.
    lies_in = F.when(size.isNull(), F.array(pane)).otherwise(
        F.sequence(
            F.floor((floor_to(pane - size, slide) + slide) / size), F.floor(floor_to(pane, slide) / size), F.lit(1).cast("bigint")
        )
    )
    keys = [*ENTITY_KEYS, "group_id", "stretch", *(["distinct_value"] if "distinct_value" in panes.columns else [])]
    held = (
        panes.select(*panes.columns, F.explode(lies_in).alias("stretch"))
        .groupBy(*keys)
        .agg(F.collect_list(F.struct("start_ms", *values)).alias("panes"))
    )
    stretch = F.col("stretch")
    # The first and the last window of the stretch, then of a pane in it.
    ends = compute_once(
        held,
        size.alias("size_ms"),
        slide.alias("slide_ms"),
        floor_to(stretch * size + slide - 1, slide).alias("first_ms"),
        floor_to(stretch * size + size - 1, slide).alias("last_ms"),
    )
    slide = F.col("slide_ms")

    def entered(p: Column) -> Column:
        first = F.greatest(floor_to(p["start_ms"] - F.col("size_ms"), slide) + slide, F.col("first_ms"))
        last = F.least(floor_to(p["start_ms"], slide), F.col("last_ms"))
        return F.struct(first.alias("first"), last.alias("last"), *[p[v].alias(v) for v in values])

    entries = compute_once(ends, F.transform("panes", entered).alias("entries"))
    cuts = F.flatten(F.transform("entries", lambda e: F.array(e["first"], e["last"] + slide)))
    cut = compute_once(entries, F.array_sort(F.array_distinct(cuts)).alias("cuts"))

    def add(total: Column, e: Column) -> Column:
        both = [
            F.greatest(total[v], e[v]) if v.startswith("at") else F.coalesce(total[v] + e[v], total[v], e[v]) for v in values
        ]
        return F.struct(*[c.alias(v) for v, c in zip(values, both)])

    kinds = {f.name: f.dataType for f in panes.schema}
    nothing = F.struct(*[F.lit(None).cast(kinds[v]).alias(v) for v in values])

    def held_from(start: Column, i: Column) -> Column:
        inside = F.filter("entries", lambda e: (e["first"] <= start) & (e["last"] >= start))
        return F.struct(
            start.alias("first"),
            (F.get("cuts", i + 1) - slide).alias("last"),
            F.size(inside).alias("panes"),
            F.aggregate(inside, nothing, add).alias("sums"),
        )

    own = F.transform(
        "panes",
        lambda p: F.struct(
            p["start_ms"].alias("first"),
            p["start_ms"].alias("last"),
            F.lit(1).alias("panes"),
            F.struct(*[p[v].alias(v) for v in values]).alias("sums"),
        ),
    )
    between = F.transform(F.slice("cuts", F.lit(1), F.greatest(F.size("cuts") - 1, F.lit(0))), held_from)
    runs = F.when(F.col("size_ms").isNull(), own).otherwise(F.filter(between, lambda r: r["panes"] > 0))
    kept = [k for k in keys if k != "stretch"]
    starts = F.when(F.col("size_ms").isNull(), F.array("r.first")).otherwise(F.sequence("r.first", "r.last", slide))
    return (
        compute_once(cut, runs.alias("runs"))
        .select(*kept, "size_ms", "slide_ms", F.explode("runs").alias("r"))
        .select(*kept, F.explode(starts).alias("start_ms"), *[F.col("r.sums")[v].alias(v) for v in values])
    )


def slot_sums(width: int) -> list[Column]:
    sums = []
    for slot in range(width):
        sums += [
            F.sum(f"n{slot}").alias(f"n{slot}"),
            F.sum(f"num{slot}").alias(f"num{slot}"),
            F.sum(f"den{slot}").alias(f"den{slot}"),
            F.max(f"at{slot}").alias(f"at{slot}"),
        ]
    return sums


def unpivot_slots(grouped: DataFrame, groups: Sequence[Group]) -> DataFrame:
    """Grouped rows back to one row per (entity, feature, version, window)."""
    width = max(len(g.members) for g in groups)
    has_distinct = "distinct_value" in grouped.columns

    def label(slot: int, what: str, data_type: str) -> Column:
        values = [
            getattr(g.members[slot], what) if slot < len(g.members) else None for g in groups
        ]
        return F.array(*[F.lit(v).cast(data_type) for v in values])[F.col("group_id")]

    slots = [
        F.when(
            F.col(f"n{slot}").isNotNull(),
            F.struct(
                label(slot, "name", "string").alias("feature_name"),
                label(slot, "version", "int").alias("definition_version"),
                F.col(f"n{slot}").alias("n"),
                F.col(f"num{slot}").alias("num"),
                F.col(f"den{slot}").alias("den"),
                F.col(f"at{slot}").alias("updated_at"),
            ),
        )
        for slot in range(width)
    ]
    distinct_value = (
        F.col("distinct_value") if has_distinct else F.lit(None).cast("string")
    )
    return (
        grouped.select(
            *ENTITY_KEYS,
            "window_start",
            distinct_value.alias("distinct_value"),
            F.explode(F.array(*slots)).alias("s"),
        )
        .where(F.col("s").isNotNull())
        .select(
            *ENTITY_KEYS,
            "s.feature_name",
            "s.definition_version",
            "window_start",
            "distinct_value",
            "s.n",
            "s.num",
            "s.den",
            "s.updated_at",
        )
    )


def partials(
    events: DataFrame,
    definitions: Sequence[FeatureDefinition],
    *,
    checked: bool = False,
    max_slots: int = MAX_SLOTS,
    names: Collection[str] | None = None,
) -> DataFrame:
    """Mergeable state of every active declaration (of these names) over these events.

    An event any matching declaration cannot use is invalid and adds nothing, also to those not
    named; pass ``checked=True`` when such events are gone already.
    """
    if checked and names is not None:
        definitions = [d for d in definitions if d.name in names]
    groups = group_definitions(definitions, max_slots, names)
    if not groups:
        raise ValueError("no active feature definition")
    wanted = events.where(F.col("event_type").isin(sorted({g.event_type for g in groups})))
    annotated = annotate(wanted, definitions, names)
    if not checked:
        annotated = annotated.where(F.col("failure").isNull())
    exploded = explode_groups(annotated, groups)
    keys = [*ENTITY_KEYS, "group_id", "start_ms"]
    if "distinct_value" in exploded.columns:
        keys.append("distinct_value")
    width = max(len(g.members) for g in groups)
    grouped = exploded.groupBy(*keys).agg(*slot_sums(width))
    if max([g.window // g.slide for g in groups if g.is_sliding], default=0) > SPREAD:
        grouped = window_sums(grouped, groups, width)
    elif any(g.is_sliding for g in groups):
        grouped = slide_panes(grouped, groups).groupBy(*keys).agg(*slot_sums(width))
    return unpivot_slots(grouped.withColumn("window_start", F.timestamp_millis("start_ms")), groups)


def merge_partials(*parts: DataFrame) -> DataFrame:
    """State over disjoint event sets -> state over their union."""
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged.groupBy(*FEATURE_KEYS, "distinct_value").agg(
        F.sum("n").alias("n"),
        F.sum("num").alias("num"),
        F.sum("den").alias("den"),
        F.max("updated_at").alias("updated_at"),
    )


def finish(state: DataFrame, definitions: Sequence[FeatureDefinition]) -> DataFrame:
    """State -> feature rows. Only distinct counts need another (small) shuffle."""
    active = active_only(definitions)
    if any(d.aggregation == "DISTINCT_COUNT" for d in active):
        state = state.groupBy(*FEATURE_KEYS).agg(
            F.sum("n").alias("n"),
            F.sum("num").alias("num"),
            F.sum("den").alias("den"),
            F.max("updated_at").alias("updated_at"),
            F.count("distinct_value").alias("distinct_n"),
        )
    else:
        state = state.withColumn("distinct_n", F.lit(0).cast("bigint"))
    return _feature_rows(state, active)


def _feature_rows(state: DataFrame, active: Sequence[FeatureDefinition]) -> DataFrame:
    """One row of state per feature key, distinct values counted as ``distinct_n`` -> feature rows."""
    kinds = {"ratio": [], "distinct": [], "expiry": {}}
    for d in active:
        if d.aggregation in ("AVG", "RATIO"):
            kinds["ratio"].append(identity(d))
        elif d.aggregation == "DISTINCT_COUNT":
            kinds["distinct"].append(identity(d))
        if d.window_type != "NONE":
            kinds["expiry"].setdefault((d.window, d.slide), []).append(identity(d))

    named = F.struct("feature_name", "definition_version")
    quotient = F.when(F.col("den") == 0, F.lit(0.0)).otherwise(F.try_divide("num", "den"))
    value = F.col("num")
    if kinds["ratio"]:
        value = F.when(named.isin(kinds["ratio"]), quotient).otherwise(value)
    if kinds["distinct"]:
        value = F.when(
            named.isin(kinds["distinct"]), F.col("distinct_n").cast("double")
        ).otherwise(value)
    expires_at = F.lit(None).cast("timestamp")
    for (size, slide), members in kinds["expiry"].items():
        expires_at = F.when(
            named.isin(members), window_expiry(F.col("updated_at"), size, slide)
        ).otherwise(expires_at)
    return state.select(
        *FEATURE_KEYS,
        value.alias("value"),
        "n",
        "num",
        "den",
        "updated_at",
        expires_at.alias("expires_at"),
    )


def identity(d: FeatureDefinition) -> Column:
    return F.struct(
        F.lit(d.name).alias("feature_name"), F.lit(d.version).alias("definition_version")
    )


def compute_features(
    events: DataFrame,
    definitions: Sequence[FeatureDefinition],
    *,
    checked: bool = False,
    max_slots: int = MAX_SLOTS,
    names: Collection[str] | None = None,
) -> DataFrame:
    """Feature rows of every active declaration, in one scan and one event-sized shuffle.

    ``names`` asks for some of them only; the others then cost no values and no rows.
    """
    state = partials(events, definitions, checked=checked, max_slots=max_slots, names=names)
    asked = [d for d in definitions if names is None or d.name in names]
    return finish(state, asked)


# Log2 of the registers of a sketch: 4,096 of them, a standard error of 1.6 % in at most 4 KB or so.
SKETCH_LOG2 = 12


def distinct_sketches(
    events: DataFrame,
    definitions: Sequence[FeatureDefinition],
    *,
    checked: bool = False,
    names: Collection[str] | None = None,
    log2: int = SKETCH_LOG2,
) -> DataFrame:
    """Mergeable state of the distinct counts alone, by a HyperLogLog sketch per feature row.

    The state of a row stays a few KB however many values there are, where exact state has a row
    per value. Counts of up to a few hundred values are still exact. Events are judged by all
    declarations, as in ``partials``.
    """
    groups = [g for g in group_definitions(definitions, names=names) if g.is_distinct]
    if not groups:
        raise ValueError("no active distinct count")
    wanted = events.where(F.col("event_type").isin(sorted({g.event_type for g in groups})))
    annotated = annotate(wanted, definitions, {d.name for g in groups for d in g.members})
    if not checked:
        annotated = annotated.where(F.col("failure").isNull())
    keys = [*ENTITY_KEYS, "group_id", "start_ms"]
    sketch = F.hll_sketch_agg("distinct_value", log2).alias("sketch")
    grouped = explode_groups(annotated, groups).groupBy(*keys).agg(*slot_sums(1), sketch)
    if any(g.is_sliding for g in groups):
        union = F.hll_union_agg("sketch").alias("sketch")
        grouped = slide_panes(grouped, groups).groupBy(*keys).agg(*slot_sums(1), union)

    def label(what: str, data_type: str) -> Column:
        values = [F.lit(getattr(g.members[0], what)).cast(data_type) for g in groups]
        return F.array(*values)[F.col("group_id")]

    return grouped.select(
        *ENTITY_KEYS,
        label("name", "string").alias("feature_name"),
        label("version", "int").alias("definition_version"),
        F.timestamp_millis("start_ms").alias("window_start"),
        F.col("n0").alias("n"),
        F.col("num0").alias("num"),
        F.col("den0").alias("den"),
        F.col("at0").alias("updated_at"),
        "sketch",
    )


def merge_sketches(*parts: DataFrame) -> DataFrame:
    """Sketched state over any event sets -> state over their union; values in several count once.

    ``n`` counts events and adds up, so only disjoint event sets give the ``n`` of their union.
    """
    merged = parts[0]
    for part in parts[1:]:
        merged = merged.unionByName(part)
    return merged.groupBy(*FEATURE_KEYS).agg(
        F.sum("n").alias("n"),
        F.sum("num").alias("num"),
        F.sum("den").alias("den"),
        F.max("updated_at").alias("updated_at"),
        F.hll_union_agg("sketch").alias("sketch"),
    )


def finish_sketches(state: DataFrame, definitions: Sequence[FeatureDefinition]) -> DataFrame:
    """Sketched state -> feature rows whose value is the estimated distinct count."""
    estimated = state.withColumn("distinct_n", F.hll_sketch_estimate("sketch"))
    return _feature_rows(estimated, active_only(definitions))
