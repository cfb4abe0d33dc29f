"""Candidates -> decisions -> outcomes: the decision algebra over all sources at once.

Within a pass every rule sees the same snapshot. What processing one entity at a time would do with later mutations is done
by `greedy_merges`: merges are taken in order of (source, priority, target), and an entity merged away acts no more.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..config import Settings
from . import apply
from .rules import Rule, Tables, select

OUTCOMES = ("auto_merge", "auto_link", "conflict", "flag", "enrich", "noop")


def candidates(tables: Tables, label: str, settings: Settings, mode: str = "all", exclude_prefix: str | None = None, rules: list[Rule] | None = None) -> DataFrame:
    """The union of the rules' candidates with the rule's name, priority, threshold and force; repeats of a pair in a rule count once."""
    parts = []
    active = rules if rules is not None else select(label, mode, exclude_prefix)
    tables = replace(tables, known=tables.known or tuple(r for r in active if r.holds))
    told = ["before", "flagged"] if tables.flagging else ["before"]
    for r in active:
        found = r.find(tables, settings) if r.find else None
        if found is not None:
            found = found.withColumns({c: F.lit(None).cast("int") for c in told if c not in found.columns})
            parts.append(found.select("source_id", "target_id", "confidence", "action", "conflict", "conflict_property", F.lit(r.name).alias("rule"), F.lit(r.priority).alias("priority"), F.lit(r.threshold).cast("double").alias("threshold"), F.lit(r.forced).alias("forced"), *told))
    if not parts:
        return tables.entities.limit(0).select(*[F.lit(None).cast(k).alias(c) for c, k in (("source_id", "string"), ("target_id", "string"), ("confidence", "double"), ("action", "string"), ("conflict", "boolean"), ("conflict_property", "string"), ("rule", "string"), ("priority", "int"), ("threshold", "double"), ("forced", "boolean"), *((c, "int") for c in told))])
    return reduce(DataFrame.unionByName, parts)


def outcome(action: Column, conflict: Column, forced: Column, enabled: bool) -> Column:
    gated = (action == "merge") & ~forced & F.lit(not enabled)
    return F.when(gated, "flag").when(action == "merge", "auto_merge").when(action == "link", "auto_link").when(action == "flag", F.when(conflict, "conflict").otherwise("flag")).when(action == "enrich", "enrich").otherwise("noop")


def _promote(found: DataFrame, settings: Settings) -> DataFrame:
    """found with `decided`, `applied_force` and `outcome`."""
    promoted = (F.col("action") == "flag") & F.col("threshold").isNotNull() & (F.col("confidence") >= F.col("threshold")) & ~F.col("conflict")
    rows = found.withColumn("decided", F.when(promoted, "merge").otherwise(F.col("action")))
    rows = rows.withColumn("applied_force", F.col("forced") & (F.col("decided") == "merge") & ~F.col("conflict"))
    return rows.withColumn("outcome", outcome(F.col("decided"), F.col("conflict"), F.col("applied_force"), settings.auto_merge_enabled))


def judge(found: DataFrame, settings: Settings, rules: list[Rule] | None = None) -> DataFrame:
    """All candidates with `decided` (the action after promotion), `applied_force`, `outcome` and `skipped`: after a merge or link of a target, later rules skip it for that source.

    ``before`` of a candidate names the first rule that merges the pair as its own columns tell. If ``rules`` are those of
    the pass, candidates of rules that come before every other merging one are judged by that alone and are not shuffled.
    """
    rows = _promote(found, settings)
    earlier = F.col("before") if "before" in found.columns else F.lit(None).cast("int")
    others = [r.priority for r in rules if not r.holds and (r.action in ("merge", "link") or r.threshold is not None)] if rules is not None else [0]
    from_here = min(others, default=1 << 30)
    merged = F.when(F.col("outcome").isin("auto_merge", "auto_link"), F.col("priority"))
    done = F.least(earlier, F.min(merged).over(Window.partitionBy("source_id", "target_id")))
    alone = rows.filter(F.col("priority") < from_here).withColumn("done", earlier)
    judged = alone.unionByName(rows.filter(F.col("priority") >= from_here).withColumn("done", done))
    open_ = F.col("done").isNull() | (F.col("priority") <= F.col("done")) | (F.col("source_id") == F.col("target_id"))
    return judged.withColumn("skipped", ~open_).drop("done", "before")


def decide(found: DataFrame, settings: Settings, rules: list[Rule] | None = None) -> DataFrame:
    """The decisions: what judge doesn't skip."""
    return judge(found, settings, rules).filter(~F.col("skipped")).drop("skipped")


def consolidate(tables: Tables, label: str, settings: Settings, mode: str = "all", exclude_prefix: str | None = None, ids: DataFrame | None = None) -> DataFrame:
    """Decisions of the sources in ids (id), or of all."""
    found = candidates(tables, label, settings, mode, exclude_prefix)
    if ids is not None:
        found = found.join(ids.select(F.col("id").alias("source_id")).distinct(), "source_id", "left_semi")
    return decide(found, settings, select(label, mode, exclude_prefix))


def fold_pass(tables: Tables, label: str, settings: Settings, as_of: Column, places: int, mode: str = "all", exclude_prefix: str | None = None, rules: list[Rule] | None = None) -> DataFrame:
    """apply.fold_detections of what a pass flags, as of one time, rules in order of priority, confidences rounded to ``places``.

    The pairs in conflict are as many as the square of a placeholder's rows. Where each rule of the pass tells from a pair's
    columns whether it flags or merges such a pair, or leaves these alone, the first rule that flags it makes its whole row, and only the
    other pairs are shuffled. That needs one row for each id; with repeated ids all detections are shuffled.
    """
    active = rules if rules is not None else select(label, mode, exclude_prefix)
    flagging = tuple(sorted((r for r in active if r.flags), key=lambda r: r.priority))

    def folded(found: DataFrame) -> DataFrame:
        rows = decide(found, settings, active).filter("outcome in ('flag', 'conflict')")
        return apply.fold_detections(rows.select("source_id", "target_id", "rule", F.round("confidence", places).alias("confidence"), as_of.alias("detected_at"), F.lit(False).alias("reviewed"), "conflict", F.col("priority").alias("seq")))

    ids = tables.entities.filter("id is not null").groupBy("id").agg(F.count("*").alias("rows"))
    if not flagging or not all(r.flags or r.holds or r.spares for r in active) or not ids.filter("rows > 1").isEmpty():
        return folded(candidates(tables, label, settings, rules=active))
    tables = replace(tables, known=tuple(r for r in active if r.holds), flagging=flagging)
    here = candidates(tables, label, settings, rules=list(flagging)).filter("flagged > 0")
    # A rule that merges what isn't in conflict flags nothing else.
    rest = folded(candidates(tables, label, settings, rules=[r for r in active if not (r.flags and r.holds)]).filter("flagged is null").drop("flagged"))
    sets = [[r for i, r in enumerate(flagging) if bits >> i & 1] for bits in range(1 << len(flagging))]
    of = lambda kind, value: F.get(F.array(*[F.lit(None).cast(kind) if not some else value(some) for some in sets]), F.col("flagged"))
    best = lambda some: max(some, key=lambda r: round(r.confidence, places))  # noqa: E731  the first of the greatest
    whole = here.select(
        "source_id", "target_id", F.lit(False).alias("reviewed"), F.lit(True).alias("conflict"),
        of("array<string>", lambda some: F.array(*[F.lit(r.name) for r in some])).alias("rules"), of("array<double>", lambda some: F.array(*[F.lit(round(r.confidence, places)) for r in some])).alias("confidences"),
        F.array_repeat(as_of, of("int", lambda some: F.lit(len(some)))).alias("dates"), of("double", lambda some: F.lit(round(best(some).confidence, places))).alias("confidence"), of("string", lambda some: F.lit(best(some).name)).alias("method"), as_of.alias("detected_at"),
    )
    return whole.unionByName(rest)


def run_outcome(has: dict[str, Column]) -> Column:
    return F.when(has["auto_merge"], "merged").when(has["auto_link"], "linked").when(has["conflict"], "conflict_flagged").when(has["flag"], "flagged").when(has["enrich"], "enriched").when(has["noop"], "noop").otherwise("no_match")


def run_summary(ids: DataFrame, entities: DataFrame, judged: DataFrame) -> DataFrame:
    """One row for each id asked for: decisions_count, rules_fired, outcome; ids without entity are not_found, those without decision no_match.

    rules_fired counts rules with any candidate, skipped ones too. judged is read once.
    """
    open_ = ~F.col("skipped")
    flags = [F.coalesce(F.bool_or(open_ & (F.col("outcome") == o)), F.lit(False)).alias(f"any_{o}") for o in OUTCOMES]
    done = judged.groupBy(F.col("source_id").alias("id")).agg(F.count_if(open_).alias("decisions_count"), F.bit_count(F.bit_or(F.expr("shiftleft(1L, priority)"))).cast("long").alias("rules_fired"), *flags)
    there = entities.select("id", F.lit(True).alias("there"))
    rows = ids.select("id").distinct().join(there, "id", "left").join(done, "id", "left")
    result = run_outcome({o: F.coalesce(F.col(f"any_{o}"), F.lit(False)) for o in OUTCOMES})
    return rows.select("id", F.coalesce("decisions_count", F.lit(0)).alias("decisions_count"), F.coalesce("rules_fired", F.lit(0)).alias("rules_fired"), F.when(F.col("there"), result).otherwise("not_found").alias("outcome"))


def sweep_outcome(decisions: DataFrame) -> DataFrame:
    """(id, outcome) in the sweeper's coarser words: no enrich."""
    has = lambda o: F.bool_or(F.col("outcome") == o)
    return decisions.groupBy(F.col("source_id").alias("id")).agg(F.when(has("auto_merge"), "merged").when(has("auto_link"), "linked").when(has("conflict"), "conflict").when(has("flag"), "flagged").otherwise("noop").alias("outcome"))


def batch_summary(summary: DataFrame, decisions: DataFrame) -> DataFrame:
    """One row: processed, merged, linked, flagged, conflicts."""
    n = lambda o: F.count_if(F.col("outcome") == o)
    counts = decisions.agg(n("auto_merge").alias("merged"), n("auto_link").alias("linked"), n("flag").alias("flagged"), n("conflict").alias("conflicts"))
    return summary.agg(F.count("*").alias("processed")).crossJoin(counts)  # two single rows


def rule_fires(decisions: DataFrame) -> DataFrame:
    return decisions.groupBy("rule", "outcome").agg(F.count("*").alias("fires"))


#: Merges of one component that a task decides in order; larger components are first cut by rounds over the whole table.
TOGETHER = 200_000
#: Targets left open are broadcast up to this size, counted beforehand, with the overhead of each row; larger sets are shuffled.
SENT_BYTES, _ROW_BYTES = 32 << 20, 64
#: Pairs of the targets left open that are made at once; for more, the least sources are asked again instead.
MADE = 5_000_000


def _in_order(table: pa.Table) -> pa.Table:
    """The merges of whole components, taken in order of the source."""
    gone: set[str] = set()
    out = []
    for source, target in sorted(zip(table.column("source_id").to_pylist(), table.column("target_id").to_pylist(), strict=True)):
        if source not in gone and target not in gone:
            out.append((source, target))
            gone.add(target)
    return pa.table({"canonical": pa.array([x for x, _ in out], pa.string()), "merged": pa.array([x for _, x in out], pa.string())})


def greedy_merges(decisions: DataFrame, together: int = TOGETHER) -> DataFrame:
    """(canonical, merged): the merges that processing sources in order of id would make in one pass.

    A source acts only if nothing merged it away before, and merges each target that is still there. Components of linked
    entities don't touch each other, so one of up to ``together`` merges is decided by one task, in order. Larger ones go
    through rounds in which a pair acts if no earlier open source can still merge either end and its target, if an earlier
    source, has acted itself; the least source always can. They fall apart on the way. Nulls and pairs with oneself don't count.
    """
    merges = _merging(decisions)

    def pairs(targets: DataFrame, gone: DataFrame) -> DataFrame:
        return merges.join(targets, "target_id", "left_semi").join(gone, "source_id", "left_anti")

    return _greedy(lambda targets, gone: merges.select("target_id", F.col("source_id").alias("by"), F.lit(1).alias("n")), pairs, together, again=False)


def greedy_pass(tables: Tables, label: str, settings: Settings, mode: str = "all", exclude_prefix: str | None = None, rules: list[Rule] | None = None, together: int = TOGETHER) -> DataFrame:
    """(canonical, merged): greedy_merges of the decisions of a pass.

    Which pairs merge doesn't depend on what is skipped, since a skipped pair has merged already. Rules with `least` name the
    first source of each target by classes of rows; their pairs are only made for targets that this leaves open.
    """
    from .graph import settled

    active = rules if rules is not None else select(label, mode, exclude_prefix)
    short = [r for r in active if r.least]
    others = settled(_merging(_promote(candidates(tables, label, settings, rules=[r for r in active if not r.least]), settings)))
    def narrow(targets: DataFrame | None, gone: DataFrame | None) -> tuple[Tables, DataFrame]:
        kept = others
        if targets is not None:
            kept = kept.join(targets, "target_id", "left_semi").join(gone, "source_id", "left_anti")
        return replace(tables, targets=targets, gone=gone), kept.select("source_id", "target_id")

    def first(targets: DataFrame | None, gone: DataFrame | None) -> DataFrame:
        some, kept = narrow(targets, gone)
        return reduce(DataFrame.unionByName, [r.least(some, settings) for r in short], kept.select("target_id", F.col("source_id").alias("by"), F.lit(1).alias("n")))

    def pairs(targets: DataFrame, gone: DataFrame) -> DataFrame:
        some, kept = narrow(targets, gone)
        return _merging(_promote(candidates(some, label, settings, rules=short), settings)).unionByName(kept)

    return _greedy(first, pairs, together, again=True)


def _merging(decisions: DataFrame) -> DataFrame:
    return decisions.filter("outcome = 'auto_merge' and source_id <> target_id").select("source_id", "target_id")


def _greedy(first: Callable, pairs: Callable, together: int, again: bool) -> DataFrame:
    """first(targets, gone): (target_id, by, n), a source of each target at least, the least one among them, and how many pairs stand
    behind it, of the targets named without the sources gone (None: of all); pairs(targets, gone): the merges of such. again: first
    is asked as long as it halves what is open or the pairs are more than MADE; each time the least open source has its targets."""
    from .graph import connected_components, settled

    # An entity that no earlier one can merge acts. What it is the first to take is gone, and acts no more if it comes later:
    # in a large group that alone leaves little, and the group's pairs are never written.
    near = gone = done = before = None
    while True:
        least = settled(first(near, gone).groupBy(F.col("target_id").alias("t")).agg(F.min("by").alias("by"), F.sum("n").alias("n")))
        late = least.filter("by < t").select(F.col("t").alias("by"))
        taken = settled(least.join(late, "by", "left_anti"))
        now = taken.select(F.col("by").alias("canonical"), F.col("t").alias("merged"))
        done = now if done is None else done.unionByName(now)
        left = settled(least.join(late, "by", "left_semi").select(F.col("t").alias("target_id"), "n"))
        n, size, made = left.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("target_id")), F.lit(0)), F.coalesce(F.sum("n"), F.lit(0))).first()
        left = left.drop("n")
        if not n:
            return done
        dead = taken.filter("by < t").select(F.col("t").alias("source_id"))
        gone = dead if gone is None else gone.unionByName(dead)
        near = F.broadcast(left) if size + _ROW_BYTES * n <= SENT_BYTES else left
        if not again or (made <= MADE and before is not None and 2 * n > before):
            break
        before = n
    open_ = settled(pairs(near, gone).distinct())
    while not open_.isEmpty():
        of = connected_components(open_, "source_id", "target_id").toDF("source_id", "component")
        rows = settled(open_.join(of, "source_id"))
        sizes = rows.groupBy("component").agg((F.count("*") <= together).alias("small"))
        tasks = 1 + 4 * rows.count() // together
        rows = rows.join(sizes, "component").withColumn("task", F.pmod(F.xxhash64("component"), F.lit(tasks)))
        small = rows.filter("small").groupBy("task").applyInArrow(_in_order, "canonical string, merged string")
        done = settled(done.unionByName(small))
        open_ = settled(rows.filter("not small").select("source_id", "target_id"))
        for _ in range(8):  # a round takes a pair out at least
            if open_.isEmpty():
                break
            acting, open_ = _round(open_)
            done = settled(done.unionByName(acting.toDF("canonical", "merged")))
    return done


def _round(open_: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The pairs that act now, and the open ones left."""
    from .graph import settled

    first = open_.groupBy(F.col("target_id").alias("t")).agg(F.min("source_id").alias("by"))
    threatened = first.filter("by < t").select(F.col("t").alias("id"))
    sources = open_.select(F.col("source_id").alias("id")).distinct()
    acting = open_.join(threatened, F.col("source_id") == F.col("id"), "left_anti").join(first, (F.col("target_id") == F.col("t")) & (F.col("source_id") == F.col("by")), "left_semi")
    acting = settled(acting.join(sources, (F.col("target_id") == F.col("id")) & (F.col("target_id") < F.col("source_id")), "left_anti"))
    gone = acting.select(F.col("target_id").alias("id"))
    return acting, settled(open_.join(gone, F.col("source_id") == F.col("id"), "left_anti").join(gone, F.col("target_id") == F.col("id"), "left_anti"))
