"""The match rules, each a DataFrame of candidates: (source_id, target_id, confidence, action, conflict, conflict_property).

A rule sees the whole entity table at once: what a per-entity look-up would find for every source is one join. Directions
are kept: a symmetric rule gives both (a, b) and (b, a).
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import partial, reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import names as N
from ..functions.similarity import jaro_winkler, jaro_winkler_from
from . import fulltext, vectors
from .graph import cluster_collapse, node_similarity, settled

CANDIDATE = ["source_id", "target_id", "confidence", "action", "conflict", "conflict_property"]


@dataclass(frozen=True)
class Tables:
    """What the rules of a label read. same_as: (src, dst, reviewed, conflict, kept); neighbours: (node, neighbour)."""

    entities: DataFrame
    same_as: DataFrame | None = None
    neighbours: DataFrame | None = None
    #: Rules of the pass that tell from a pair's own columns whether they merge it, by priority.
    known: tuple[Rule, ...] = ()
    #: If pairs in conflict are folded in place: the rules of the pass with `flags`, by priority.
    flagging: tuple[Rule, ...] = ()
    #: Only pairs with a target in targets (target_id) and a source not in gone (source_id) are wanted; None: all.
    targets: DataFrame | None = None
    gone: DataFrame | None = None


@dataclass(frozen=True)
class Rule:
    """priority: place in the order of execution, by falling confidence and then by registration."""

    priority: int
    name: str
    label: str
    confidence: float
    action: str
    threshold: float | None
    forced: bool
    find: Callable[[Tables, Settings], DataFrame | None] | None
    #: For a forced merge: whether it merges the pair (a_*, b_*), from columns alone.
    holds: Callable[[], Column] | None = None
    #: For a forced merge: (target_id, by, n), the least source it merges into each target, by classes of rows instead of pairs;
    #: n: the sources of the class, as many pairs as the rule makes of it.
    least: Callable[[Tables, Settings], DataFrame] | None = None
    #: Whether it flags the pair (a_*, b_*), if that is in conflict on a hard identifier, from columns alone; it merges no such pair.
    flags: Callable[[], Column] | None = None
    #: It neither flags nor merges a pair in conflict on a hard identifier.
    spares: bool = False


def prepare(entities: DataFrame) -> DataFrame:
    """entities with what the rules join on, computed once: name_clean, and canonical identifiers where there are any."""
    out = entities.withColumn("name_clean", N.clean(F.col("name")))
    for c, f in (("lei", N.canon_lei), ("cik", N.canon_cik), ("vat", N.canon_vat)):
        if c in entities.columns:
            out = out.withColumn(f"{c}_canon", f(F.col(c)))
    return out


def _present(c: str) -> Column:
    return F.col(c).isNotNull() & (F.col(c) != "")


def _sides(df: DataFrame, keys: list[str], left: list[str], right: list[str]) -> tuple[DataFrame, DataFrame]:
    name = lambda side, cols: [F.col(c).alias(f"{side}_{c}") for c in dict.fromkeys(cols) if c not in keys]
    return df.select(*keys, *name("a", left)), df.select(*keys, *name("b", right))


def hard_id_conflict(a: str = "a", b: str = "b") -> Column:
    """The first of lei, cik, vat of which both sides have a canonical value and the values differ; else null."""
    differs = lambda c: F.col(f"{a}_{c}_canon") != F.col(f"{b}_{c}_canon")
    return F.coalesce(*[F.when(differs(c), F.lit(c)) for c in ("lei", "cik", "vat")])


IDS = ["id", "lei_canon", "cik_canon", "vat_canon"]
#: What the rules with `holds` look at.
SEEN = ["lei", "cik", "vat", "lei_canon", "cik_canon", "vat_canon", "name_clean", "country", "active"]


def _equal(*columns: str) -> Column:
    out = F.lit(True)
    for c in columns:
        out = out & (F.col(f"a_{c}") == F.col(f"b_{c}")) & (F.col(f"a_{c}") != "")
    return F.coalesce(out, F.lit(False))


def same_id(column: str) -> Callable[[], Column]:
    return lambda: _equal(column) & hard_id_conflict().isNull()


def succeeds() -> Column:
    issuer = F.substring("a_lei", 1, 4)
    same = F.coalesce((issuer != "") & (issuer == F.substring("b_lei", 1, 4)), F.lit(False))
    return _equal("name_clean", "country") & same & F.coalesce(F.col("a_active"), F.lit(False)) & ~F.coalesce("b_active", F.lit(True))


def merged_before(t: Tables, name: str) -> list[Column]:
    """`before`: the priority of the first of the known rules that comes before the rule and merges the pair (a_*, b_*); null if none does.

    Only what can matter is computed: the pairs of a hot key are many. No column where no rule is known.
    """
    own = next(r.priority for r in RULES if r.name == name)
    first = [F.when(r.holds(), F.lit(r.priority)) for r in sorted(t.known, key=lambda r: r.priority) if r.priority < own]
    return [F.coalesce(*first, F.lit(None).cast("int")).alias("before")] if t.known else []


def flagged(t: Tables, name: str, conflict: Column) -> list[Column]:
    """`flagged`, of a pair in conflict: a bit for each rule of t.flagging that flags the pair (a_*, b_*) after no merge, or 0 if one
    before the rule does; null for other pairs. No column where nothing is folded in place."""
    if not t.flagging:
        return []
    bits = []
    for i, r in enumerate(t.flagging):
        merged = [m.holds() for m in t.known if m.priority < r.priority and not m.flags]
        bits.append(F.when(reduce(lambda x, m: x & ~m, merged, r.flags()), 1 << i).otherwise(0))
    own = next(i for i, r in enumerate(t.flagging) if r.name == name)
    first = reduce(lambda x, b: x & (b == 0), bits[:own], F.lit(True))
    return [F.when(conflict, F.when(first, reduce(lambda x, b: x + b, bits)).otherwise(0)).alias("flagged")]


def _seen(t: Tables) -> list[str]:
    return [c for c in SEEN if c in t.entities.columns] if t.known or t.flagging else []


#: Rows of one key that a task meets with all others of the key.
DEALT = 500


def _dealt(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """a.join(b, keys), in which the rows of a of a key of more than DEALT are dealt out and meet a copy of the key's b each:
    the pairs of a hot key are many however few bytes its rows have, and would be one task's. The number of partitions is
    fixed, as Spark would join them up by bytes, in a union by the rule's share of them."""
    n = int(a.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    hot = a.groupBy(*keys).agg(F.count("*").alias("rows")).filter(F.col("rows") > DEALT).withColumn("deals", F.ceil(F.col("rows") / DEALT).cast("int")).drop("rows")
    deals = F.coalesce("deals", F.lit(1))
    left = a.join(hot, keys, "left").withColumn("deal", F.pmod(F.xxhash64("a_id"), deals).cast("int")).drop("deals")
    right = b.join(hot, keys, "left").withColumn("deal", F.explode(F.sequence(F.lit(0), deals - 1))).drop("deals")
    at = [*keys, "deal"]
    return left.repartition(n, *at).join(right.repartition(n, *at), at).drop("deal")


def _pairs(name: str, t: Tables, df: DataFrame, keys: list[str], action: str, confidence: float, conflicts: bool, extra: Column | None = None, left=(), right=(), left_if: Column | None = None, right_if: Column | None = None) -> DataFrame:
    """Self-join on keys; with conflicts, pairs that disagree on a hard identifier become conflict flags."""
    ids = [*(IDS if conflicts else ["id"]), *_seen(t)]
    full = df
    for k in keys:
        full = full.filter(_present(k))
    a, b = _sides(full if left_if is None else full.filter(left_if), keys, [*ids, *left], [])[0], _sides(full if right_if is None else full.filter(right_if), keys, [], [*ids, *right])[1]
    if t.targets is not None:
        b = b.join(t.targets, F.col("b_id") == F.col("target_id"), "left_semi")
    if t.gone is not None:
        a = a.join(t.gone, F.col("a_id") == F.col("source_id"), "left_anti")
    met = _dealt(a, b, keys).filter(F.col("a_id") != F.col("b_id"))
    for k in keys:  # a key is a column of both sides
        met = met.withColumn(f"a_{k}", F.col(k)).withColumn(f"b_{k}", F.col(k))
    if extra is not None:
        met = met.filter(extra)
    met = met.withColumn("prop", hard_id_conflict() if conflicts else F.lit(None).cast("string"))
    prop = F.col("prop")
    return met.select(F.col("a_id").alias("source_id"), F.col("b_id").alias("target_id"), F.lit(confidence).alias("confidence"), F.when(prop.isNotNull(), "flag").otherwise(action).alias("action"), prop.isNotNull().alias("conflict"), prop.alias("conflict_property"), *merged_before(t, name), *(flagged(t, name, prop.isNotNull()) if name in {r.name for r in t.flagging} else []))


def exact_id(column: str):
    """Equal raw value; pairs in conflict on a canonical identifier are flagged instead."""
    return lambda t, s: _pairs(f"exact_{column}_match", t, t.entities, [column], "merge", 1.0, True)


def _least(t: Tables, sources: DataFrame, targets: DataFrame, at: list[str]) -> DataFrame:
    """(target_id, by, n): the least source of each target's class but itself, and the sources of the class. Two of them and their number are all that is looked at."""
    if t.targets is not None:
        targets = targets.join(t.targets, F.col("id") == F.col("target_id"), "left_semi")
    if t.gone is not None:
        sources = sources.join(t.gone, F.col("id") == F.col("source_id"), "left_anti")
    sources = sources.filter("id is not null")
    ranked = sources.withColumn("place", F.dense_rank().over(Window.partitionBy(*at).orderBy("id"))).withColumn("n", F.count("*").over(Window.partitionBy(*at))).filter("place <= 2")
    two = ranked.groupBy(*at).agg(F.min("id").alias("one"), F.max("id").alias("other"), F.first("n").alias("n"))
    by = F.when(F.col("one") != F.col("id"), F.col("one")).when(F.col("other") != F.col("id"), F.col("other"))
    return targets.join(two, at).select(F.col("id").alias("target_id"), by.alias("by"), "n").filter("by is not null")


def least_same_id(column: str) -> Callable[[Tables, Settings], DataFrame]:
    """Rows of one value merge if they agree on each other identifier that both have. Which ones both have follows from the
    patterns of those that either has, so a target finds its sources by their pattern and the values of the shared ones: at
    most four rows for an entity on either side, however many pairs a value has.
    """
    others = [c for c in ("lei", "cik", "vat") if c != column]

    def find(t: Tables, s: Settings) -> DataFrame:
        has = sum((F.when(F.col(f"{c}_canon").isNotNull(), 1 << i).otherwise(0) for i, c in enumerate(others)), F.lit(0))
        rows = t.entities.filter(_present(column)).select("id", F.col(column).alias("value"), *[f"{c}_canon" for c in others], has.alias("has"))
        masks = F.explode(F.array(*[F.lit(m) for m in range(1 << len(others))]))
        shared = [F.when(F.col("shared").bitwiseAND(1 << i) != 0, F.col(f"{c}_canon")).otherwise("").alias(c) for i, c in enumerate(others)]
        sources = rows.withColumn("shared", masks).filter("shared & has = shared").select("id", "value", F.col("has").alias("pattern"), "shared", *shared)
        targets = rows.withColumn("pattern", masks).withColumn("shared", F.expr("pattern & has")).select("id", "value", "pattern", "shared", *shared)
        return _least(t, sources, targets, ["value", "pattern", "shared", *others])

    return find


def least_successor(t: Tables, s: Settings) -> DataFrame:
    at = ["name_clean", "country", "issuer"]
    rows = t.entities.withColumn("issuer", F.substring("lei", 1, 4)).filter(_present("name_clean") & _present("country") & _present("issuer"))
    return _least(t, rows.filter("active").select("id", *at), rows.filter("not active").select("id", *at), at)


def authority_id(t: Tables, s: Settings) -> DataFrame:
    """Equal id of two rows that differ in it: empty by its own condition."""
    return _pairs("exact_authority_id_match", t, t.entities.withColumn("same_id", F.col("id")), ["same_id"], "merge", 1.0, False)


def name_country_company(t: Tables, s: Settings) -> DataFrame:
    return _pairs("exact_name_country_match", t, t.entities, ["name_clean", "country"], "flag", 0.95, True)


def name_country_authority(t: Tables, s: Settings) -> DataFrame:
    return _pairs("exact_name_country_match_authority", t, t.entities, ["name_clean", "country"], "merge", 0.95, False)


def name_any_country(t: Tables, s: Settings) -> DataFrame:
    other = F.coalesce("a_country", F.lit("")) != F.coalesce("b_country", F.lit(""))
    return _pairs("exact_name_any_country_authority", t, t.entities, ["name_clean"], "flag", 0.90, False, other, ["country"], ["country"])


def successor(t: Tables, s: Settings) -> DataFrame:
    """An active company and an inactive one of its name, country and issuer prefix of the LEI."""
    rows = t.entities.withColumn("issuer", F.substring("lei", 1, 4))
    return _pairs("successor_lei_match", t, rows, ["name_clean", "country", "issuer"], "merge", 0.98, False, left_if=F.col("active"), right_if=~F.coalesce("active", F.lit(True)))


def _fuzzy(t: Tables, s: Settings, normal, conflicts: bool) -> DataFrame:
    rows = t.entities.filter(_present("name") & _present("country"))
    docs = rows.select("id", N.query_text(F.col("name")).alias("text"), "country")
    got = fulltext.retrieve(docs, docs, s.fulltext_limit, ["country"], max_df=s.fulltext_max_df)
    own = rows.select("id", normal(F.col("name")).alias("norm"), *dict.fromkeys([*([c for c in IDS if c != "id"] if conflicts else []), *_seen(t)]))
    side = lambda x: own.select(*[F.col(c).alias(f"{x}_{c}") for c in own.columns])
    met = got.join(side("a"), F.col("source_id") == F.col("a_id")).join(side("b"), F.col("target_id") == F.col("b_id")).filter("a_norm <> '' and b_norm <> ''")
    # Settled, so that who reads the candidates twice doesn't compare the names twice.
    near = settled(met.withColumn("jw", jaro_winkler_from(s.fuzzy_name_threshold)("a_norm", "b_norm")).filter(F.col("jw") >= s.fuzzy_name_threshold))
    refused = hard_id_conflict().isNotNull() if conflicts else F.lit(False)
    return near.select("source_id", "target_id", F.when(refused, 0.0).otherwise(F.col("jw")).alias("confidence"), F.when(refused, "noop").otherwise("flag").alias("action"), F.lit(False).alias("conflict"), F.lit(None).cast("string").alias("conflict_property"), *merged_before(t, "fuzzy_name_same_country" if conflicts else "fuzzy_name_same_country_authority"))


def fuzzy_company(t: Tables, s: Settings) -> DataFrame:
    """Best full-text hits of the country whose names without legal forms are close; a hard-id conflict is recorded as noop."""
    return _fuzzy(t, s, N.company_name, True)


def fuzzy_authority(t: Tables, s: Settings) -> DataFrame:
    return _fuzzy(t, s, N.authority_name, False)


def embedding(t: Tables, s: Settings) -> DataFrame | None:
    """Nearest vectors, ranked over all first and filtered after: same encoder, close enough, name likeness, other country, not reviewed."""
    if "vector" not in t.entities.columns:
        return None
    rows = t.entities.filter(F.col("vector").isNotNull() & _present("encoder"))
    got = vectors.nearest(rows, s.embedding_top_k + 1).filter("source_id <> target_id")
    own = rows.select("id", "country", "encoder", F.lower(F.coalesce("name", F.lit(""))).alias("name"))
    side = lambda x: own.select(*[F.col(c).alias(f"{x}_{c}") for c in own.columns])
    score = (1 + F.col("score")) / 2 if s.embedding_score == "normalised" else F.col("score")
    met = got.withColumn("score", score).filter(F.col("score") >= s.embedding_threshold)
    met = met.join(side("a"), F.col("source_id") == F.col("a_id")).join(side("b"), F.col("target_id") == F.col("b_id")).filter("a_encoder = b_encoder")
    if s.embedding_cross_country_only:
        met = met.filter("a_country <> b_country")
    if s.embedding_name_min > 0:
        met = met.filter(jaro_winkler("a_name", "b_name") >= s.embedding_name_min)
    if t.same_as is not None:
        done = t.same_as.filter("reviewed").select(F.col("src").alias("source_id"), F.col("dst").alias("target_id"))
        met = met.join(done, ["source_id", "target_id"], "left_anti")
    return _flags(met, F.col("score"))


def _flags(df: DataFrame, confidence: Column, action: str = "flag") -> DataFrame:
    return df.select("source_id", "target_id", confidence.cast("double").alias("confidence"), F.lit(action).alias("action"), F.lit(False).alias("conflict"), F.lit(None).cast("string").alias("conflict_property"))


def neighbourhood(t: Tables, s: Settings) -> DataFrame | None:
    if t.neighbours is None:
        return None
    return _flags(node_similarity(t.neighbours, s.node_similarity_threshold, s.node_similarity_top_k), F.least(F.lit(0.95), "similarity"))


def collapse(t: Tables, s: Settings) -> DataFrame | None:
    """Every other member of a reviewed cluster merges into the canonical one; only the canonical one is a source."""
    if t.same_as is None:
        return None
    members = cluster_collapse(t.same_as, t.entities, s.exclude_kept).filter("canonical <> id")
    return _flags(members.select(F.col("canonical").alias("source_id"), F.col("id").alias("target_id")), F.lit(1.0), "merge")


RULES = [
    Rule(1, "exact_lei_match", "Company", 1.0, "merge", None, True, exact_id("lei"), same_id("lei"), least_same_id("lei"), flags=partial(_equal, "lei")),
    Rule(2, "exact_cik_match", "Company", 1.0, "merge", None, True, exact_id("cik"), same_id("cik"), least_same_id("cik"), flags=partial(_equal, "cik")),
    Rule(3, "exact_vat_match", "Company", 1.0, "merge", None, True, exact_id("vat"), same_id("vat"), least_same_id("vat"), flags=partial(_equal, "vat")),
    Rule(4, "gds_same_as_cluster_collapse_company", "Company", 1.0, "merge", None, True, collapse),
    Rule(5, "translation_enrichment_authority", "Authority", 1.0, "enrich", None, False, None),
    Rule(6, "exact_authority_id_match", "Authority", 1.0, "merge", None, True, authority_id),
    Rule(7, "gds_same_as_cluster_collapse_authority", "Authority", 1.0, "merge", None, True, collapse),
    Rule(8, "translation_enrichment_contract", "Contract", 1.0, "enrich", None, False, None),
    Rule(9, "successor_lei_match", "Company", 0.98, "merge", None, True, successor, succeeds, least_successor),
    Rule(10, "exact_name_country_match", "Company", 0.95, "flag", None, False, name_country_company, flags=partial(_equal, "name_clean", "country")),
    Rule(11, "fuzzy_name_same_country", "Company", 0.95, "flag", 0.97, False, fuzzy_company, spares=True),
    Rule(12, "exact_name_country_match_authority", "Authority", 0.95, "merge", None, False, name_country_authority),
    Rule(13, "fuzzy_name_same_country_authority", "Authority", 0.95, "flag", None, False, fuzzy_authority),
    Rule(14, "exact_name_any_country_authority", "Authority", 0.90, "flag", 0.90, False, name_any_country),
    Rule(15, "embedding_cosine_authority", "Authority", 0.87, "flag", 0.98, False, embedding),
    Rule(16, "gds_node_similarity_company", "Company", 0.8, "flag", None, False, neighbourhood),
    Rule(17, "gds_node_similarity_authority", "Authority", 0.8, "flag", None, False, neighbourhood),
]


def select(label: str, mode: str = "all", exclude_prefix: str | None = None) -> list[Rule]:
    """Rules of a label in order. mode: all, match_only or enrich_only."""
    if mode not in ("all", "match_only", "enrich_only"):
        raise ValueError(f"unknown mode {mode}")
    return [r for r in RULES if r.label == label and not (exclude_prefix and r.name.startswith(exclude_prefix)) and (mode == "all" or (r.action == "enrich") == (mode == "enrich_only"))]


def describe(spark: SparkSession) -> DataFrame:
    rows = [(r.priority, r.name, r.label, r.confidence, r.action, r.threshold, r.forced) for r in RULES]
    return spark.createDataFrame(rows, "priority int, name string, label string, confidence double, action string, threshold double, forced boolean")


__all__ = ["CANDIDATE", "RULES", "Rule", "Tables", "describe", "hard_id_conflict", "prepare", "select"]
