"""Match-quality reports and the generator of name perturbations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import names as N

#: Short and long legal forms (fixed values); the first that a name holds is exchanged.
FORM_PAIRS = (
    ("Zrt.", "Zártkörűen Működő Részvénytársaság"), ("Kft.", "Korlátolt Felelősségű Társaság"), ("Nyrt.", "Nyilvánosan Működő Részvénytársaság"), ("S.r.l.", "Società a responsabilità limitata"),
    ("S.p.A.", "Società per Azioni"), ("GmbH", "Gesellschaft mit beschränkter Haftung"), ("AG", "Aktiengesellschaft"), ("SARL", "Société à responsabilité limitée"), ("S.A.", "Société Anonyme"),
    ("S.L.", "Sociedad Limitada"), ("Sp. z o.o.", "Spółka z ograniczoną odpowiedzialnością"), ("s.r.o.", "společnost s ručením omezeným"), ("a.s.", "akciová společnost"), ("B.V.", "Besloten Vennootschap"), ("Ltd", "Limited"),
)
#: Letters and what people type without accents (fixed values).
UNACCENTED = ("áàâäéèêíïóöőúüűçñžščřąęłńśźż", "aaaaeeeiiooouuucnzscraelnszz")


def homonyms(companies: DataFrame) -> DataFrame:
    """(name_clean, country, distinct_leis) of companies with an LEI."""
    rows = companies.filter("lei is not null and name_clean is not null and country is not null")
    return rows.groupBy("name_clean", "country").agg(F.count_distinct("lei").alias("distinct_leis"))


def group_precision(companies: DataFrame) -> DataFrame:
    several = F.col("distinct_leis") > 1
    counts = homonyms(companies).agg(F.count("*").alias("groups"), F.count_if(several).alias("homonym_groups"), F.coalesce(F.sum(F.when(several, F.col("distinct_leis"))), F.lit(0)).alias("entities_at_risk"))
    return counts.withColumn("group_precision", F.when(F.col("groups") > 0, F.round((F.col("groups") - F.col("homonym_groups")) / F.col("groups"), 4)).otherwise(1.0))


def worst_homonyms(companies: DataFrame, top: int = 8) -> DataFrame:
    return homonyms(companies).filter("distinct_leis > 1").orderBy(F.desc("distinct_leis"), "name_clean", "country").limit(top)


def recall_gap(companies: DataFrame) -> DataFrame:
    """How many VAT numbers have several cleaned names."""
    names = companies.filter("vat is not null and name_clean is not null").groupBy("vat").agg(F.count_distinct("name_clean").alias("names"))
    return names.agg(F.count_if(F.col("names") > 1).alias("same_entity_name_drift_pairs"))


def fidelity(entities: DataFrame) -> DataFrame:
    """How many stored name_clean equal the recomputed."""
    rows = entities.filter("name is not null and name_clean is not null")
    counts = rows.agg(F.count("*").alias("checked"), F.count_if(N.clean(F.col("name")) == F.col("name_clean")).alias("match"))
    return counts.withColumn("pct", F.when(F.col("checked") > 0, F.round(100 * F.col("match") / F.col("checked"), 2)))


def perturbations(names: DataFrame) -> DataFrame:
    """(id, name, perturbed, kind, clean_invariant): variants of each name as people write them."""
    n = F.col("name")
    plain = F.translate(n, UNACCENTED[0] + UNACCENTED[0].upper(), UNACCENTED[1] * 2)
    row = lambda value, kind, same: F.struct(value.alias("perturbed"), F.lit(kind).alias("kind"), F.lit(same).alias("clean_invariant"))
    form, kind = F.lit(None).cast("string"), F.lit(None).cast("string")
    for short, long in reversed(FORM_PAIRS):
        has, was = F.contains(n, F.lit(short)), F.contains(n, F.lit(long))
        form = F.when(has, F.replace(n, F.lit(short), F.lit(long))).when(was, F.replace(n, F.lit(long), F.lit(short))).otherwise(form)
        kind = F.when(has, "expand_legal_form").when(was, "abbrev_legal_form").otherwise(kind)
    every = F.array(
        row(F.upper(n), "uppercase", True), row(F.lower(n), "lowercase", True), row(plain, "strip_accents", False), row(F.replace(n, F.lit(" "), F.lit("  ")), "double_space", True),
        row(F.replace(F.replace(n, F.lit("."), F.lit("")), F.lit(","), F.lit("")), "drop_punct", True), row(F.concat(F.lit("  "), n, F.lit(" ")), "edge_space", True),
        F.struct(form.alias("perturbed"), kind.alias("kind"), F.lit(False).alias("clean_invariant")), row(F.when(F.contains(n, F.lit(" & ")), F.replace(n, F.lit(" & "), F.lit(" and "))), "ampersand_to_and", False),
    )
    return names.filter(n.isNotNull()).select("id", "name", F.inline(F.filter(every, lambda x: x["perturbed"].isNotNull() & x["kind"].isNotNull())))


def perturbation_recall(names: DataFrame) -> DataFrame:
    """(kind, total, matched): how many variants clean to the name's own form."""
    return perturbations(names).groupBy("kind").agg(F.count("*").alias("total"), F.count_if(N.clean(F.col("perturbed")) == N.clean(F.col("name"))).alias("matched"))


def confusion(pairs: DataFrame) -> DataFrame:
    """One row of counts and metrics of pairs (same, linked); a rate without cases is 1, f1 without hits 0."""
    n = lambda c: F.count_if(c)
    s, k = F.col("same"), F.col("linked")
    rows = pairs.agg(n(s & k).alias("tp"), n(~s & k).alias("fp"), n(s & ~k).alias("fn"), n(~s & ~k).alias("tn"))
    rate = lambda a, b: F.when(a + b > 0, a / (a + b)).otherwise(1.0)
    p, r = rate(F.col("tp"), F.col("fp")), rate(F.col("tp"), F.col("fn"))
    return rows.select("tp", "fp", "fn", "tn", F.round(p, 4).alias("precision"), F.round(r, 4).alias("recall"), F.round(F.when(p + r > 0, 2 * p * r / (p + r)).otherwise(0.0), 4).alias("f1"))
