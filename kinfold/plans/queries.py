"""The engine's queries over the driver's tables, each with the SQL that DuckDB runs as its oracle."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Settings
from ..functions import names as N
from ..operators import apply, engine, evaluate, fulltext, graph, resolve, review, rules, vectors
from ..sources import derived as D
from ..streaming import dispatch, sweep

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}

CLEAN = D.CLEAN_SQL
#: Settings under which the derived tables have hits.
S = Settings(node_similarity_threshold=0.7, embedding_threshold=0.3, embedding_name_min=0.45)


def query(name: str, sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name] = f
        if sql is not None:
            ORACLES[name] = sql
        return f

    return add


def _companies(spark, d):
    return rules.prepare(D.companies(spark, d))


def _authorities(spark, d):
    return rules.prepare(D.authorities(spark, d))


LEI = "CASE WHEN regexp_full_match(upper(trim(lei)), '[A-Z0-9]{20}') THEN upper(trim(lei)) END"
CIK = "CASE WHEN cik IS NOT NULL THEN coalesce(nullif(regexp_replace(trim(cik), '^0+', ''), ''), '0') END"
VAT = "CASE WHEN regexp_full_match(upper(regexp_replace(vat, '[\\s.\\-/]', '', 'g')), 'DE\\d{9}') THEN upper(regexp_replace(vat, '[\\s.\\-/]', '', 'g')) END"
C = f"""{D.COMPANIES}, prepared AS (
  SELECT *, {CLEAN.format("name")} AS name_clean, {LEI} AS lei_canon, {CIK} AS cik_canon, {VAT} AS vat_canon FROM company
)"""
A = f"""{D.AUTHORITIES}, prepared AS (SELECT *, {CLEAN.format("name")} AS name_clean FROM authority)"""
CONFLICT = "CASE WHEN a.lei_canon <> b.lei_canon THEN 'lei' WHEN a.cik_canon <> b.cik_canon THEN 'cik' WHEN a.vat_canon <> b.vat_canon THEN 'vat' END"


def _sql_pairs(on: str, action: str, confidence: float, conflicts: bool, where: str = "TRUE") -> str:
    prop = CONFLICT if conflicts else "NULL::VARCHAR"
    return f"""SELECT a.id AS source_id, b.id AS target_id, {confidence}::DOUBLE AS confidence, CASE WHEN {prop} IS NOT NULL THEN 'flag' ELSE '{action}' END AS action,
      ({prop}) IS NOT NULL AS conflict, {prop} AS conflict_property FROM prepared a JOIN prepared b ON {on} AND a.id <> b.id WHERE {where}"""


# --- Scalars ---


@query("clean_name", f"SELECT doc_id, {CLEAN.format('text')} AS cleaned, regexp_replace(trim(regexp_replace(regexp_replace(upper(replace(text, 'ß', 'ss')), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g')), '^$', '') AS normalised FROM documents")
def clean_name(spark, d):
    return D.table(spark, d, "documents").select("doc_id", N.clean(F.col("text")).alias("cleaned"), N.authority_name(F.col("text")).alias("normalised"))


@query("canon_ids", f"WITH {C} SELECT id, lei_canon, cik_canon, vat_canon, CASE WHEN regexp_full_match(regexp_replace(cik || '0000', '[\\s.\\-/]', '', 'g'), '\\d{{14}}') THEN cik || '0000' END AS siret, left(lei, 4) AS issuer FROM prepared")
def canon_ids(spark, d):
    return _companies(spark, d).select("id", "lei_canon", "cik_canon", "vat_canon", N.canon_siret(F.concat("cik", F.lit("0000"))).alias("siret"), F.substring("lei", 1, 4).alias("issuer"))


@query("normalize_country", """SELECT n_nationkey, CASE upper(n_name) WHEN 'FRANCE' THEN 'FRA' WHEN 'GERMANY' THEN 'DEU' WHEN 'UNITED KINGDOM' THEN 'GBR' WHEN 'UNITED STATES' THEN 'USA' WHEN 'CANADA' THEN 'CAN' WHEN 'JAPAN' THEN 'JPN'
  WHEN 'CHINA' THEN 'CHN' WHEN 'INDIA' THEN 'IND' WHEN 'BRAZIL' THEN 'BRA' WHEN 'RUSSIA' THEN 'RUS' WHEN 'ROMANIA' THEN 'ROU' WHEN 'IRAN' THEN 'IRN' WHEN 'IRAQ' THEN 'IRQ' END AS by_name,
  CASE left(n_name, 2) WHEN 'FR' THEN 'FRA' WHEN 'BR' THEN 'BRA' WHEN 'CA' THEN 'CAN' WHEN 'RO' THEN 'ROU' WHEN 'RU' THEN 'RUS' WHEN 'IN' THEN 'IND' WHEN 'IR' THEN 'IRN' END AS by_code FROM nation""")
def normalize_country(spark, d):
    code = F.substring("n_name", 1, 2)
    return D.table(spark, d, "nation").select("n_nationkey", N.normalize_country(F.col("n_name")).alias("by_name"), N.normalize_country(F.when(code.isin("FR", "BR", "CA", "RO", "RU", "IN", "IR"), code)).alias("by_code"))


# --- Rules ---


def _rule(name: str, find, tables, sql: str) -> None:
    QUERIES[name] = lambda spark, d: find(tables(spark, d), S)
    ORACLES[name] = sql


_company = lambda spark, d: rules.Tables(_companies(spark, d))
_authority = lambda spark, d: rules.Tables(_authorities(spark, d))
for _c in ("lei", "cik", "vat"):
    _rule(f"exact_{_c}", rules.exact_id(_c), _company, f"WITH {C} {_sql_pairs(f'a.{_c} = b.{_c}', 'merge', 1.0, True)}")
_rule("authority_id", rules.authority_id, _authority, f"WITH {A} {_sql_pairs('a.id = b.id', 'merge', 1.0, False)}")
NAMES = "a.name_clean = b.name_clean AND a.name_clean <> ''"
SUCCESSOR = _sql_pairs(f"{NAMES} AND a.country = b.country AND left(a.lei, 4) = left(b.lei, 4)", "merge", 0.98, False, "a.active AND b.lei IS NOT NULL AND NOT coalesce(b.active, TRUE)")
NAME_COUNTRY = _sql_pairs(f"{NAMES} AND a.country = b.country", "flag", 0.95, True)
_rule("successor", rules.successor, _company, f"WITH {C} {SUCCESSOR}")
_rule("name_country_company", rules.name_country_company, _company, f"WITH {C} {NAME_COUNTRY}")
_rule("name_country_authority", rules.name_country_authority, _authority, f"WITH {A} {_sql_pairs(f'{NAMES} AND a.country = b.country', 'merge', 0.95, False)}")
_rule("name_any_country", rules.name_any_country, _authority, f"WITH {A} {_sql_pairs(NAMES, 'flag', 0.90, False, 'coalesce(a.country, chr(32)) <> coalesce(b.country, chr(32))')}")

#: BM25 in SQL; sources `q` and `docs` have (id, text, country).
BM25 = """words AS (SELECT id, country, list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '') AS w FROM docs),
idx AS (SELECT id, country, len(any_value(w)) AS n, token, count(*) AS tf FROM (SELECT id, country, w, unnest(w) AS token FROM words) GROUP BY id, country, token),
size AS (SELECT count(*) AS docs, avg(len(w)) AS mean FROM words WHERE len(w) > 0),
idf AS (SELECT token, ln(1 + ((SELECT docs FROM size) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM idx GROUP BY token),
asked AS (SELECT DISTINCT id, country, unnest(list_filter(regexp_split_to_array(lower(text), '[^\\p{L}\\p{N}]+'), lambda x: x <> '')) AS token FROM q),
total AS (SELECT a.id AS source_id, i.id AS target_id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * n / (SELECT mean FROM size)))), 6) AS score
  FROM asked a JOIN idx i ON a.token = i.token AND a.country = i.country JOIN idf ON idf.token = i.token WHERE {where} GROUP BY 1, 2),
best AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY score DESC, target_id) AS place FROM total WHERE {floor})"""
QUERY_TEXT = "trim(regexp_replace(translate(name, '+-&|!(){}[]^\"~*?:\\/', '                    '), '\\s+', ' ', 'g'))"


def _bm25(limit: int, where: str = "a.id <> i.id", floor: str = "TRUE") -> str:
    return BM25.replace("{where}", where).replace("{floor}", floor) + f", found AS (SELECT * FROM best WHERE place <= {limit})"


@query("bm25_topk", f"WITH {A}, docs AS (SELECT id, {QUERY_TEXT} AS text, country FROM prepared WHERE country IS NOT NULL), q AS (SELECT * FROM docs), {_bm25(5)} SELECT source_id, target_id, score, place FROM found")
def bm25_topk(spark, d):
    docs = _authorities(spark, d).filter("country is not null").select("id", N.query_text(F.col("name")).alias("text"), "country")
    return fulltext.retrieve(docs, docs, 5, ["country"], max_df=S.fulltext_max_df)


FORMS = "(?:\\b(?:" + "|".join(f for f in N.SHORT_FORMS if f.isascii()) + ")\\.?\\b)"
AUTHORITY_NORM = "trim(regexp_replace(regexp_replace(upper(replace(name, 'ß', 'ss')), '[^\\p{L}\\p{N}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"
COMPANY_NORM = f"trim(regexp_replace(regexp_replace(regexp_replace(upper(name), '{FORMS}', ' ', 'g'), '[^\\p{{L}}\\p{{N}}_\\s]', ' ', 'g'), '\\s+', ' ', 'g'))"


#: DuckDB's Jaro-Winkler compares bytes; letters of two bytes become lower-case ones, which upper-cased names don't have.
BYTES = "translate({}, 'ÀÁÂÄÇÈÉÊËÍÎÏÑÓÔÖÙÚÛÜŒ', 'abcdefghijklmnopqrstu')"


def _sql_fuzzy(norm: str, conflicts: bool) -> str:
    prop = CONFLICT if conflicts else "NULL::VARCHAR"
    return f"""near AS (
  SELECT source_id, target_id, jaro_winkler_similarity({BYTES.format('a.norm')}, {BYTES.format('b.norm')}) AS jw, {prop} AS prop
  FROM found JOIN (SELECT *, {norm} AS norm FROM prepared) a ON a.id = source_id JOIN (SELECT *, {norm} AS norm FROM prepared) b ON b.id = target_id WHERE a.norm <> '' AND b.norm <> ''
), fuzzy AS (SELECT source_id, target_id, CASE WHEN prop IS NULL THEN jw ELSE 0.0 END AS confidence, CASE WHEN prop IS NULL THEN 'flag' ELSE 'noop' END AS action, FALSE AS conflict, NULL::VARCHAR AS conflict_property FROM near WHERE jw >= 0.92)"""


DOCS = f"docs AS (SELECT id, {QUERY_TEXT} AS text, country FROM prepared WHERE name <> '' AND country <> ''), q AS (SELECT * FROM docs)"
FUZZY_COMPANY = f"{DOCS}, {_bm25(20)}, {_sql_fuzzy(COMPANY_NORM, True)}"
ROUNDED = "SELECT source_id, target_id, round(confidence, 6) AS confidence, action, conflict, conflict_property FROM fuzzy"


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("confidence", F.round("confidence", 6))


@query("fuzzy_company", f"WITH {C}, {FUZZY_COMPANY} {ROUNDED}")
def fuzzy_company(spark, d):
    return _rounded(rules.fuzzy_company(_company(spark, d), S))


@query("fuzzy_authority", f"WITH {A}, {DOCS}, {_bm25(20)}, {_sql_fuzzy(AUTHORITY_NORM, False)} {ROUNDED}")
def fuzzy_authority(spark, d):
    return _rounded(rules.fuzzy_authority(_authority(spark, d), S))


# --- Vectors and graphs ---

KNN = f"""{D.VECTORS}, unit AS (SELECT *, list_transform(vector, lambda x: x / sqrt(list_sum(list_transform(vector, lambda y: y * y)))) AS u FROM vectors),
ranked AS (SELECT a.id AS source_id, b.id AS target_id, round(list_cosine_similarity(a.vector, b.vector), 9) AS score, a.encoder AS ea, b.encoder AS eb, a.country AS ca, b.country AS cb, lower(a.name) AS na, lower(b.name) AS nb,
  row_number() OVER (PARTITION BY a.id ORDER BY round(list_cosine_similarity(a.vector, b.vector), 9) DESC, b.id) AS place FROM vectors a, vectors b)"""
KNN_FILTER = "place <= 4 AND source_id <> target_id AND score >= 0.3 AND ea = eb AND ca <> cb AND jaro_winkler_similarity(na, nb) >= 0.45"


@query("knn_embedding", f"WITH {KNN} SELECT source_id, target_id, round(score, 6) AS score, place FROM ranked WHERE place <= 4")
def knn_embedding(spark, d):
    return vectors.nearest(D.vectors(spark, d), S.embedding_top_k + 1).withColumn("score", F.round("score", 6))


@query("embedding_rule", f"WITH {KNN} SELECT source_id, target_id, round(score, 6) AS confidence, 'flag' AS action, FALSE AS conflict, NULL::VARCHAR AS conflict_property FROM ranked WHERE {KNN_FILTER}")
def embedding_rule(spark, d):
    return _rounded(rules.embedding(rules.Tables(D.vectors(spark, d)), S))


@query("knn_not_reviewed", f"WITH {KNN} SELECT source_id, target_id, round(score, 6) AS confidence, 'flag' AS action, FALSE AS conflict, NULL::VARCHAR AS conflict_property FROM ranked WHERE {KNN_FILTER} AND right(source_id, 1) <> right(target_id, 1) AND right(source_id, 1) NOT IN ('1', '2', '3')")
def knn_not_reviewed(spark, d):
    rows = D.vectors(spark, d)
    near = vectors.nearest(rows, S.embedding_top_k + 1)
    done = near.select(F.col("source_id").alias("src"), F.col("target_id").alias("dst"), (F.substring("source_id", -1, 1).isin("1", "2", "3") | (F.substring("source_id", -1, 1) == F.substring("target_id", -1, 1))).alias("reviewed"))
    return _rounded(rules.embedding(rules.Tables(rows, same_as=done), S))


@query("node_similarity", f"""WITH {D.NEIGHBOURS}, e AS (SELECT DISTINCT node, neighbour FROM neighbours), n AS (SELECT node, count(*) AS n FROM e GROUP BY node),
  common AS (SELECT a.node AS source_id, b.node AS target_id, count(*) AS c FROM e a JOIN e b ON a.neighbour = b.neighbour AND a.node <> b.node GROUP BY 1, 2),
  scored AS (SELECT source_id, target_id, c / (x.n + y.n - c) AS similarity FROM common JOIN n x ON x.node = source_id JOIN n y ON y.node = target_id),
  best AS (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY similarity DESC, target_id) AS place FROM scored WHERE similarity >= 0.7)
  SELECT source_id, target_id, round(least(0.95, similarity), 6) AS confidence, 'flag' AS action, FALSE AS conflict, NULL::VARCHAR AS conflict_property FROM best WHERE place <= 5""")
def node_similarity(spark, d):
    return _rounded(rules.neighbourhood(rules.Tables(D.companies(spark, d), neighbours=D.neighbours(spark, d)), S))


#: Reviewed clusters never leave a group of eight keys, so the recursion is short.
WCC = f"""RECURSIVE {D.SAME_AS}, und AS (SELECT src AS a, dst AS b FROM same_as WHERE reviewed AND NOT conflict UNION SELECT dst, src FROM same_as WHERE reviewed AND NOT conflict),
reach AS (SELECT a AS node, a AS other FROM und UNION SELECT r.node, u.b FROM reach r JOIN und u ON r.other = u.a), wcc AS (SELECT node, min(other) AS component FROM reach GROUP BY node)"""


@query("wcc", f"WITH {WCC} SELECT node, component FROM wcc")
def wcc(spark, d):
    return graph.connected_components(D.same_as(spark, d).filter("reviewed and not conflict"))


COLLAPSE = f"""{D.COMPANIES}, members AS (SELECT id, component, lei IS NULL AS no_lei, coalesce(nullif(created_at, ''), '￿') AS age FROM wcc JOIN company ON id = node),
collapsed AS (SELECT id, component, first_value(id) OVER (PARTITION BY component ORDER BY no_lei, age, id) AS canonical, count(*) OVER (PARTITION BY component) AS n FROM members)"""


@query("wcc_collapse", f"WITH {WCC}, {COLLAPSE} SELECT id, component, canonical FROM collapsed WHERE n > 1")
def wcc_collapse(spark, d):
    return graph.cluster_collapse(D.same_as(spark, d), D.companies(spark, d))


@query("contract_graph", f"""WITH {WCC}, {COLLAPSE}, m AS (SELECT id AS merged, canonical FROM collapsed WHERE n > 1 AND id <> canonical), e AS (SELECT src, 'SAME_AS' AS rel, dst FROM same_as),
  moved AS (SELECT DISTINCT coalesce(x.canonical, src) AS src, rel, coalesce(y.canonical, dst) AS dst FROM e LEFT JOIN m x ON x.merged = src LEFT JOIN m y ON y.merged = dst) SELECT * FROM moved WHERE src <> dst""")
def contract_graph(spark, d):
    edges = D.same_as(spark, d)
    merged = graph.cluster_collapse(edges, D.companies(spark, d)).filter("id <> canonical").select(F.col("id").alias("merged"), "canonical")
    return graph.contract(edges.select("src", F.lit("SAME_AS").alias("rel"), "dst"), merged)


# --- Decisions ---

PARTS = {
    1: ("exact_lei_match", "NULL", True, _sql_pairs("a.lei = b.lei", "merge", 1.0, True)),
    2: ("exact_cik_match", "NULL", True, _sql_pairs("a.cik = b.cik", "merge", 1.0, True)),
    3: ("exact_vat_match", "NULL", True, _sql_pairs("a.vat = b.vat", "merge", 1.0, True)),
    9: ("successor_lei_match", "NULL", True, SUCCESSOR),
    10: ("exact_name_country_match", "NULL", False, NAME_COUNTRY),
    11: ("fuzzy_name_same_country", "0.97", False, "SELECT * FROM fuzzy"),
}


def _sql_decisions(enabled: bool) -> str:
    union = " UNION ALL ".join(f"SELECT *, '{n}' AS rule, {p} AS priority, {t}::DOUBLE AS threshold, {f} AS forced FROM ({sql})" for p, (n, t, f, sql) in PARTS.items())
    gate = "FALSE" if enabled else "decided = 'merge' AND NOT force"
    return f"""{C}, {FUZZY_COMPANY}, cand AS ({union}),
promoted AS (SELECT *, CASE WHEN action = 'flag' AND threshold IS NOT NULL AND confidence >= threshold AND NOT conflict THEN 'merge' ELSE action END AS decided FROM cand),
stamped AS (SELECT *, forced AND decided = 'merge' AND NOT conflict AS force FROM promoted),
gated AS (SELECT *, CASE WHEN {gate} THEN 'flag' WHEN decided = 'merge' THEN 'auto_merge' WHEN decided = 'flag' THEN CASE WHEN conflict THEN 'conflict' ELSE 'flag' END ELSE 'noop' END AS outcome FROM stamped),
cut AS (SELECT *, min(CASE WHEN outcome = 'auto_merge' THEN priority END) OVER (PARTITION BY source_id, target_id) AS done FROM gated),
decisions AS (SELECT * FROM cut WHERE done IS NULL OR priority <= done)"""


MATCH_RULES = [r for r in rules.RULES if r.priority in PARTS]


def _once(spark, d) -> rules.Tables:
    """The companies, prepared once for all rules."""
    return rules.Tables(graph.settled(_companies(spark, d)))


def _found(spark, d) -> DataFrame:
    return engine.candidates(_once(spark, d), "Company", S, rules=MATCH_RULES)


def _decided(spark, d, enabled: bool = True) -> DataFrame:
    return engine.decide(_found(spark, d), Settings(auto_merge_enabled=enabled), MATCH_RULES)


SHOWN = "source_id, target_id, rule, priority, round(confidence, 6) AS confidence, conflict, conflict_property, decided, outcome"
for _on in (False, True):
    QUERIES[f"decisions_gate_{'on' if _on else 'off'}"] = lambda spark, d, on=_on: _decided(spark, d, on).select("source_id", "target_id", "rule", "priority", F.round("confidence", 6).alias("confidence"), "conflict", "conflict_property", "decided", "outcome")
    ORACLES[f"decisions_gate_{'on' if _on else 'off'}"] = f"WITH {_sql_decisions(_on)} SELECT {SHOWN} FROM decisions"


FOLD = """fold AS (SELECT source_id, target_id, bool_or(conflict) AS conflict, list(rule ORDER BY priority) AS rules, list(round(confidence, 6) ORDER BY priority) AS confidences FROM decisions WHERE outcome IN ('flag', 'conflict') GROUP BY 1, 2)"""


@query("same_as_fold", f"WITH {_sql_decisions(False)}, {FOLD} SELECT source_id, target_id, conflict, array_to_string(rules, ',') AS rules, list_max(confidences) AS confidence, rules[list_position(confidences, list_max(confidences))] AS method FROM fold")
def same_as_fold(spark, d):
    folded = engine.fold_pass(_once(spark, d), "Company", S, F.lit("2024-01-01"), 6, rules=MATCH_RULES)
    return folded.select("source_id", "target_id", "conflict", F.array_join("rules", ",").alias("rules"), "confidence", "method")


ASKED = "ids_asked AS (SELECT id FROM company UNION ALL SELECT 'missing'), made AS (SELECT source_id, count(*) AS n, bool_or(outcome = 'auto_merge') AS m, bool_or(outcome = 'conflict') AS c, bool_or(outcome = 'flag') AS f FROM decisions GROUP BY 1), fired AS (SELECT source_id, count(DISTINCT rule) AS r FROM cand GROUP BY 1)"
SUMMARY = "summary AS (SELECT ids_asked.id, coalesce(n, 0) AS decisions_count, coalesce(r, 0) AS rules_fired, CASE WHEN ids_asked.id = 'missing' THEN 'not_found' WHEN m THEN 'merged' WHEN c THEN 'conflict_flagged' WHEN f THEN 'flagged' WHEN n > 0 THEN 'noop' ELSE 'no_match' END AS outcome FROM ids_asked LEFT JOIN made ON made.source_id = ids_asked.id LEFT JOIN fired ON fired.source_id = ids_asked.id)"


def _summary(spark, d) -> tuple[DataFrame, DataFrame]:
    judged = engine.judge(_found(spark, d), Settings(auto_merge_enabled=True), MATCH_RULES)
    companies = D.companies(spark, d)
    ids = companies.select("id").union(spark.createDataFrame([("missing",)], "id string"))
    return engine.run_summary(ids, companies, judged), judged.filter(~F.col("skipped"))


@query("run_summary", f"WITH {_sql_decisions(True)}, {ASKED}, {SUMMARY} SELECT * FROM summary")
def run_summary(spark, d):
    return _summary(spark, d)[0]


@query("batch_summary", f"WITH {_sql_decisions(True)}, {ASKED}, {SUMMARY} SELECT (SELECT count(*) FROM summary) AS processed, count_if(outcome = 'auto_merge') AS merged, count_if(outcome = 'auto_link') AS linked, count_if(outcome = 'flag') AS flagged, count_if(outcome = 'conflict') AS conflicts FROM decisions")
def batch_summary(spark, d):
    return engine.batch_summary(*_summary(spark, d))


@query("rule_fires", f"WITH {_sql_decisions(True)} SELECT rule, outcome, count(*) AS fires FROM decisions GROUP BY 1, 2")
def rule_fires(spark, d):
    return engine.rule_fires(_decided(spark, d))


@query("sweep_outcome", f"WITH {_sql_decisions(True)} SELECT source_id AS id, CASE WHEN bool_or(outcome = 'auto_merge') THEN 'merged' WHEN bool_or(outcome = 'conflict') THEN 'conflict' WHEN bool_or(outcome = 'flag') THEN 'flagged' ELSE 'noop' END AS outcome FROM decisions GROUP BY 1")
def sweep_outcome(spark, d):
    return engine.sweep_outcome(_decided(spark, d))


@query("greedy_merges")
def greedy_merges(spark, d):
    return engine.greedy_pass(_once(spark, d), "Company", Settings(auto_merge_enabled=True), rules=MATCH_RULES)


@query("merge_apply", f"""WITH {WCC}, {COLLAPSE}, m AS (SELECT c.id AS merged, c.canonical, x.lei FROM collapsed c JOIN company x ON x.id = c.id WHERE n > 1 AND c.id <> c.canonical),
  h AS (SELECT canonical, string_agg(DISTINCT lei, ',' ORDER BY lei) AS historic FROM m GROUP BY 1) SELECT id, name, coalesce(historic, '') AS historic FROM company LEFT JOIN h ON canonical = id WHERE id NOT IN (SELECT merged FROM m)""")
def merge_apply(spark, d):
    companies = D.companies(spark, d)
    clusters = graph.cluster_collapse(D.same_as(spark, d), companies).filter("id <> canonical")
    merges = clusters.join(companies.select("id", "lei"), "id").select("canonical", F.col("id").alias("merged"), F.col("lei").alias("retired_lei"))
    return apply.collapse_entities(companies, merges).select("id", "name", F.array_join("historic_leis", ",").alias("historic"))


@query("audit_log", f"WITH {_sql_decisions(True)} SELECT source_id, target_id, rule AS rule_name, outcome AS decision_type, 'Company' AS entity_type FROM decisions")
def audit_log(spark, d):
    log = apply.audit(_decided(spark, d), "Company", F.timestamp_seconds(F.lit(1_700_000_000)))["decisions"]
    return log.select("source_id", "target_id", "rule_name", "decision_type", "entity_type")


@query("same_as_events", f"WITH {_sql_decisions(True)} SELECT 'AssertSameAs' AS event_type, 'urn:demo/Company/' || source_id AS iri, 'urn:demo/Company/' || target_id AS other, rule FROM decisions WHERE outcome = 'auto_merge'")
def same_as_events(spark, d):
    events = apply.same_as_events(_decided(spark, d), "Company", "urn:demo", F.timestamp_seconds(F.lit(0)))
    return events.select("event_type", "iri", F.col("payload")["other"].alias("other"), F.col("payload")["rule"].alias("rule"))


@query("link_upsert", f"""WITH {D.SAME_AS}, every AS (SELECT src, dst, 'old' AS rule, 0.5 AS confidence, detected_sec AS made FROM same_as UNION ALL SELECT src, dst, 'new', 0.7, 1700050000 FROM same_as WHERE k % 2 = 0)
  SELECT src AS source_id, 'RELATED_TO' AS rel, dst AS target_id, rule AS created_by_rule, confidence::DOUBLE AS confidence FROM (SELECT *, row_number() OVER (PARTITION BY src, dst ORDER BY made DESC, confidence DESC) AS p FROM every) WHERE p = 1""")
def link_upsert(spark, d):
    edges = D.same_as(spark, d)
    row = lambda df, rule, conf, at: df.select(F.col("src").alias("source_id"), F.lit("RELATED_TO").alias("rel"), F.col("dst").alias("target_id"), F.lit(rule).alias("created_by_rule"), F.lit(conf).alias("confidence"), at.alias("created_at"))
    even = edges.filter(F.substring("src", 2, 20).cast("long") % 2 == 0)
    return apply.upsert_links(row(edges, "old", 0.5, F.col("detected_at")), row(even, "new", 0.7, F.timestamp_seconds(F.lit(1_700_050_000)))).drop("created_at")


# --- Resolver and review ---

REQUESTS = f"""requests AS (SELECT key AS row_id, CASE WHEN key % 6 = 5 THEN left(name, length(name) - 4) || ' Holding' ELSE name END AS name, CASE key % 4 WHEN 0 THEN country WHEN 1 THEN left(country, 2) WHEN 2 THEN 'Germany' END AS country,
  CASE WHEN key % 6 = 0 THEN lower(lei) END AS lei, CASE WHEN key % 6 = 1 THEN vat END AS vat, CASE WHEN key % 6 = 2 THEN cik END AS cik, CASE WHEN key % 6 = 3 THEN ' ' || registered_as END AS registered_as FROM company)"""
ISO = "CASE upper(trim(country)) WHEN 'DE' THEN 'DEU' WHEN 'FR' THEN 'FRA' WHEN 'IR' THEN 'IRN' WHEN 'ES' THEN 'ESP' WHEN 'GERMANY' THEN 'DEU' WHEN 'DEU' THEN 'DEU' WHEN 'FRA' THEN 'FRA' WHEN 'IRL' THEN 'IRL' WHEN 'ESP' THEN 'ESP' WHEN 'POL' THEN 'POL' END"


def requests(spark, d) -> DataFrame:
    k = F.col("key")
    only = lambda r, c: F.when(k % 6 == r, c)
    return D.companies(spark, d).select(
        k.alias("row_id"), F.when(k % 6 == 5, F.concat(F.expr("left(name, length(name) - 4)"), F.lit(" Holding"))).otherwise(F.col("name")).alias("name"),
        F.when(k % 4 == 0, F.col("country")).when(k % 4 == 1, F.substring("country", 1, 2)).when(k % 4 == 2, "Germany").alias("country"),
        only(0, F.lower("lei")).alias("lei"), only(1, F.col("vat")).alias("vat"), only(2, F.col("cik")).alias("cik"), only(3, F.concat(F.lit(" "), "registered_as")).alias("registered_as"),
    )


@query("resolve_batch", f"""WITH {C}, {REQUESTS}, r AS (SELECT *, {ISO} AS iso, {CLEAN.format('name')} AS clean, {LEI} AS l, {VAT} AS v, {CIK} AS c, coalesce(length(name) >= 6, FALSE) AND ({ISO}) IS NOT NULL AS full_name FROM requests),
  hits AS (SELECT row_id, e.id, 'lei' AS tier, 1 AS rank, 1.0 AS confidence FROM r JOIN prepared e ON e.lei = r.l UNION ALL SELECT row_id, e.id, 'vat', 2, 0.99 FROM r JOIN prepared e ON e.vat = r.v UNION ALL SELECT row_id, e.id, 'cik', 3, 0.99 FROM r JOIN prepared e ON e.cik = r.c
    UNION ALL SELECT row_id, e.id, 'registered_as', 4, 0.98 FROM r JOIN prepared e ON e.registered_as = trim(r.registered_as) AND e.country = iso UNION ALL SELECT row_id, e.id, 'name_country', 5, 0.95 FROM r JOIN prepared e ON e.name_clean = r.clean AND e.country = iso WHERE full_name),
  exact AS (SELECT row_id, tier, confidence, list(id ORDER BY id) AS ids FROM (SELECT *, min(rank) OVER (PARTITION BY row_id) AS b FROM hits) WHERE rank = b GROUP BY 1, 2, 3),
  docs AS (SELECT id, {QUERY_TEXT} AS text, coalesce(country, '') AS country FROM prepared), q AS (SELECT row_id AS id, {QUERY_TEXT} AS text, iso AS country FROM r WHERE full_name AND length({QUERY_TEXT}) >= 6 AND row_id NOT IN (SELECT row_id FROM exact)),
  {_bm25(5, 'TRUE', 'score > 4.0')}, fz AS (SELECT source_id AS row_id, list(target_id ORDER BY place) AS ids, max(score) AS s FROM found GROUP BY 1)
  SELECT r.row_id, CASE WHEN len(e.ids) = 1 THEN 'matched' WHEN e.ids IS NOT NULL OR f.ids IS NOT NULL THEN 'ambiguous' ELSE 'no_match' END AS hint, coalesce(e.tier, CASE WHEN f.ids IS NOT NULL THEN 'fuzzy' END) AS tier,
    round(coalesce(e.confidence, CASE WHEN f.s IS NOT NULL THEN least(0.94, f.s / 10) END), 6)::DOUBLE AS confidence, CASE WHEN len(e.ids) = 1 THEN e.ids[1] END AS match_id, array_to_string(coalesce(e.ids[1:2], f.ids, []), ',') AS candidates, iso AS normalised_country
  FROM r LEFT JOIN exact e USING (row_id) LEFT JOIN fz f USING (row_id)""")
def resolve_batch(spark, d):
    out = resolve.resolve(requests(spark, d), _companies(spark, d), "Company", S)
    return out.withColumns({"candidates": F.array_join("candidates", ","), "confidence": F.round("confidence", 6)})


def _edges(spark, d) -> DataFrame:
    none = lambda k: F.lit(None).cast(f"array<{k}>")
    old = F.substring("src", 2, 20).cast("long") % 2 == 0
    return D.same_as(spark, d).select("*", F.lit(0.9).alias("confidence"), F.lit("exact_name_country_match").alias("method"), F.when(old, none("string")).otherwise(F.array(F.lit("a"), F.lit(None).cast("string"))).alias("rules"), F.when(old, none("double")).otherwise(F.array(F.lit(0.9), F.lit(0.1))).alias("confidences"), F.when(old, none("timestamp")).otherwise(F.array("detected_at", "detected_at")).alias("dates"))


@query("candidates_page", f"""WITH {D.COMPANIES}, {D.SAME_AS}, page AS (SELECT * FROM same_as WHERE NOT reviewed AND detected_sec < 1700090000 ORDER BY detected_sec DESC, src, dst LIMIT 40)
  SELECT src, a.name AS src_name, dst, b.name AS dst_name, 0.9::DOUBLE AS confidence, 'exact_name_country_match' AS rule_name, detected_sec, conflict, CASE WHEN k % 2 = 0 THEN 'exact_name_country_match' ELSE 'a' END AS detections FROM page JOIN company a ON a.id = src JOIN company b ON b.id = dst""")
def candidates_page(spark, d):
    page = review.candidates_page(_edges(spark, d), D.companies(spark, d), cursor=F.timestamp_seconds(F.lit(1_700_090_000)), limit=40)
    return page.withColumns({"detected_sec": F.col("detected_at").cast("long"), "detections": F.array_join(F.transform("detections", lambda x: x["rule"]), ",")}).drop("detected_at")


def _relations(spark, d) -> DataFrame:
    k = F.substring("src", 2, 20).cast("long")
    return D.same_as(spark, d).select(F.concat(F.lit("E"), k.cast("string")).alias("edge_id"), F.when(k % 3 == 0, "SANCTIONED").otherwise("REPRESENTS").alias("rel"), "src", "dst", "reviewed", F.when(k % 7 != 0, F.lit(0.6)).alias("confidence"), F.when(k % 2 == 0, "tier1").alias("method"), F.when(k % 4 != 2, F.col("detected_at")).alias("detected_at"))


RELATIONS = f"{D.SAME_AS}, relations AS (SELECT 'E' || k AS edge_id, CASE WHEN k % 3 = 0 THEN 'SANCTIONED' ELSE 'REPRESENTS' END AS rel, src, dst, reviewed, CASE WHEN k % 7 <> 0 THEN 0.6::DOUBLE END AS confidence, CASE WHEN k % 2 = 0 THEN 'tier1' END AS method, CASE WHEN k % 4 <> 2 THEN detected_sec END AS sec, k FROM same_as)"


@query("relationships_page", f"WITH {RELATIONS} SELECT edge_id, src, dst, confidence, method FROM relations WHERE rel = 'REPRESENTS' AND NOT reviewed ORDER BY coalesce(sec, 1700050000) DESC, edge_id LIMIT 50")
def relationships_page(spark, d):
    return review.relationships_page(_relations(spark, d), "REPRESENTS", F.timestamp_seconds(F.lit(1_700_050_000))).select("edge_id", "src", "dst", "confidence", "method")


def _choices(spark, d) -> DataFrame:
    k = F.substring("edge_id", 2, 20).cast("long")
    return _relations(spark, d).filter(k % 3 != 1).select("edge_id", F.when(k % 3 == 0, "accept").otherwise("reject").alias("choice"), F.lit("ann").alias("reviewer"))


@query("decide_relationships", f"WITH {RELATIONS} SELECT edge_id, rel, src, dst, reviewed OR k % 3 = 0 AS reviewed, confidence, method FROM relations WHERE k % 3 <> 2")
def decide_relationships(spark, d):
    return review.decide_relationships(_relations(spark, d), _choices(spark, d))[0].drop("detected_at")


@query("decide_relationships_log", f"WITH {RELATIONS} SELECT edge_id, CASE WHEN k % 3 = 0 THEN 'manual_accept' ELSE 'manual_reject' END AS decision_type, coalesce(method, rel) AS rule_name, coalesce(confidence, 0.0)::DOUBLE AS confidence, src AS source_id, dst AS target_id, 'ann' AS reviewer FROM relations WHERE k % 3 <> 1")
def decide_relationships_log(spark, d):
    return review.decide_relationships(_relations(spark, d), _choices(spark, d))[1]


def _pair_choices(spark, d) -> DataFrame:
    k = F.substring("src", 2, 20).cast("long")
    return D.same_as(spark, d).filter(k % 6 < 3).select(F.col("dst").alias("a"), F.col("src").alias("b"), F.element_at(F.array(F.lit("merge"), F.lit("reject"), F.lit("keep_as_related")), (k % 6 + 1).cast("int")).alias("choice"))


@query("decide_pairs", f"WITH {D.SAME_AS} SELECT src, dst, reviewed OR k % 6 = 2 AS reviewed, conflict, kept OR k % 6 = 2 AS kept FROM same_as WHERE k % 6 >= 2")
def decide_pairs(spark, d):
    return review.decide(D.same_as(spark, d), _pair_choices(spark, d))[0].drop("detected_at")


@query("decide_merges", f"WITH {D.SAME_AS} SELECT dst AS canonical, src AS merged FROM same_as WHERE k % 6 = 0")
def decide_merges(spark, d):
    return review.decide(D.same_as(spark, d), _pair_choices(spark, d))[1]


@query("decisions_page", f"WITH {D.SAME_AS} SELECT 'D' || k AS decision_id, src AS source_id, dst AS target_id FROM same_as WHERE reviewed AND detected_sec >= 1700010000 AND detected_sec < 1700080000 ORDER BY detected_sec DESC, 'D' || k LIMIT 100")
def decisions_page(spark, d):
    log = D.same_as(spark, d).select(F.concat(F.lit("D"), F.substring("src", 2, 20)).alias("decision_id"), F.col("src").alias("source_id"), F.col("dst").alias("target_id"), F.when(F.col("reviewed"), "Company").otherwise("Authority").alias("entity_type"), F.col("detected_at").alias("decided_at"))
    return review.decisions_page(log, entity_type="Company", since=F.timestamp_seconds(F.lit(1_700_010_000)), cursor=F.timestamp_seconds(F.lit(1_700_080_000))).select("decision_id", "source_id", "target_id")


# --- Evaluation ---

HOMONYMS = "homonyms AS (SELECT name_clean, country, count(DISTINCT lei) AS distinct_leis FROM prepared WHERE lei IS NOT NULL AND name_clean IS NOT NULL AND country IS NOT NULL GROUP BY 1, 2)"


@query("homonyms", f"WITH {C}, {HOMONYMS}, n AS (SELECT count(*) AS groups, count_if(distinct_leis > 1) AS homonym_groups, coalesce(sum(distinct_leis) FILTER (distinct_leis > 1), 0)::BIGINT AS entities_at_risk FROM homonyms) SELECT *, CASE WHEN groups > 0 THEN round((groups - homonym_groups) / groups, 4) ELSE 1.0 END AS group_precision FROM n")
def homonyms(spark, d):
    return evaluate.group_precision(_companies(spark, d))


@query("worst_homonyms", f"WITH {C}, {HOMONYMS} SELECT * FROM homonyms WHERE distinct_leis > 1 ORDER BY distinct_leis DESC, name_clean, country LIMIT 8")
def worst_homonyms(spark, d):
    return evaluate.worst_homonyms(_companies(spark, d))


@query("recall_gap", f"WITH {C} SELECT count(*) AS same_entity_name_drift_pairs FROM (SELECT vat FROM prepared WHERE vat IS NOT NULL GROUP BY vat HAVING count(DISTINCT name_clean) > 1)")
def recall_gap(spark, d):
    return evaluate.recall_gap(_companies(spark, d))


@query("fidelity", f"WITH {C} SELECT count(*) AS checked, count(*) AS match, 100.0::DOUBLE AS pct FROM prepared WHERE name IS NOT NULL")
def fidelity(spark, d):
    return evaluate.fidelity(_companies(spark, d))


@query("perturbation_recall", f"""WITH {C}, v AS (
  SELECT name, 'uppercase' AS kind, upper(name) AS p FROM company UNION ALL SELECT name, 'lowercase', lower(name) FROM company UNION ALL SELECT name, 'strip_accents', strip_accents(name) FROM company
  UNION ALL SELECT name, 'double_space', replace(name, ' ', '  ') FROM company UNION ALL SELECT name, 'drop_punct', replace(replace(name, '.', ''), ',', '') FROM company UNION ALL SELECT name, 'edge_space', '  ' || name || ' ' FROM company
  UNION ALL SELECT name, 'expand_legal_form', replace(name, 'GmbH', 'Gesellschaft mit beschränkter Haftung') FROM company WHERE contains(name, 'GmbH') UNION ALL SELECT name, 'expand_legal_form', replace(name, 'S.A.', 'Société Anonyme') FROM company WHERE contains(name, 'S.A.')
  UNION ALL SELECT name, 'expand_legal_form', replace(name, 'Ltd', 'Limited') FROM company WHERE contains(name, 'Ltd'))
  SELECT kind, count(*) AS total, count_if({CLEAN.format('p')} = {CLEAN.format('name')}) AS matched FROM v GROUP BY kind""")
def perturbation_recall(spark, d):
    return evaluate.perturbation_recall(D.companies(spark, d).select("id", "name"))


def _confusion_pairs(spark, d):
    number = lambda c: F.floor(F.substring(c, 2, 20).cast("long") / 4)
    pairs = _found(spark, d).filter("rule = 'exact_name_country_match'").select("source_id", "target_id", F.lit(True).alias("hit"))
    every = D.same_as(spark, d).select(F.col("src").alias("source_id"), F.col("dst").alias("target_id"))
    return every.join(pairs, ["source_id", "target_id"], "left").select((number("source_id") == number("target_id")).alias("same"), F.coalesce("hit", F.lit(False)).alias("linked"))


@query("confusion_matrix", f"""WITH {C}, {D.SAME_AS}, hit AS ({NAME_COUNTRY}), pairs AS (SELECT (substr(src, 2)::BIGINT // 4) = (substr(dst, 2)::BIGINT // 4) AS same, h.source_id IS NOT NULL AS linked FROM same_as LEFT JOIN hit h ON h.source_id = src AND h.target_id = dst),
  n AS (SELECT count_if(same AND linked) AS tp, count_if(NOT same AND linked) AS fp, count_if(same AND NOT linked) AS fn, count_if(NOT same AND NOT linked) AS tn FROM pairs),
  m AS (SELECT *, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 1.0 END AS p, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 1.0 END AS r FROM n)
  SELECT tp, fp, fn, tn, round(p, 4) AS precision, round(r, 4) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0.0 END, 4) AS f1 FROM m""")
def confusion_matrix(spark, d):
    return evaluate.confusion(_confusion_pairs(spark, d))


# --- Events, sweep, enrichment ---

LABEL = "CASE WHEN event_type IN ('UpsertCompany', 'UpsertFiling') THEN 'Company' WHEN event_type = 'UpsertAuthority' THEN 'Authority' END"


@query("event_dispatch", f"WITH {D.EVENTS} SELECT seq, event_type, {LABEL} AS label, CASE WHEN event_type <> 'DeleteCompany' THEN entity_id END AS entity_id, CASE WHEN event_type = 'DeleteCompany' THEN 'noop' WHEN entity_id IS NULL THEN 'missing_id' ELSE 'dispatch' END AS status FROM event_log WHERE event_type <> 'AssertSameAs'")
def event_dispatch(spark, d):
    return dispatch.route(D.event_log(spark, d))


@query("event_due", f"WITH {D.EVENTS} SELECT {LABEL} AS label, entity_id, min(seq) AS first_seq, count(*) AS n_events FROM event_log WHERE event_type IN ('UpsertCompany', 'UpsertFiling', 'UpsertAuthority') AND entity_id IS NOT NULL GROUP BY 1, 2")
def event_due(spark, d):
    return dispatch.due(D.event_log(spark, d))


@query("event_dispatch_stream", ORACLES["event_dispatch"])
def event_dispatch_stream(spark, d):
    """The batch query as a stream, run to its end; a batch that repeats overwrites its own folder."""
    graph.settled(spark.range(1))
    import uuid

    root = f"{spark.sparkContext.getCheckpointDir()}/stream-{uuid.uuid4().hex}"
    events = spark.read.parquet(f"{d}/events.parquet")
    stream = spark.readStream.schema(events.schema).parquet(f"{d}/events.parquet*")
    routed = dispatch.route(D.as_events(stream))
    done = routed.writeStream.foreachBatch(dispatch.overwrite_batch(f"{root}/out")).option("checkpointLocation", f"{root}/offsets").trigger(availableNow=True).start()
    done.awaitTermination()
    return spark.read.parquet(f"{root}/out").drop("batch")


def _swept(spark, d) -> DataFrame:
    return D.table(spark, d, "events").groupBy(F.concat(F.lit("U"), F.col("user_id").cast("string")).alias("id")).agg(F.max(F.when(F.col("user_id") % 9 != 0, F.col("ts"))).alias("last_consolidated_at"))


SWEPT = "swept AS (SELECT 'U' || user_id AS id, max(CASE WHEN user_id % 9 <> 0 THEN ts END) AS last_ts FROM events GROUP BY user_id)"


@query("sweep_page", f"WITH {SWEPT} SELECT id FROM swept ORDER BY coalesce(last_ts, TIMESTAMP '1970-01-01'), id LIMIT 50")
def sweep_page(spark, d):
    return sweep.stalest(_swept(spark, d), 50).select("id")


@query("rotation_lag", f"WITH {SWEPT} SELECT 1800000000 - epoch(min(coalesce(last_ts, TIMESTAMP '1970-01-01')))::BIGINT AS lag_seconds, count(*) AS entities FROM swept")
def rotation_lag(spark, d):
    return sweep.rotation_lag(_swept(spark, d), F.timestamp_seconds(F.lit(1_800_000_000)))


LANGS = "['bg', 'cs', 'da', 'de', 'el', 'en', 'es', 'et', 'fi', 'fr', 'ga', 'hr', 'hu', 'it', 'lt', 'lv', 'mt', 'nl', 'pl', 'pt', 'ro', 'sk', 'sl', 'sv']"
SOURCE = "coalesce(name_lang, CASE country WHEN 'IRL' THEN 'en' WHEN 'FRA' THEN 'fr' WHEN 'DEU' THEN 'de' WHEN 'ESP' THEN 'es' WHEN 'BEL' THEN 'nl' END, 'en')"


@query("enrich_missing_langs", f"WITH {D.AUTHORITIES} SELECT id, {SOURCE} AS source_lang, array_to_string(list_filter({LANGS}, lambda x: x <> {SOURCE}), ',') AS missing FROM authority")
def enrich_missing_langs(spark, d):
    none = F.create_map().cast("map<string,string>")
    return D.authorities(spark, d).select("id", N.source_lang(F.col("name_lang"), F.col("country")).alias("source_lang"), F.array_join(N.missing_langs(none, F.col("name_lang"), F.col("country")), ",").alias("missing"))


@query("enrich_apply", f"WITH {D.AUTHORITIES} SELECT id, CASE WHEN name <> '' THEN 'enrich' ELSE 'noop' END AS status, CASE WHEN name <> '' THEN 23 ELSE 0 END AS n, CASE WHEN name <> '' AND {SOURCE} <> 'pt' THEN '[pt] ' || name ELSE name END AS name_pt FROM authority")
def enrich_apply(spark, d):
    rows = D.authorities(spark, d)
    made = apply.offline_translations(rows)
    done = apply.enrich(rows, made.select("id", "translations", F.lit(None).cast("array<float>").alias("embedding"), F.lit(None).cast("string").alias("encoder")))
    return done.join(made.select("id", "status").hint("merge"), "id").select("id", "status", F.size("translations").alias("n"), N.localized(F.col("name"), F.col("translations"), F.lit("pt-BR")).alias("name_pt"))
