"""Catalog of record, landscape, gate and workflow queries, each with its SQL where possible."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions import fixed_values as fv
from tessera.functions import text as tx
from tessera.operators import candidates, gates, landscape, records, workflow
from tessera.tables import table

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


# -- records ---------------------------------------------------------------------------------------


@query("""WITH u AS (SELECT page_id, CASE page_id % 4 WHEN 0 THEN ' https://doi.org/10.1/' || page_id || 'AbC ' WHEN 1 THEN 'DOI: 10.2/X' || page_id WHEN 2 THEN 'http://dx.doi.org/10.3/' || page_id ELSE '  ' END AS raw FROM pages)
SELECT page_id, nullif(lower(regexp_replace(trim(raw), '(?i)^(?:https?://(?:dx\\.)?doi\\.org/|doi:\\s*)', '')), '') AS doi FROM u""")
def doi_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("page_id")
    raw = F.when(i % 4 == 0, F.concat(F.lit(" https://doi.org/10.1/"), i, F.lit("AbC "))).when(i % 4 == 1, F.concat(F.lit("DOI: 10.2/X"), i)).when(i % 4 == 2, F.concat(F.lit("http://dx.doi.org/10.3/"), i)).otherwise("  ")
    return table(spark, sf_dir, "pages").select("page_id", tx.doi_normalise(raw).alias("doi"))


@query("SELECT page_id, regexp_replace(html, '<[^>]+>', ' ', 'g') AS text FROM pages")
def html_to_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", tx.strip_tags(F.col("html")).alias("text"))


@query()
def html_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", tx.decode_entities(tx.strip_tags(F.col("html"))).alias("text"))


@query("SELECT doc_id, nullif(array_to_string(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> ''), ' '), '') AS text FROM documents")
def inverted_index_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Word -> positions and back again, row by row."""
    words = F.expr("filter(split(text, '\\\\s+'), w -> w <> '')")
    index = table(spark, sf_dir, "documents").select("doc_id", tx.inverted_index(words).alias("index"))
    return index.select("doc_id", tx.abstract_of(F.col("index")).alias("text"))


_RANKED = "WITH h AS (SELECT doc_id, source, lang, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS r1, row_number() OVER (PARTITION BY lang ORDER BY n_chars, doc_id) AS r2 FROM documents), f AS (SELECT doc_id, 1.0::DOUBLE / (60 + r1) + 1.0::DOUBLE / (60 + r2) AS relevance FROM h)"


def _fused(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two ranked lists of documents: longest first by source, shortest first by language."""
    d = table(spark, sf_dir, "documents").select("doc_id", "source", "lang", "n_chars")
    hits = records.rrf(d, ["source"], [F.desc("n_chars"), F.col("doc_id")]).unionByName(records.rrf(d, ["lang"], [F.col("n_chars"), F.col("doc_id")]))
    return records.fuse(hits, "doc_id")


@query(f"{_RANKED} SELECT doc_id, round(relevance, 12) AS relevance, 2::BIGINT AS n_lists FROM f")
def rrf_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _fused(spark, sf_dir).select("doc_id", F.round("relevance", 12).alias("relevance"), "n_lists")


@query(f"{_RANKED}, k AS (SELECT doc_id, row_number() OVER (ORDER BY round(relevance, 12) DESC, doc_id) AS rn FROM f) SELECT doc_id, rn <= 40 AS included FROM k")
def topk_included(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = _fused(spark, sf_dir).select(F.col("doc_id").alias("position"), F.round("relevance", 12).alias("relevance"))
    return records.include_top(ranked).select(F.col("position").alias("doc_id"), "included")


def _records(spark: SparkSession, sf_dir: str, every_doi: bool) -> DataFrame:
    """Documents as records: copies share DOI, title and year."""
    d = table(spark, sf_dir, "documents")
    digest = F.md5(F.col("text").cast("binary"))
    doi = F.concat(F.lit("10.1/"), F.substring(digest, 1, 16))
    return d.select(F.col("doc_id").alias("position"), "source", F.array("source").alias("sources"), (doi if every_doi else F.when(F.col("doc_id") % 2 == 0, doi)).alias("doi"), F.substring_index("text", "\n", 1).alias("title"), F.lit(2020).alias("year"), F.col("n_chars").alias("cited_by"), F.array("lang").alias("concepts"))


@query("""SELECT min(doc_id) AS "position", '10.1/' || substr(md5(text), 1, 16) AS doi, array_to_string(list_sort(list_distinct(list(source))), ',') AS sources, max(n_chars) AS cited_by, count(*)::BIGINT AS members FROM documents GROUP BY text""")
def record_merge_doi(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = records.merge(_records(spark, sf_dir, True))
    return m.select("position", "doi", F.array_join("sources", ",").alias("sources"), "cited_by", "members")


@query(r"""WITH r AS (SELECT doc_id AS pos, source, lang, n_chars, CASE WHEN doc_id % 2 = 0 THEN '10.1/' || substr(md5(text), 1, 16) END AS doi, split_part(text, chr(10), 1) AS title, regexp_replace(lower(split_part(text, chr(10), 1)), '[^\p{L}\p{Nd}\p{Nl}\p{No}_]', '', 'g') AS k FROM documents),
w AS (SELECT *, min(pos) OVER b AS start, last_value(doi IGNORE NULLS) OVER b AS last FROM r WINDOW b AS (PARTITION BY k ORDER BY pos ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
h AS (SELECT doi, arg_min(CASE WHEN last IS NULL THEN coalesce(start, pos) ELSE pos END, pos) AS home FROM w WHERE doi IS NOT NULL GROUP BY doi),
c AS (SELECT w.*, coalesce(h.home, start, pos) AS cluster FROM w LEFT JOIN h ON h.doi = coalesce(w.doi, w.last))
SELECT cluster AS "position", arg_min(doi, pos) AS doi, arg_min(title, pos) AS title, array_to_string(list_sort(list(DISTINCT source)), ',') AS sources, max(n_chars) AS cited_by, count(*)::BIGINT AS members FROM c GROUP BY cluster""")
def record_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = records.merge(_records(spark, sf_dir, False))
    return m.select("position", "doi", "title", F.array_join("sources", ",").alias("sources"), "cited_by", "members")


@query("""SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, CASE WHEN a.doc_id IS NOT NULL THEN a.lang ELSE b.lang END AS lang, coalesce(nullif(a.source, ''), b.source) AS source,
 CASE WHEN a.doc_id IS NOT NULL AND b.doc_id IS NOT NULL THEN 'updated' WHEN a.doc_id IS NOT NULL THEN 'kept' ELSE 'added' END AS state
FROM (SELECT doc_id, lang, CASE WHEN lang = 'en' THEN '' ELSE source END AS source FROM documents) a FULL JOIN (SELECT page_id * 7 AS doc_id, 'xx' AS lang, url AS source FROM pages) b ON a.doc_id = b.doc_id""")
def upsert_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    stored = table(spark, sf_dir, "documents").select("doc_id", "lang", F.when(F.col("lang") == "en", "").otherwise(F.col("source")).alias("source"))
    incoming = table(spark, sf_dir, "pages").select((F.col("page_id") * 7).alias("doc_id"), F.lit("xx").alias("lang"), F.col("url").alias("source"))
    return records.upsert(stored, incoming, "doc_id", fill=["source"], keep=["lang"])


# -- landscape -------------------------------------------------------------------------------------

_STOP = ", ".join(f"'{w}'" for w in fv.STOPWORDS)
_TERMS = f"""WITH ti AS (SELECT doc_id, lower(split_part(text, chr(10), 1)) AS title FROM documents),
kw AS (SELECT doc_id, list_sort(list_distinct(list_filter(regexp_extract_all(title, '[a-z][a-z-]{{3,}}'), lambda w: w NOT IN ({_STOP})))) AS ks FROM ti),
te AS (SELECT doc_id, unnest(ks) AS term, unnest(range(len(ks))) AS pos FROM kw),
ct AS (SELECT term, count(*)::BIGINT AS c, min(doc_id * 10000 + pos) AS f FROM te GROUP BY term),
top AS (SELECT term, c, f FROM ct ORDER BY c DESC, f LIMIT 18)"""


def _terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("position"), F.substring_index("text", "\n", 1).alias("title"), F.array().cast("array<string>").alias("concepts"))
    return landscape.keyword_rows(d)


@query(f'{_TERMS} SELECT term, c AS "count" FROM top')
def keyword_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landscape.top_keywords(_terms(spark, sf_dir))


@query(f"""{_TERMS}, fe AS (SELECT te.* FROM te JOIN top USING (term)),
li AS (SELECT doc_id, list_sort(list(term)) AS t FROM fe GROUP BY doc_id),
nu AS (SELECT doc_id, unnest(t) AS term, unnest(range(len(t))) AS i FROM li),
pa AS (SELECT a.doc_id, a.term AS source, b.term AS target, a.i * 100 + b.i AS o FROM nu a JOIN nu b ON a.doc_id = b.doc_id AND a.i < b.i)
SELECT source, target, count(*)::BIGINT AS "count" FROM pa GROUP BY 1, 2 ORDER BY count(*) DESC, min(doc_id * 10000 + o) LIMIT 50""")
def keyword_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landscape.keyword_edges(_terms(spark, sf_dir))


@query("SELECT method, n::BIGINT AS n FROM (" + " UNION ALL ".join(f"SELECT '{m}' AS method, count(*) FILTER (regexp_matches(text, '(?i){p}')) AS n FROM documents" for m, p in fv.METHODS.items()) + ")")
def method_regex_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landscape.method_counts(table(spark, sf_dir, "documents"), F.col("text"))


@query("""WITH y AS (SELECT year(o_orderdate)::BIGINT AS y FROM orders), e AS (SELECT min(y) AS lo, greatest(1, ceil((max(y) - min(y) + 1) / 8.0))::BIGINT AS w FROM y)
SELECT floor((y - lo) / w)::INT AS bin, (lo + floor((y - lo) / w) * w)::BIGINT AS from_year, (lo + (floor((y - lo) / w) + 1) * w - 1)::BIGINT AS to_year, count(*)::BIGINT AS n FROM y, e GROUP BY ALL""")
def year_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landscape.year_histogram(table(spark, sf_dir, "orders").select(F.year("o_orderdate").alias("y")), "y")


@query("SELECT source, count(*)::BIGINT AS n FROM documents WHERE source IS NOT NULL GROUP BY source")
def source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landscape.source_counts(table(spark, sf_dir, "documents").select(F.array_compact(F.array("source")).alias("sources")))


_PAIRS = [("the", "and"), ("tion", "heit"), ("que", "les"), ("ción", "mente")]


@query(" UNION ALL ".join(f"SELECT '{a}' AS a, '{b}' AS b, (count(*) FILTER (contains(lower(text), '{a}') AND contains(lower(text), '{b}')))::BIGINT AS n FROM documents" for a, b in _PAIRS))
def pair_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return landscape.pair_coverage(table(spark, sf_dir, "documents"), F.col("text"), _PAIRS)


@query("SELECT doc_id FROM documents WHERE contains(lower(text), 'mail7') OR contains(lower(text), 'token') OR contains(lower(text), 'ñezco')")
def text_contains_any(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(tx.contains_any([F.col("text")], ["mail7", "Token", "ñezco"])).select("doc_id")


# -- gates -----------------------------------------------------------------------------------------

def grid_sql(orders: str = "orders") -> str:
    """A run for each customer with orders: an estimate from the priorities of the orders, its checks from
    their states, the rest from the customer's number."""
    return f"""SELECT CAST(o_custkey AS BIGINT) AS id, CAST(sum(CASE WHEN o_orderpriority IN ('1-URGENT', '2-HIGH') THEN 1 ELSE -1 END) AS DOUBLE) / count(*) AS coef, CAST(o_custkey % 20 AS DOUBLE) / 100 AS p, CAST(o_custkey % 7 AS DOUBLE) / 10 AS pretrend_p,
 count(*) AS n_checks, sum(CASE WHEN o_orderstatus <> 'F' THEN 1 ELSE 0 END) AS n_same_sign, CAST(o_custkey % 11 AS DOUBLE) / 100 AS permutation_p, o_custkey % 5 <> 0 AS consistent, CASE WHEN o_custkey % 2 = 0 THEN 'policy_causal' ELSE 'panel_association' END AS method_family,
 o_custkey % 3 = 0 AS real_assignment, CASE WHEN o_custkey % 3 = 0 THEN 'real_assignment' ELSE 'peer_exposure' END AS semantics FROM {orders} GROUP BY o_custkey"""


def grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(grid_sql("{orders}"), orders=table(spark, sf_dir, "orders"))


@query(f"""WITH s AS ({grid_sql()}), v AS (SELECT *, CASE WHEN NOT consistent THEN 'insufficient' WHEN NOT (coef > 0 AND p < 0.05) THEN 'not_supportive'
  WHEN (CASE WHEN n_checks > 0 THEN n_same_sign / n_checks ELSE 0 END) < 0.75 OR permutation_p >= 0.05 OR (method_family = 'policy_causal' AND pretrend_p < 0.1) THEN 'mixed' ELSE 'supportive' END AS verdict FROM s)
SELECT id, verdict, CASE verdict WHEN 'insufficient' THEN 'insufficient' WHEN 'not_supportive' THEN 'insufficient' WHEN 'mixed' THEN 'preliminary' ELSE
 CASE WHEN method_family = 'policy_causal' AND real_assignment AND semantics = 'real_assignment' THEN 'causal_cautious' ELSE 'associational' END END AS max_strength FROM v""")
def claim_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return gates.verdicts(grid(spark, sf_dir)).select("id", "verdict", "max_strength")


@query(f"""WITH t AS (SELECT doc_id, text || CASE doc_id % 3 WHEN 0 THEN ' It was caused by this, and PROMOTES growth.' WHEN 1 THEN ' This does not imply causality.' ELSE ' The effect of x led to y.' END AS text FROM documents),
c AS (SELECT doc_id, regexp_replace(text, '(?i){fv.DENIALS}', '', 'g') AS text FROM t)
SELECT doc_id, array_to_string(list_sort(list_distinct(regexp_extract_all(text, '(?i){fv.ENGLISH_CAUSAL}'))), '|') AS words FROM c""")
def wording_scan_en(spark: SparkSession, sf_dir: str) -> DataFrame:
    end = F.when(F.col("doc_id") % 3 == 0, " It was caused by this, and PROMOTES growth.").when(F.col("doc_id") % 3 == 1, " This does not imply causality.").otherwise(" The effect of x led to y.")
    d = table(spark, sf_dir, "documents").select("doc_id", gates.causal_words(F.concat("text", end)).alias("w"))
    return d.select("doc_id", F.array_join(F.array_sort("w"), "|").alias("words"))


@query()
def numeric_prose_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", gates.has_bare_number("text").alias("has_number"))


@query("SELECT c_custkey, 'Balance ' || round(c_acctbal, 2)::DECIMAL(18, 2)::VARCHAR || ' of ' || c_name || ', nation ' || c_nationkey || '.' AS text FROM customer")
def placeholder_inject(spark: SparkSession, sf_dir: str) -> DataFrame:
    numbers = F.create_map(F.lit("main.balance"), F.col("c_acctbal").cast("decimal(18,2)").cast("string"), F.lit("nation"), F.col("c_nationkey").cast("string"), F.lit("name"), F.col("c_name"))
    return table(spark, sf_dir, "customer").select("c_custkey", tx.inject(F.lit("Balance {{num:main.balance}} of {{num:name}}, nation {{num:nation}}."), numbers).alias("text"))


@query(r"SELECT doc_id, regexp_replace(replace(text, 'token = \"', 'token = \"sk-'), 'sk-[A-Za-z0-9_-]+', '[redacted]', 'g') AS text FROM documents".replace('\\"', '"'))
def secret_mask(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", tx.mask_secrets(F.replace("text", F.lit('token = "'), F.lit('token = "sk-'))).alias("text"))


# -- workflow --------------------------------------------------------------------------------------


@query("SELECT user_id, event_id, event_type, value FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1")
def latest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflow.latest(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "value"), "user_id", "event_id")


@query("SELECT c_custkey AS user_id, (coalesce(max(event_id), 0) + 1)::BIGINT AS next_version FROM customer LEFT JOIN events ON user_id = c_custkey GROUP BY c_custkey")
def next_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    parents = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("user_id"))
    return workflow.next_version(table(spark, sf_dir, "events"), parents, "user_id", "event_id")


_KINDS = ["direction", "candidate", "plan", "data"]
_TABLES = ["candidate_sets", "study_plans", "analysis_runs", "proposals"]
_REACH = ", ".join(f"('{e}', '{t}')" for e, ts in workflow.STALE.items() for t in ts)


@query(f"""WITH en AS (SELECT event_id AS id, user_id AS project_id, [{', '.join(f"'{t}'" for t in _TABLES)}][(event_id % 4 + 1)::INT] AS "table", event_id % 11 = 0 AS stale FROM events),
ev AS (SELECT DISTINCT user_id AS project_id, [{', '.join(f"'{k}'" for k in _KINDS)}][(user_id % 4 + 1)::INT] AS event FROM events WHERE user_id % 3 = 0),
re AS (SELECT * FROM (VALUES {_REACH}) r(event, tab)), hit AS (SELECT DISTINCT project_id, tab FROM ev JOIN re USING (event))
SELECT id, en.project_id, "table", stale OR hit.tab IS NOT NULL AS stale FROM en LEFT JOIN hit ON en.project_id = hit.project_id AND "table" = tab""")
def staleness_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = table(spark, sf_dir, "events")
    pick = lambda names, i: F.get(F.array(*[F.lit(n) for n in names]), i.cast("int"))
    entities = ev.select(F.col("event_id").alias("id"), F.col("user_id").alias("project_id"), pick(_TABLES, F.col("event_id") % 4).alias("table"), (F.col("event_id") % 11 == 0).alias("stale"))
    events = ev.where("user_id % 3 = 0").select(F.col("user_id").alias("project_id"), pick(_KINDS, F.col("user_id") % 4).alias("event")).distinct()
    return workflow.cascade(events, entities)


_STATE = """SELECT c_custkey AS project_id, CASE WHEN c_custkey % 7 = 0 THEN '  ' ELSE c_name END AS direction, c_custkey % 4 AS n_included,
 CASE c_custkey % 3 WHEN 0 THEN 'running' WHEN 1 THEN 'failed' END AS search_status, CASE c_custkey % 5 WHEN 0 THEN 'generating' WHEN 1 THEN 'ready' WHEN 2 THEN 'ready' WHEN 3 THEN 'failed' END AS set_status,
 c_custkey % 13 = 0 AS set_stale, c_custkey % 2 = 0 AS selected, c_custkey % 17 = 0 AS selected_stale, CASE c_custkey % 4 WHEN 0 THEN 'confirmed' WHEN 1 THEN 'draft' END AS plan_status, c_custkey % 11 = 0 AS plan_stale,
 CASE c_custkey % 6 WHEN 0 THEN 'succeeded' WHEN 1 THEN 'failed' WHEN 2 THEN 'queued' END AS run_status, c_custkey % 19 = 0 AS run_stale, c_custkey % 23 = 0 AS step_failed, c_custkey % 3 = 1 AS binding_confirmed,
 c_custkey % 5 = 1 AS proposal, c_custkey % 10 = 1 AS proposal_stale, c_custkey % 15 = 1 AS proposal_confirmed, CASE WHEN c_custkey % 29 = 0 THEN 'plan' WHEN c_custkey % 31 = 0 THEN 'dataset' WHEN c_custkey % 37 = 0 THEN 'proposal' ELSE 'none' END AS job FROM customer"""

_STAGE_SQL = {
    "direction": "CASE WHEN trim(direction) <> '' THEN 'completed' ELSE 'not_started' END",
    "literature": "CASE WHEN search_status = 'running' THEN 'running' WHEN n_included > 0 THEN 'completed' WHEN search_status = 'failed' THEN 'failed' ELSE 'not_started' END",
    "candidates": "CASE WHEN selected_stale OR set_stale THEN 'stale' WHEN set_status = 'generating' THEN 'running' WHEN set_status = 'ready' THEN CASE WHEN selected THEN 'completed' ELSE 'awaiting_selection' END WHEN set_status IS NOT NULL THEN 'failed' ELSE 'not_started' END",
    "plan": "CASE WHEN plan_stale THEN 'stale' WHEN job = 'plan' THEN 'running' WHEN plan_status = 'confirmed' THEN 'completed' WHEN plan_status IS NOT NULL THEN 'draft' ELSE 'not_started' END",
    "data": "CASE WHEN run_stale THEN 'stale' WHEN job = 'dataset' THEN 'running' WHEN run_status = 'failed' OR step_failed THEN 'failed' WHEN run_status = 'succeeded' THEN 'completed' WHEN binding_confirmed THEN 'ready' ELSE 'not_started' END",
    "proposal": "CASE WHEN job = 'proposal' THEN 'running' WHEN proposal_stale THEN 'stale' WHEN proposal_confirmed THEN 'confirmed' WHEN proposal THEN 'completed' ELSE 'not_started' END",
}


def _projects(spark: SparkSession, sf_dir: str) -> DataFrame:
    table(spark, sf_dir, "customer").createOrReplaceTempView("tessera_customer")
    return spark.sql(_STATE.replace("FROM customer", "FROM tessera_customer")).withColumn("active", F.array("job"))


def _status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflow.stage_status(_projects(spark, sf_dir))


@query(f"WITH s AS ({_STATE}) " + " UNION ALL ".join(f"SELECT project_id, {i}::INT AS seq, '{k}' AS stage, {v} AS status FROM s" for i, (k, v) in enumerate(_STAGE_SQL.items())))
def stage_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _status(spark, sf_dir)


@query(f"WITH s AS ({_STATE}), a AS (" + " UNION ALL ".join(f"SELECT project_id, {i} AS seq, '{k}' AS stage, {v} AS status FROM s" for i, (k, v) in enumerate(_STAGE_SQL.items())) + "), b AS (SELECT *, status IN ('completed', 'confirmed') AS done FROM a) SELECT project_id, (count(*) FILTER (done))::BIGINT AS n_done, arg_min(stage, seq) FILTER (status IN ('not_started', 'awaiting_selection', 'draft', 'stale', 'failed', 'ready')) AS next_stage FROM b GROUP BY project_id")
def stage_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflow.project_flow(_projects(spark, sf_dir))


@query("SELECT event_type, count(*)::BIGINT AS n_calls, sum(event_id % 100)::BIGINT AS input_tokens, sum(user_id % 50)::BIGINT AS output_tokens FROM events GROUP BY event_type")
def usage_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    calls = table(spark, sf_dir, "events").select("event_type", (F.col("event_id") % 100).alias("input_tokens"), (F.col("user_id") % 50).alias("output_tokens"))
    return workflow.usage(calls, ["event_type"])


_FLOW_SQL = f"""WITH s AS ({_STATE}), a AS (""" + " UNION ALL ".join(f"SELECT project_id, {i} AS seq, '{k}' AS stage, {v} AS status FROM s" for i, (k, v) in enumerate(_STAGE_SQL.items())) + """),
b AS (SELECT *, first_value(CASE WHEN status IN ('not_started', 'failed', 'awaiting_selection', 'draft') THEN seq END IGNORE NULLS) OVER (PARTITION BY project_id ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS f FROM a)
SELECT b.project_id, b.stage, a.stage AS blocker, a.status AS blocker_status FROM b JOIN a ON a.project_id = b.project_id AND a.seq = b.f WHERE b.status = 'not_started'"""


_DERIVED = {"confirmed_version": "CAST((project_id + seq) % 3 AS INT)", "editing": "(project_id * 3 + seq) % 17 = 0", "local_stale": "(project_id + 5 * seq) % 13 = 0", "data_ok": "project_id % 2 = 0"}


# stage after stage, by recursion
@query(f"""WITH RECURSIVE s AS ({_STATE}), a AS (""" + " UNION ALL ".join(f"SELECT project_id, {i}::INT AS seq, '{k}' AS stage, {v} AS status FROM s" for i, (k, v) in enumerate(_STAGE_SQL.items())) + f"""),
x AS (SELECT *, {', '.join(f'{v} AS {k}' for k, v in _DERIVED.items())}, stage = 'data' AND project_id % 2 = 0 AS lenient, EXISTS (SELECT 1 FROM a l WHERE l.project_id = a.project_id AND l.seq > a.seq AND l.status <> 'not_started') AS later FROM a),
r AS (SELECT project_id, -1 AS seq, '' AS stage, '' AS flow, true AS opened, false AS lenient FROM s UNION ALL
 SELECT project_id, seq, stage, CASE WHEN editing THEN 'active' WHEN status = 'stale' OR local_stale THEN CASE WHEN passed THEN 'stale' ELSE 'locked' END
  WHEN status = 'confirmed' OR ((status = 'completed' OR (lenient AND status = 'failed')) AND (confirmed_version > 0 OR later)) THEN 'confirmed' WHEN passed THEN 'active' ELSE 'locked' END AS flow, passed, lenient
 FROM (SELECT x.*, r.opened AND r.flow <> 'locked' AND NOT (r.flow = 'active' AND NOT r.lenient) AS passed FROM r JOIN x ON x.project_id = r.project_id AND x.seq = r.seq + 1))
SELECT project_id, seq::INT AS seq, stage, flow, (SELECT count(*) FROM r l WHERE l.project_id = r.project_id AND l.seq > r.seq AND l.flow IN ('confirmed', 'stale'))::BIGINT AS downstream FROM r WHERE seq >= 0""")
def derived_flow(spark: SparkSession, sf_dir: str) -> DataFrame:
    status = _status(spark, sf_dir).withColumns({k: F.expr(v) for k, v in _DERIVED.items()})
    return workflow.derive_flow(status)


@query(_FLOW_SQL)
def stage_locks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return workflow.lock_reasons(_status(spark, sf_dir))


@query("""WITH s AS (SELECT c_custkey AS id, c_nationkey AS set_id, c_custkey % 7 AS n_evidence, c_custkey % 2 = 0 AS identified, CASE c_custkey % 3 WHEN 0 THEN 'feasible_limited_increment' WHEN 1 THEN 'balanced' ELSE 'ambitious' END AS positioning, c_custkey % 6 AS n_risks FROM customer),
t AS (SELECT *, greatest(10, least(98, 45 + least(4, n_evidence) * 8 + CASE WHEN identified THEN 12 ELSE 0 END + CASE positioning WHEN 'feasible_limited_increment' THEN 8 WHEN 'balanced' THEN 4 ELSE 0 END - least(4, n_risks) * 4))::INT AS score FROM s)
SELECT set_id, id AS recommended, score FROM (SELECT *, row_number() OVER (PARTITION BY set_id ORDER BY score DESC, id) AS rn FROM t) WHERE rn = 1""")
def candidate_choice(spark: SparkSession, sf_dir: str) -> DataFrame:
    i = F.col("c_custkey")
    c = table(spark, sf_dir, "customer").select(i.alias("id"), F.col("c_nationkey").alias("set_id"), i.alias("seq"), F.sequence(F.lit(0), i % 7).alias("e"), F.when(i % 2 == 0, "x").alias("identification"), F.when(i % 3 == 0, "feasible_limited_increment").when(i % 3 == 1, "balanced").otherwise("ambitious").alias("positioning"), F.sequence(F.lit(0), i % 6).alias("r"))
    c = c.select("id", "set_id", "seq", "identification", "positioning", F.slice("e", 2, 9).alias("evidence_ids"), F.slice("r", 2, 9).alias("risks"), F.lit("").alias("title"), F.lit("").alias("recommendation_text"))
    return candidates.recommended(c).select("set_id", F.col("id").alias("recommended"), "score")
