"""Whole dataflows: cached search, page views, extraction and linking of activities, queue board, orders and caps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayspark.functions import chem
from assayspark.functions import geometry as G
from assayspark.functions import text as T
from assayspark.operators import evidence as E
from assayspark.operators import library as L
from assayspark.operators import matching as M
from assayspark.operators import relational as R
from assayspark.operators import search as S
from assayspark.operators import sections as X
from assayspark.sources import files
from assayspark.streaming import logs

from .registry import Tables, query
from .text_plans import QUERY

_TERMS = sorted(set(QUERY.split()))


def _hits(terms: list[str]) -> str:
    return " + ".join(f"(length(low) - length(replace(low, '{t}', ''))) // {len(t)}" for t in terms)


@query(f"""
WITH d AS (SELECT doc_id, lower(text) AS low FROM documents), h AS (SELECT doc_id, ({_hits(_TERMS)})::BIGINT AS a, ({_hits(["of"])})::BIGINT AS b FROM d),
one AS (SELECT doc_id, least(a / 40.0::DOUBLE, 1.0::DOUBLE) AS score, row_number() OVER (ORDER BY least(a / 40.0::DOUBLE, 1.0::DOUBLE) DESC, doc_id) AS place FROM h WHERE a > 0),
two AS (SELECT doc_id, least(b / 10.0::DOUBLE, 1.0::DOUBLE) AS score, 1 AS place FROM h WHERE b > 0 AND doc_id = 8)
SELECT 1::BIGINT AS query_id, place::INT AS place, doc_id, score, false AS from_cache FROM one WHERE place <= 10
UNION ALL SELECT 2, place, doc_id, score, false FROM two UNION ALL SELECT 2, 0, NULL, 1.0, false
UNION ALL SELECT 3, 1, 77, 0.5, true""")
def kb_cached_search(t: Tables) -> DataFrame:
    """One query that misses, one with a filter and an answer row, one that is cached for other letters of the same words."""
    queries = t.spark.createDataFrame([(1, QUERY, None), (2, "of", 8), (3, "  Cached WORDS ", None)], "query_id long, query string, doc_filter long")
    key = T.query_key(F.lit("cached words"), F.lit("10"), F.lit(""))
    cache = t.spark.range(1).select(key.alias("query_hash"), F.lit(1).alias("place"), F.lit(77).cast("long").alias("doc_id"), F.lit(0.5).alias("score"))
    return S.cached_search(t.documents, queries, cache, k=10, answers=queries.where("query_id = 2").select("query_id"))[0]


@query("""
WITH p AS (SELECT conv_id AS doc_id, turn AS page, text FROM conversations),
d AS (SELECT user_id AS doc_id, event_id % 4 AS page, count(*) AS n FROM events WHERE event_type = 'view' GROUP BY 1, 2),
l AS (SELECT user_id AS doc_id, event_id % 4 AS page, count(*) AS n, min(event_id) AS first_label FROM events WHERE event_type = 'click' GROUP BY 1, 2)
SELECT p.doc_id, p.page::BIGINT AS page, length(CASE WHEN trim(text) <> '' THEN text END)::INT AS n_text, coalesce(d.n, 0)::INT AS n_molecules, coalesce(l.n, 0)::INT AS n_labels, l.first_label
FROM p LEFT JOIN d ON d.doc_id = p.doc_id AND d.page = p.page LEFT JOIN l ON l.doc_id = p.doc_id AND l.page = p.page""")
def page_parse_view(t: Tables) -> DataFrame:
    pages = t.conversations.select(F.col("conv_id").alias("doc_id"), F.col("turn").cast("long").alias("page"), "text")
    rows = t.events.select(F.col("user_id").alias("doc_id"), (F.col("event_id") % 4).alias("page"), F.col("event_id").alias("id"), "event_type")
    of = lambda kind: rows.where(F.col("event_type") == kind).drop("event_type")
    v = E.page_view(pages, of("view"), of("click"), of("error"))
    n = lambda c: F.coalesce(F.size(c), F.lit(0))
    return v.select("doc_id", "page", F.length(F.get("structured_text", F.lit(0))["content"]).alias("n_text"), n("molecules").alias("n_molecules"), n("labels").alias("n_labels"), F.get("labels", F.lit(0))["id"].alias("first_label"))


@query("""
WITH c AS (SELECT o_custkey // 10 AS doc_id, o_orderkey AS cand_id, lower(o_orderpriority) AS v, o_custkey % 7 + 1 AS page, row_number() OVER (PARTITION BY o_custkey // 10, o_orderpriority ORDER BY o_orderkey) AS n FROM orders),
r AS (SELECT o_custkey // 10 AS doc_id, o_orderkey AS rec_id, CASE WHEN o_orderstatus = 'F' THEN lower(o_orderpriority) ELSE 'none' END AS v, o_orderkey % 5 + 2 AS page, o_totalprice AS confidence FROM orders),
k AS (SELECT *, row_number() OVER (PARTITION BY doc_id, v ORDER BY rec_id) AS n FROM r),
a AS (SELECT c.doc_id, c.cand_id, k.rec_id FROM c JOIN k ON c.doc_id = k.doc_id AND c.v = k.v AND c.n = k.n),
f AS (SELECT doc_id, page, min(cand_id) AS cand_id FROM c WHERE NOT EXISTS (SELECT 1 FROM a WHERE a.doc_id = c.doc_id AND a.cand_id = c.cand_id) GROUP BY 1, 2),
b AS (SELECT doc_id, page, arg_max(rec_id, (confidence, -rec_id)) AS rec_id FROM r GROUP BY 1, 2)
SELECT doc_id, cand_id, rec_id, 'table_row' AS kind FROM a UNION ALL SELECT f.doc_id, f.cand_id, b.rec_id, 'table' FROM f JOIN b ON b.doc_id = f.doc_id AND b.page = f.page""")
def activity_linking(t: Tables) -> DataFrame:
    """Rows first, then the page: candidates that no table row names take their page's most confident record."""
    o = t.orders
    c = o.select(F.floor(F.col("o_custkey") / 10).alias("doc_id"), F.col("o_orderkey").alias("cand_id"), F.col("o_orderpriority").alias("name"), F.lit("").alias("canonical"), F.lit("").alias("esmiles"), (F.col("o_custkey") % 7 + 1).alias("page"))
    label = F.when(F.col("o_orderstatus") == "F", F.lower("o_orderpriority")).otherwise("none")
    r = o.select(F.floor(F.col("o_custkey") / 10).alias("doc_id"), F.col("o_orderkey").alias("rec_id"), F.lit(0).alias("table_idx"), F.col("o_orderkey").cast("int").alias("row_idx"), label.alias("row_label"), F.lit(None).cast("string").alias("row_smiles"), (F.col("o_orderkey") % 5 + 2).alias("page_num"), F.col("o_totalprice").alias("confidence"))
    return M.linked_activities(c, r)


@query("""
WITH p AS (SELECT p_partkey, p_brand, p_size, p_retailprice, row_number() OVER (PARTITION BY p_brand ORDER BY p_partkey) AS n FROM part)
SELECT p_brand AS doc_id, p_partkey AS rec_id, (n + 1)::INT AS row_idx, 1 AS col_idx, CASE WHEN p_size % 2 = 0 THEN p_retailprice * 1000 ELSE p_retailprice END AS nm FROM p""")
def activity_extraction(t: Tables) -> DataFrame:
    """A table for each brand (name and value), found in its markdown; each record is located in it and brought to nanomolar."""
    line = F.concat(F.lit("| part "), F.col("p_partkey").cast("string"), F.lit(" | "), F.col("p_retailprice").cast("string"), F.lit(" |"))
    rows = F.transform(F.sort_array(F.collect_list(F.struct("p_partkey", line.alias("line")))), lambda x: x["line"])
    text = F.array_join(F.concat(F.array(F.lit("<!-- PAGE 2 -->"), F.lit("| name | value |"), F.lit("|---|---|")), rows), "\n")
    docs = t.part.groupBy(F.col("p_brand").alias("doc_id")).agg(text.alias("text"))
    found = X.table_rows(X.tables(docs))
    unit = F.when(F.col("p_size") % 2 == 0, F.lit("uM")).otherwise(F.lit("nM"))
    from assayspark.functions import units as U

    records = t.part.select(F.col("p_brand").alias("doc_id"), F.col("p_partkey").alias("rec_id"), F.lit(0).cast("long").alias("table_idx"), F.concat(F.lit("Part "), F.col("p_partkey").cast("string")).alias("row_label"), F.lit(None).cast("string").alias("row_smiles"), F.col("p_retailprice").alias("value_original"), U.to_nm(F.col("p_retailprice"), unit).alias("nm"))
    return X.located(records, found).select("doc_id", "rec_id", "row_idx", "col_idx", "nm")


@query("""
WITH s AS (SELECT user_id AS task, arg_max(event_type, event_id) AS status, max(event_id) AS last_id FROM events GROUP BY 1)
SELECT task, status, row_number() OVER (ORDER BY CASE status WHEN 'error' THEN 0 WHEN 'click' THEN 1 WHEN 'view' THEN 2 ELSE 3 END, last_id DESC, task) AS position,
       (SELECT count(*) FROM s x WHERE x.status = s.status) AS n_status FROM s WHERE status <> 'purchase'""")
def queue_board(t: Tables) -> DataFrame:
    """The newest state of each task without those that are done, in the board's order, with how many have the same state."""
    state = logs.latest_per_task(t.events.select(F.col("event_id").alias("id"), F.col("user_id").alias("task"), F.col("event_type").alias("level"), "value"))
    shown = state.where("level != 'purchase'").select("task", F.col("level").alias("status"), F.col("id").alias("last_id"))
    n = shown.groupBy("status").agg(F.count("*").alias("n_status"))
    out = R.ranked(shown, [R.status_rank("status", ["error", "click", "view"]), F.desc("last_id"), F.asc("task")])
    return out.join(n, "status").select("task", "status", "position", "n_status")


@query("""
SELECT c_custkey AS doc_id, c_name AS title, row_number() OVER (ORDER BY c_acctbal DESC, c_custkey) AS position FROM customer
WHERE c_nationkey = 3 AND (contains(lower(c_name), '1') OR contains(lower(c_mktsegment), '1'))""")
def collection_documents_search(t: Tables) -> DataFrame:
    docs = t.customer.select(F.col("c_custkey").alias("doc_id"), F.col("c_name").alias("title"), F.col("c_mktsegment").alias("path"), F.col("c_acctbal").alias("created_at"))
    members = t.customer.select(F.col("c_nationkey").alias("collection_id"), F.col("c_custkey").alias("doc_id"))
    found = R.where_contains(L.documents_of(docs, members, 3), "1", ["title", "path"])
    return R.ranked(found, [F.desc("created_at"), F.asc("doc_id")]).select("doc_id", "title", "position")


@query("""
SELECT n_nationkey AS collection_id, (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS doc_count, row_number() OVER (ORDER BY n_regionkey, n_name, n_nationkey) AS position FROM nation""")
def collection_list_order(t: Tables) -> DataFrame:
    collections = t.nation.select(F.col("n_nationkey").alias("collection_id"), F.col("n_name").alias("name"), F.col("n_regionkey").alias("sort_order"))
    return L.collection_list(collections, t.customer.select(F.col("c_nationkey").alias("collection_id"))).select("collection_id", "doc_count", "position")


@query("""
SELECT event_id, row_number() OVER (ORDER BY CASE WHEN event_id % 3 > 0 THEN event_id % 11 END ASC NULLS LAST, value DESC, event_id) AS position FROM events""")
def page_then_score_order(t: Tables) -> DataFrame:
    page = F.when(F.col("event_id") % 3 > 0, F.col("event_id") % 11)
    return R.ranked(t.events.select("event_id", page.alias("page"), "value"), [F.asc_nulls_last("page"), F.desc("value"), F.asc("event_id")]).select("event_id", "position")


@query("""
SELECT p_partkey FROM part WHERE list_contains(regexp_split_to_array(lower(p_name || ' ' || p_type), '[^a-z0-9]+'), 'small') ORDER BY p_partkey LIMIT 20""")
def molecule_text_search_top_k(t: Tables) -> DataFrame:
    return S.index_search(S.inverted_index(t.part, "p_partkey", ["p_name", "p_type"]), "p_partkey", "small!", k=20)


@query("""
SELECT event_id, row_number() OVER (ORDER BY user_id, event_id % 5, event_id) AS position FROM events WHERE event_type = 'error' OR (event_id % 9)::VARCHAR = 'error'
UNION ALL SELECT event_id, 0 FROM events WHERE (event_id % 9)::VARCHAR = '4' AND event_type <> 'error'""")
def coref_occurrences(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", F.col("user_id").alias("doc_id"), (F.col("event_id") % 5).alias("page"), F.col("event_id").alias("id"), F.col("event_type").alias("mol_smiles"), (F.col("event_id") % 9).cast("string").alias("label_text"))
    first = R.ranked(E.occurrences(rows, "error"), [F.asc("doc_id"), F.asc("page"), F.asc("id")]).select("event_id", "position")
    return first.unionByName(E.occurrences(rows, "4").where("mol_smiles != 'error'").select("event_id", F.lit(0).cast("long").alias("position")))


@query("""
SELECT event_id, 0.3 AS asked FROM events WHERE (event_id % 100) / 100.0 >= 0.5 UNION ALL SELECT event_id, 0.8 FROM events WHERE (event_id % 100) / 100.0 >= 0.8""")
def detector_score_gates(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", ((F.col("event_id") % 100) / 100.0).alias("confidence"))
    return E.gated(rows, 0.3).select("event_id", F.lit(0.3).alias("asked")).unionByName(E.gated(rows, 0.8).select("event_id", F.lit(0.8).alias("asked")))


@query("""
SELECT page_id, CASE WHEN page_id % 4 > 0 THEN '/api/v1/library/documents/' || page_id || '/crop?rel_path=' || string_split(url, '/')[-1] || '&library_root=lib' END AS crop_url FROM pages""")
def crop_urls(t: Tables) -> DataFrame:
    path = F.when(F.col("page_id") % 4 > 0, F.col("url")).otherwise("")
    return t.pages.select("page_id", E.crop_url(F.col("page_id"), path, "lib").alias("crop_url"))


@query("""
SELECT event_id, label_text FROM (SELECT event_id, event_id % 40 AS label_id FROM events) LEFT JOIN (SELECT n_nationkey AS label_id, n_name AS label_text FROM nation) USING (label_id)""")
def prediction_labels(t: Tables) -> DataFrame:
    predictions = t.events.select("event_id", (F.col("event_id") % 40).alias("label_id"))
    return M.with_labels(predictions, t.nation.select(F.col("n_nationkey").cast("long").alias("label_id"), F.col("n_name").alias("text"))).select("event_id", "label_text")


@query("""
SELECT p_partkey, k::INT AS k, string_split(p_name, ' ')[k + 1] AS a, string_split(p_type, ' ')[k + 1] AS b
FROM (SELECT *, unnest(range(0, greatest(len(string_split(p_name, ' ')), len(string_split(p_type, ' '))))) AS k FROM part)""")
def positional_zip(t: Tables) -> DataFrame:
    both = M.zipped(F.split("p_name", " "), F.split("p_type", " "), strict=False)
    return t.part.select("p_partkey", F.posexplode(both).alias("k", "x")).select("p_partkey", "k", "x.a", "x.b")


@query("""
WITH m AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id % 6, coalesce(CASE WHEN event_id % 4 > 0 THEN event_id % 17 END, 9999), event_id) AS n FROM events)
SELECT event_id, n::INT AS position, CASE WHEN event_id % 5 = 0 THEN 'own' ELSE 'Mol_' || lpad(n::VARCHAR, greatest(3, length(n::VARCHAR))::INT, '0') END AS name FROM m""")
def sequential_names(t: Tables) -> DataFrame:
    span = F.when(F.col("event_id") % 4 > 0, F.col("event_id") % 17)
    rows = t.events.select("event_id", F.col("user_id").alias("doc_id"), (F.col("event_id") % 6).alias("page"), span.alias("span_idx"), F.col("event_id").alias("ord"), F.when(F.col("event_id") % 5 == 0, "own").otherwise("").alias("name"))
    return E.numbered_names(rows).select("event_id", "position", "name")


@query("""
WITH p AS (SELECT DISTINCT user_id AS doc_id, event_id % 3 AS page FROM events)
SELECT doc_id, page, (SELECT count(*) FROM events e WHERE e.user_id = p.doc_id AND e.event_id % 3 = p.page AND event_type = 'click') AS labels_written,
       (SELECT count(*) FROM events e WHERE e.user_id = p.doc_id AND e.event_id % 3 = p.page AND event_type = 'error') AS predictions_written FROM p""")
def page_write_counters(t: Tables) -> DataFrame:
    rows = t.events.select(F.col("user_id").alias("doc_id"), (F.col("event_id") % 3).alias("page"), "event_type")
    return E.page_counters(rows.select("doc_id", "page").distinct(), rows.where("event_type = 'click'"), rows.where("event_type = 'error'"))


@query("""
SELECT 'detections' AS name, count(*) AS n FROM events WHERE user_id <> 7 UNION ALL SELECT 'molecules', count(*) FROM part
UNION ALL SELECT 'cleared', count(*) FROM events WHERE user_id = 7 UNION ALL SELECT 'cleared_all', count(*) FROM events""")
def document_compensation(t: Tables) -> DataFrame:
    """A failed document's rows taken back while molecules stay, and what clearing its cache, or all of it, reports."""
    detections = t.events.select(F.col("user_id").alias("doc_id"), "event_id")
    kept = L.compensated({"molecule_detections": detections, "molecules": t.part.select(F.col("p_partkey").alias("mol_id"))}, 7)
    n = L.row_counts({"detections": kept["molecule_detections"], "molecules": kept["molecules"]})
    gone = lambda name, doc: L.cleared(detections, doc)[1].select(F.lit(name).alias("name"), F.col("cleared").alias("n"))
    return n.unionByName(gone("cleared", 7)).unionByName(gone("cleared_all", None))


@query("""SELECT 'molecules' AS name, 'copied' AS what, (SELECT count(*) FROM region) + (SELECT count(*) FROM nation) AS n UNION ALL SELECT 'molecules', 'missing', 0""")
def migration_validation(t: Tables) -> DataFrame:
    """What a dry run counts, and that no key of either side is missing after the migration."""
    base = {"molecules": t.nation.select("n_nationkey", "n_name")}
    old = {"molecules": t.region.select((F.col("r_regionkey") + 100).alias("n_nationkey"), F.col("r_name").alias("n_name")).union(t.nation.select("n_nationkey", "n_name"))}
    keys = {"molecules": ["n_nationkey"]}
    out = L.migrated(base, old, keys)
    return L.row_counts(old).withColumn("what", F.lit("copied")).unionByName(L.missing_rows(base, old, out, keys).withColumn("what", F.lit("missing")))


@query("""
WITH d AS (SELECT doc_id, md5(text) AS md5, octet_length(encode(text)) AS size FROM documents WHERE text IS NOT NULL),
f AS (SELECT md5, min(printf('%08d', doc_id)) AS first FROM d WHERE size <= 20000 GROUP BY 1), s AS (SELECT DISTINCT md5 FROM d WHERE doc_id % 10 = 0)
SELECT d.doc_id, CASE WHEN size > 20000 THEN 'too_large' WHEN d.md5 IN (SELECT md5 FROM s) OR printf('%08d', d.doc_id) <> f.first THEN 'duplicate' ELSE 'accepted' END AS outcome FROM d LEFT JOIN f ON f.md5 = d.md5""")
def upload_outcomes(t: Tables) -> DataFrame:
    """Every document as an upload, with a cap of 20 000 bytes; every tenth is stored already."""
    raw = t.documents.where("text IS NOT NULL").select(F.format_string("%08d", "doc_id").alias("name"), F.col("text").cast("binary").alias("content"))
    stored = t.documents.where("doc_id % 10 = 0").select(F.md5(F.col("text").cast("binary")).alias("md5"))
    return files.uploads(raw, stored, 20_000).select(F.col("name").cast("long").alias("doc_id"), "outcome")


@query("""
SELECT p_partkey, CASE WHEN p_partkey % 2 = 0 THEN '[["C",' || p_size || '],["H",' || (2 * p_size) || '],["O",1]]'
  ELSE '[["Ca",1],[[["O",1],["H",' || p_size || ']],2],["R1",1]]' END AS pairs FROM part""")
def condensed_formulas(t: Tables) -> DataFrame:
    n = F.col("p_size").cast("string")
    formula = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("C"), n, F.lit("H"), (F.col("p_size") * 2).cast("string"), F.lit("O"))).otherwise(F.concat(F.lit("Ca(OH"), n, F.lit(")2R1")))
    return t.part.select("p_partkey", chem.condensed(formula).alias("pairs"))


@query("""
SELECT event_id AS node, (value - min(value) OVER w) / greatest(max(value) OVER w - min(value) OVER w, 1e-6) AS x,
       (max(event_id % 13) OVER w - event_id % 13) / greatest(max(event_id % 13) OVER w - min(event_id % 13) OVER w, 1e-6) AS y FROM events WINDOW w AS (PARTITION BY user_id)""")
def nodes_scaled(t: Tables) -> DataFrame:
    rows = t.events.select(F.col("user_id").alias("mol_id"), F.col("event_id").alias("node"), F.col("value").alias("x"), (F.col("event_id") % 13).cast("double").alias("y"))
    return G.nodes_scaled(rows).select("node", "x", "y")


@query("""
WITH r AS (SELECT 'summaries' AS kind, event_id AS id, round(value) AS score FROM events WHERE event_type = 'view'
  UNION ALL SELECT 'sources', event_id, round(value) FROM events WHERE event_type = 'click' UNION ALL SELECT 'concepts', event_id, round(value) FROM events WHERE event_type = 'error')
SELECT kind, id, score FROM r ORDER BY score DESC, CASE kind WHEN 'summaries' THEN 0 WHEN 'sources' THEN 1 ELSE 2 END, id LIMIT 50""")
def search_over_sources(t: Tables) -> DataFrame:
    of = lambda kind: t.events.where(F.col("event_type") == kind).select(F.col("event_id").alias("id"), F.round("value").alias("score"))
    return S.ordered_by_source(S.sources_together({"concepts": of("error"), "summaries": of("view"), "sources": of("click")}), 50)


@query("""
WITH e AS (SELECT user_id AS task, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS poll, CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END AS n_rows, event_id % 2 = 0 AS active FROM events),
l AS (SELECT *, poll - coalesce(max(CASE WHEN n_rows > 0 THEN poll END) OVER (PARTITION BY task ORDER BY poll), 0) AS empty FROM e)
SELECT task, min(poll)::INT AS poll FROM l WHERE empty > 5 AND NOT active GROUP BY 1""")
def log_tail_end(t: Tables) -> DataFrame:
    from pyspark.sql import Window as W

    poll = F.row_number().over(W.partitionBy("user_id").orderBy("event_id"))
    polls = t.events.select(F.col("user_id").alias("task"), poll.alias("poll"), (F.col("event_type") == "purchase").cast("int").alias("n_rows"), (F.col("event_id") % 2 == 0).alias("active"))
    return logs.tail_ends(polls)


@query("""
WITH l AS (SELECT user_id AS name, arg_max(event_type, ts) AS last, max(ts) AS ts FROM events GROUP BY 1)
SELECT name, ts FROM l WHERE last = 'error' AND ts > (SELECT max(ts) FROM events) - INTERVAL 1 DAY""")
def cooling_services(t: Tables) -> DataFrame:
    now = t.events.agg(F.max("ts")).scalar()
    return logs.cooling(t.events.select(F.col("user_id").alias("name"), "ts", (F.col("event_type") != "error").alias("ok")), now, "1 day")


@query("""
WITH e AS (SELECT user_id AS run, event_id AS seq, event_type AS kind, CASE WHEN event_id % 7 = 0 THEN '' ELSE repeat(event_type, (event_id % 100)::INT) END AS content, event_id % 3 = 0 AS recoverable FROM events),
f AS (SELECT *, min(CASE WHEN kind = 'error' THEN seq END) OVER (PARTITION BY run) AS stop FROM e), s AS (SELECT * FROM f WHERE stop IS NULL OR seq <= stop)
SELECT run, seq, CASE kind WHEN 'view' THEN 'chunk' WHEN 'click' THEN 'tool_call' WHEN 'purchase' THEN 'tool_result' ELSE 'error' END AS type, CASE WHEN kind = 'click' THEN 'search' END AS tool,
  CASE WHEN kind = 'purchase' THEN left(content, 500) WHEN kind = 'error' AND NOT recoverable THEN 'Internal error' ELSE content END AS content
FROM s WHERE kind IN ('click', 'purchase', 'error') OR kind = 'view' AND content <> ''
UNION ALL SELECT run, max(seq) + 1, 'done', NULL, NULL FROM s GROUP BY run""")
def agent_event_stream(t: Tables) -> DataFrame:
    """Users as runs of an agent, their events as what it emits; each run ends at its first error."""
    kind = F.create_map(*[F.lit(x) for x in ("view", "on_chat_model_stream", "click", "on_tool_start", "purchase", "on_tool_end", "error", "error")])
    content = F.when(F.col("event_id") % 7 == 0, "").otherwise(F.expr("repeat(event_type, cast(event_id % 100 as int))"))
    rows = t.events.select(F.col("user_id").alias("run"), F.col("event_id").alias("seq"), kind[F.col("event_type")].alias("event"), F.lit("search").alias("name"), content.alias("content"), (F.col("event_id") % 3 == 0).alias("recoverable"))
    return logs.with_done(rows)
