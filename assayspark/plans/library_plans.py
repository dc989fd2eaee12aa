"""Library, facets, paging, joins and writes over the test tables that stand in for documents and collections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayspark.functions import text as T
from assayspark.operators import library as L
from assayspark.operators import relational as R

from .registry import Tables, query


@query("""
SELECT 'event_type' AS facet, event_type AS value, count(*) AS n FROM events GROUP BY event_type
UNION ALL SELECT 'total', NULL, count(*) FROM events""")
def facet_counts(t: Tables) -> DataFrame:
    return R.facets(t.events, ["event_type"])


@query("""
SELECT 'o_orderstatus' AS facet, o_orderstatus AS value, count(*) AS n FROM orders GROUP BY 2
UNION ALL SELECT 'o_orderpriority', o_orderpriority, count(*) FROM orders GROUP BY 2
UNION ALL SELECT 'total', NULL, count(*) FROM orders""")
def facet_grouping_sets(t: Tables) -> DataFrame:
    return R.facets(t.orders, ["o_orderstatus", "o_orderpriority"])


@query("""
SELECT o_orderkey, o_orderdate, o_orderstatus, (SELECT count(*) FROM orders WHERE o_orderstatus = 'O') AS total
FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate DESC, o_orderkey LIMIT 50 OFFSET 50""")
def list_page_with_total(t: Tables) -> DataFrame:
    rows = R.where_equal(t.orders, o_orderstatus="O").select("o_orderkey", "o_orderdate", "o_orderstatus")
    return R.page(rows, [F.desc("o_orderdate"), F.asc("o_orderkey")], number=2)


@query("""
SELECT d.doc_id, d.lang, l.quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id
WHERE l.quality >= 0 AND l.quality <= 1 AND d.lang = 'en'""")
def range_filter_null_rejecting(t: Tables) -> DataFrame:
    rows = t.documents.join(t.labels, "doc_id", "left").select("doc_id", "lang", "quality", "source")
    return R.where_range(R.where_equal(rows, lang="en", source="all"), "quality", 0, 1).drop("source")


@query("""
SELECT p_partkey, p_name, p_type FROM part WHERE contains(lower(p_name), 'st') OR contains(lower(p_type), 'st')""")
def substring_search_two_columns(t: Tables) -> DataFrame:
    return R.where_contains(t.part, "ST", ["p_name", "p_type"]).select("p_partkey", "p_name", "p_type")


@query("""
SELECT c.c_custkey, c.c_name, n.n_name AS collection FROM customer c JOIN nation n ON n.n_nationkey = c.c_nationkey WHERE n.n_regionkey = 1""")
def docs_by_collection(t: Tables) -> DataFrame:
    own = t.nation.where("n_regionkey = 1").select(F.col("n_nationkey").alias("c_nationkey"), F.col("n_name").alias("collection"))
    return t.customer.join(own, "c_nationkey").select("c_custkey", "c_name", "collection")


@query("""
SELECT d.doc_id, coalesce(nullif(d.lang, ''), 'und') AS lang, coalesce(l.quality, -1) AS quality
FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE coalesce(nullif(d.lang, ''), 'und') <> ''""")
def coalesced_left_join(t: Tables) -> DataFrame:
    joined = t.documents.join(t.labels, "doc_id", "left")
    lang = F.coalesce(F.nullif("lang", F.lit("")), F.lit("und"))
    return joined.select("doc_id", lang.alias("lang"), F.coalesce("quality", F.lit(-1)).alias("quality")).where("lang != ''")


@query("""
SELECT r.r_regionkey AS collection_id, r.r_name AS name, (SELECT count(*) FROM nation n WHERE n.n_regionkey = r.r_regionkey) AS doc_count
FROM region r""")
def collection_counts_subquery(t: Tables) -> DataFrame:
    collections = t.region.select(F.col("r_regionkey").alias("collection_id"), F.col("r_name").alias("name"))
    return L.with_counts(collections, t.nation.select(F.col("n_regionkey").alias("collection_id")))


@query("""
SELECT r_regionkey::BIGINT AS collection_id, r_name AS name, 0 AS depth, r_name AS path FROM region
UNION ALL SELECT n_nationkey + 100, n_name, 1, r_name || '/' || n_name FROM nation JOIN region ON r_regionkey = n_regionkey
UNION ALL SELECT s_suppkey + 1000, s_name, 2, r_name || '/' || n_name || '/' || s_name
FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey""")
def collection_tree(t: Tables) -> DataFrame:
    forest = t.region.selectExpr("bigint(r_regionkey) AS collection_id", "r_name AS name", "bigint(NULL) AS parent_id")
    forest = forest.union(t.nation.selectExpr("n_nationkey + 100L", "n_name", "bigint(n_regionkey)"))
    forest = forest.union(t.supplier.selectExpr("s_suppkey + 1000L", "s_name", "s_nationkey + 100L"))
    return L.tree(forest).drop("parent_id")


@query("""
SELECT c_custkey, c_nationkey FROM customer WHERE c_nationkey <> 3
UNION ALL SELECT c_custkey, 4 FROM customer WHERE c_nationkey = 3""")
def collection_delete_reparents(t: Tables) -> DataFrame:
    forest = t.customer.selectExpr("c_custkey + 100L AS collection_id", "bigint(c_nationkey) AS parent_id").union(
        t.nation.selectExpr("bigint(n_nationkey)", "bigint(n_nationkey + 1)")
    )
    kept, _ = L.delete_collection(forest, forest.limit(0), 3)
    return kept.where("collection_id >= 100").selectExpr("collection_id - 100L AS c_custkey", "int(parent_id) AS c_nationkey")


@query("""
SELECT doc_id, source FROM documents d WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id)""")
def enqueue_anti_join(t: Tables) -> DataFrame:
    files = t.documents.select(F.col("doc_id").alias("file_path"), "source")
    return R.enqueue(files, t.labels.select(F.col("doc_id").alias("file_path"))).withColumnRenamed("file_path", "doc_id")


@query("""SELECT doc_id, lang FROM documents d WHERE EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = d.doc_id AND l.toxic = 1)""")
def exists_semi_join(t: Tables) -> DataFrame:
    return R.where_any_key(t.documents, t.labels.where("toxic = 1").select("doc_id"), "doc_id").select("doc_id", "lang")


@query("""SELECT p_partkey, p_brand FROM part WHERE p_size IN (1, 5, 9)""")
def in_list_fetch(t: Tables) -> DataFrame:
    return R.where_any_key(t.part, [1, 5, 9], "p_size").select("p_partkey", "p_brand")


@query("""SELECT p_partkey, p_name FROM part WHERE p_partkey = (SELECT min(p_partkey) FROM part WHERE p_brand = 'Brand#2' OR p_type = 'Brand#2')""")
def lookup_either_key(t: Tables) -> DataFrame:
    return R.lookup_either(t.part, "Brand#2", ["p_brand", "p_type"], "p_partkey").select("p_partkey", "p_name")


@query("""
SELECT md5(text) AS md5, min(doc_id) AS doc_id FROM documents
WHERE md5(text) NOT IN (SELECT md5(text) FROM documents WHERE doc_id % 10 = 0) AND doc_id % 10 <> 0 GROUP BY 1""")
def content_hash_dedup(t: Tables) -> DataFrame:
    hashed = t.documents.select(F.md5(F.col("text").cast("binary")).alias("md5"), "doc_id")
    return R.new_by_digest(hashed.where("doc_id % 10 != 0"), hashed.where("doc_id % 10 = 0"), "doc_id")


@query("""
SELECT md5(text) AS md5, sha256(text) AS sha256, count(*) AS n, min(doc_id) AS first_doc FROM documents GROUP BY 1, 2 HAVING count(*) > 1""")
def duplicate_groups(t: Tables) -> DataFrame:
    raw = F.col("text").cast("binary")
    d = t.documents.select(F.md5(raw).alias("md5"), F.sha2(raw, 256).alias("sha256"), "doc_id")
    return d.groupBy("md5", "sha256").agg(F.count("*").alias("n"), F.min("doc_id").alias("first_doc")).where("n > 1")


@query("""SELECT count(*) AS n_rows, count(DISTINCT user_id) AS n_tasks FROM events""")
def distinct_doc_counts(t: Tables) -> DataFrame:
    return t.events.agg(F.count("*").alias("n_rows"), F.countDistinct("user_id").alias("n_tasks"))


@query("""
SELECT k.event_type, coalesce(c.n, 0) AS n FROM (VALUES ('queued'), ('running'), ('done'), ('click'), ('view'), ('purchase')) k(event_type)
LEFT JOIN (SELECT event_type, count(*) AS n FROM events GROUP BY 1) c ON c.event_type = k.event_type""")
def status_counts_zero_filled(t: Tables) -> DataFrame:
    return R.zero_filled(t.events, "event_type", ["queued", "running", "done", "click", "view", "purchase"])


@query("""
SELECT doc_id, quality, row_number() OVER (ORDER BY quality ASC NULLS LAST, doc_id) AS up, row_number() OVER (ORDER BY quality DESC NULLS FIRST, doc_id) AS down
FROM (SELECT d.doc_id, l.quality FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)""")
def null_order_sort(t: Tables) -> DataFrame:
    rows = t.documents.join(t.labels, "doc_id", "left").select("doc_id", "quality")
    up = R.ranked(rows, R.client_order("quality", True, "doc_id"), "up")
    return R.ranked(up, R.client_order("quality", False, "doc_id"), "down")


@query("""
SELECT o_orderkey, row_number() OVER (ORDER BY CASE o_orderstatus WHEN 'P' THEN 0 WHEN 'O' THEN 1 WHEN 'F' THEN 2 ELSE 3 END, o_orderdate DESC, o_orderkey) AS position
FROM orders""")
def queue_status_order(t: Tables) -> DataFrame:
    order = [R.status_rank("o_orderstatus", ["P", "O", "F"]), F.desc("o_orderdate"), F.asc("o_orderkey")]
    return R.ranked(t.orders, order).select("o_orderkey", "position")


@query("""
SELECT c_custkey, c_name, CASE WHEN c_custkey % 3 = 0 AND c_mktsegment IS NULL THEN 'NEW' ELSE c_mktsegment END AS c_mktsegment,
       CASE WHEN c_custkey % 3 = 0 THEN c_acctbal + 1 ELSE c_acctbal END AS c_acctbal FROM customer
UNION ALL SELECT -c_custkey, c_name, 'NEW', c_acctbal + 1 FROM customer WHERE c_custkey % 30 = 0 AND c_custkey > 0""")
def upsert_keep_first(t: Tables) -> DataFrame:
    base = t.customer.select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    new = base.where("c_custkey % 3 = 0").withColumn("c_mktsegment", F.lit("NEW")).withColumn("c_acctbal", F.col("c_acctbal") + 1)
    other = new.where("c_custkey % 30 = 0 AND c_custkey > 0").withColumn("c_custkey", -F.col("c_custkey"))
    return R.upsert_keep_first(base, new.unionByName(other), "c_custkey", ["c_name", "c_mktsegment"])


@query("""
SELECT c_custkey, c_name, CASE WHEN c_custkey % 4 = 0 THEN 0.0 ELSE c_acctbal END AS c_acctbal FROM customer""")
def patch_update(t: Tables) -> DataFrame:
    base = t.customer.select("c_custkey", "c_name", "c_acctbal")
    changes = base.where("c_custkey % 4 = 0").select("c_custkey", F.lit(None).cast("string").alias("c_name"), F.lit(0.0).alias("c_acctbal"))
    return R.patch(base, changes, "c_custkey")


@query("""
SELECT c_custkey, c_name, CASE WHEN c_custkey % 5 = 0 THEN 'pending' ELSE c_mktsegment END AS c_mktsegment,
       CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE c_acctbal END AS c_acctbal FROM customer""")
def replace_row(t: Tables) -> DataFrame:
    base = t.customer.select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    return R.replace(base, base.where("c_custkey % 5 = 0").select("c_custkey", "c_name"), "c_custkey", {"c_mktsegment": "pending"})


@query("""
SELECT n_nationkey, n_name FROM nation WHERE n_nationkey < 10
UNION ALL SELECT n_nationkey, upper(n_name) FROM nation WHERE n_nationkey >= 10""")
def insert_or_ignore(t: Tables) -> DataFrame:
    base = t.nation.where("n_nationkey < 10").select("n_nationkey", "n_name")
    return R.insert_or_ignore(base, t.nation.select("n_nationkey", F.upper("n_name").alias("n_name")), ["n_nationkey"])


@query("""
SELECT 'documents' AS name, count(*) AS n FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)
UNION ALL SELECT 'labels', count(*) FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE toxic = 1)""")
def cascading_delete(t: Tables) -> DataFrame:
    kept = L.delete_documents({"documents": t.documents, "labels": t.labels}, t.labels.where("toxic = 1"))
    one = lambda name: kept[name].agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
    return one("documents").unionByName(one("labels"))


@query("""
SELECT n_nationkey, n_name FROM nation UNION ALL SELECT r_regionkey + 100, r_name FROM region""")
def legacy_migration(t: Tables) -> DataFrame:
    base = {"molecules": t.nation.select("n_nationkey", "n_name")}
    old = t.region.select((F.col("r_regionkey") + 100).alias("n_nationkey"), F.col("r_name").alias("n_name"))
    clash = t.nation.select("n_nationkey", F.lit("old").alias("n_name"))
    return L.migrated(base, {"molecules": old.union(clash), "unknown": old}, {"molecules": ["n_nationkey"]})["molecules"]


@query("""
WITH d AS (SELECT l_partkey, l_orderkey, l_linenumber FROM lineitem)
SELECT DISTINCT coalesce(nullif(CASE WHEN p.p_size % 2 = 0 THEN p.p_brand ELSE '' END, ''), p.p_name) AS canonical_smiles, d.l_partkey AS mol_id,
       d.l_orderkey AS doc_id, d.l_linenumber AS page, 'figure' AS kind FROM d LEFT JOIN part p ON p.p_partkey = d.l_partkey
WHERE coalesce(nullif(CASE WHEN p.p_size % 2 = 0 THEN p.p_brand ELSE '' END, ''), p.p_name, '') <> ''""")
def evidence_backfill(t: Tables) -> DataFrame:
    canonical = F.when(F.col("p_size") % 2 == 0, F.col("p_brand")).otherwise(F.lit(""))
    molecules = t.part.select(F.col("p_partkey").alias("mol_id"), canonical.alias("canonical_smiles"), F.col("p_name").alias("esmiles"))
    detections = t.lineitem.select(F.col("l_partkey").alias("mol_id"), F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page"))
    none = t.spark.createDataFrame([], "canonical_smiles string, mol_id long, doc_id long, page int, kind string")
    tables = {"molecules": molecules, "molecule_detections": detections, "evidence": none}
    return L.backfilled_evidence(L.backfilled_evidence(tables))["evidence"]


@query("""SELECT item_id, sha256(lower(trim(text, ' ' || chr(9) || chr(10) || chr(13) || chr(11) || chr(12)))) AS query_hash FROM benchmark""")
def query_cache_keys(t: Tables) -> DataFrame:
    return t.benchmark.select("item_id", T.query_key(F.col("text")).alias("query_hash"))
