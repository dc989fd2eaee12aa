"""Evidence, geometry, activities, similarity and logs over stand-in tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from assayspark.functions import geometry as G
from assayspark.functions import text as T
from assayspark.functions import units as U
from assayspark.operators import evidence as E
from assayspark.operators import matching as M
from assayspark.operators import relational as R
from assayspark.operators import similarity as Y
from assayspark.streaming import logs as S

from .registry import Tables, query

# Boxes from four components of a vector, in the unit square: corners are ordered and at least 0.02 apart.
_BOX_SQL = """(SELECT vec_id, label, vec_id // 50 AS page_id, vec_id % 50 AS box_id,
  least(e[{0}], e[{1}])::DOUBLE + 0.5 AS x0, least(e[{2}], e[{3}])::DOUBLE + 0.5 AS y0,
  greatest(e[{0}], e[{1}])::DOUBLE + 0.52 AS x1, greatest(e[{2}], e[{3}])::DOUBLE + 0.52 AS y1
  FROM (SELECT vec_id, label, embedding AS e FROM embeddings))"""
_A, _B = _BOX_SQL.format(1, 2, 3, 4), _BOX_SQL.format(5, 6, 7, 8)
# The same boxes on twenty pages, whose boxes grow in number with the table.
_FULL_A, _FULL_B = (x.replace("vec_id // 50 AS page_id, vec_id % 50 AS box_id", "vec_id % 20 AS page_id, vec_id // 20 AS box_id") for x in (_A, _B))
_W, _H = "(least(a.x1, b.x1) - greatest(a.x0, b.x0))", "(least(a.y1, b.y1) - greatest(a.y0, b.y0))"
_SHARED = f"(CASE WHEN {_W} > 0 AND {_H} > 0 THEN {_W} * {_H} ELSE 0 END)"


def _boxes(t: Tables, k: int) -> DataFrame:
    e = lambda i: F.col("embedding")[k + i].cast("double")
    box = G.box(F.least(e(0), e(1)) + 0.5, F.least(e(2), e(3)) + 0.5, F.greatest(e(0), e(1)) + 0.52, F.greatest(e(2), e(3)) + 0.52)
    return t.embeddings.select("vec_id", "label", F.floor(F.col("vec_id") / 50).alias("page_id"), (F.col("vec_id") % 50).alias("box_id"), box.alias("box"))


def _full_pages(t: Tables, k: int) -> DataFrame:
    return _boxes(t, k).withColumns({"page_id": F.col("vec_id") % 20, "box_id": F.floor(F.col("vec_id") / 20)})


def _scaled(b: Column, k: float) -> Column:
    return G.box(b["x0"] * k, b["y0"] * k, b["x1"] * k, b["y1"] * k)


@query(f"""
SELECT a.vec_id AS a, b.vec_id AS b, {_SHARED} / ((a.x1 - a.x0) * (a.y1 - a.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) - {_SHARED}) AS iou
FROM {_FULL_A} a JOIN {_FULL_B} b ON a.page_id = b.page_id AND a.vec_id <> b.vec_id WHERE {_SHARED} > 0""")
def bbox_overlap_join(t: Tables) -> DataFrame:
    a = _full_pages(t, 0).select(F.col("vec_id").alias("a"), "page_id", F.col("box").alias("x"))
    b = _full_pages(t, 4).select(F.col("vec_id").alias("b"), "page_id", F.col("box").alias("y"))
    return M.overlapping(a, b).where("a != b").select("a", "b", G.iou(F.col("x"), F.col("y")).alias("iou"))


@query(f"""
SELECT a.page_id, a.box_id, min(b.box_id) AS span_idx FROM {_A} a JOIN {_B} b ON a.page_id = b.page_id AND b.box_id % 2 = 0
WHERE {_SHARED} * 10000 / least(greatest((a.x1 - a.x0) * (a.y1 - a.y0) * 10000, 1), greatest((b.x1 - b.x0) * (b.y1 - b.y0) * 10000, 1)) > 0.3 GROUP BY 1, 2""")
def span_under_box(t: Tables) -> DataFrame:
    boxes = _boxes(t, 0).select("page_id", "box_id", _scaled(F.col("box"), 100.0).alias("box"))
    spans = _boxes(t, 4).select("page_id", F.col("box_id").alias("span_idx"), _scaled(F.col("box"), 100.0).alias("box"), (F.col("box_id") % 2).alias("block_type"))
    return M.span_under_box(boxes, spans)


@query(f"""
WITH n AS (
  SELECT a.page_id, a.box_id, b.box_id AS item_no, sqrt(pow((a.x0 + a.x1) / 2 - (b.x0 + (b.x1 - b.x0) / 2), 2) + pow((a.y0 + a.y1) / 2 - (b.y0 + (b.y1 - b.y0) / 2), 2)) AS far
  FROM {_A} a JOIN {_B} b ON a.page_id = b.page_id WHERE b.x0 < a.x1 + 0.05 AND b.x0 + (b.x1 - b.x0) > a.x0 - 0.05 AND b.y0 < a.y1 + 0.05 AND b.y0 + (b.y1 - b.y0) > a.y0 - 0.05)
SELECT page_id, box_id, count(*) AS n_items, CASE WHEN length(string_agg('t' || item_no, ' ' ORDER BY far, item_no)) > 500
  THEN substr(string_agg('t' || item_no, ' ' ORDER BY far, item_no), 1, 500) || '...' ELSE string_agg('t' || item_no, ' ' ORDER BY far, item_no) END AS roi_text
FROM n GROUP BY 1, 2""")
def roi_text(t: Tables) -> DataFrame:
    b = F.col("box")
    items = _boxes(t, 4).select("page_id", F.col("box_id").alias("item_no"), b["x0"].alias("x"), b["y0"].alias("y"), (b["x1"] - b["x0"]).alias("w"), (b["y1"] - b["y0"]).alias("h"), F.concat(F.lit("t"), F.col("box_id")).alias("text"))
    return M.roi_text(_boxes(t, 0).select("page_id", "box_id", "box"), items, 0.05)


@query(f"""
SELECT page_id, box_id, 1 - (a.y1 * 800) / 800 AS y0_unit, a.x0 * 600 / 600 AS x0_unit, a.x0 * 600 / 2 AS x0_pdf, 792 - (a.y1 * 800) / 2 AS y0_pdf FROM {_A} a""")
def bbox_frame_convert(t: Tables) -> DataFrame:
    b = F.col("box")
    px = G.box(b["x0"] * 600, b["y0"] * 800, b["x1"] * 600, b["y1"] * 800)
    unit = G.pdf_to_unit(px, F.lit(600.0), F.lit(800.0))
    raw = G.box(px["x0"] / 2, 792 - px["y1"] / 2, px["x1"] / 2, 792 - px["y0"] / 2)
    return _boxes(t, 0).select("page_id", "box_id", unit["y0"].alias("y0_unit"), unit["x0"].alias("x0_unit"), raw["x0"].alias("x0_pdf"), raw["y0"].alias("y0_pdf"))


@query(f"""
WITH RECURSIVE p AS (
  SELECT page_id, mol, idt, score, 1.0::DOUBLE / (1.0::DOUBLE + dx * 3 + dy * 2) AS fit FROM (
    SELECT a.page_id, a.box_id AS mol, b.box_id AS idt, b.label::DOUBLE AS score, abs((a.x0 + a.x1) / 2 - (b.x0 + b.x1) / 2) AS dx, abs((a.y0 + a.y1) / 2 - (b.y0 + b.y1) / 2) AS dy
    FROM {_FULL_A} a JOIN {_FULL_B} b ON a.page_id = b.page_id WHERE {_SHARED} = 0) WHERE dx <= 0.3 AND dy <= 0.3),
k AS (SELECT page_id, idt, row_number() OVER (PARTITION BY page_id ORDER BY score DESC, idt) AS k FROM (SELECT DISTINCT page_id, idt, score FROM p)),
w AS (SELECT p.page_id, k.k, p.idt, list(struct_pack(neg := -fit, mol := mol) ORDER BY fit DESC, mol) AS wants FROM p JOIN k USING (page_id, idt) GROUP BY ALL),
r AS (
  SELECT page_id, 0::BIGINT AS k, []::BIGINT[] AS used, NULL::BIGINT AS idt, NULL::STRUCT(neg DOUBLE, mol BIGINT) AS pick FROM (SELECT DISTINCT page_id FROM w)
  UNION ALL
  SELECT page_id, k, CASE WHEN pick IS NULL THEN used ELSE list_append(used, pick.mol) END, idt, pick FROM (
    SELECT r.page_id, w.k, r.used, w.idt, list_filter(w.wants, lambda x: NOT list_contains(r.used, x.mol))[1] AS pick FROM r JOIN w ON w.page_id = r.page_id AND w.k = r.k + 1))
SELECT page_id, pick.mol AS mol, idt, -pick.neg AS fit FROM r WHERE pick IS NOT NULL""")
def geometric_pairing(t: Tables) -> DataFrame:
    labels = _full_pages(t, 4).withColumn("score", F.col("label").cast("double"))
    return M.paired_on_pages(_full_pages(t, 0), labels)


@query("""
WITH c AS (SELECT o_custkey // 10 AS doc_id, o_orderkey AS cand_id, lower(o_orderpriority) AS v, row_number() OVER (PARTITION BY o_custkey // 10, o_orderpriority ORDER BY o_orderkey) AS n FROM orders),
r AS (SELECT o_custkey // 10 AS doc_id, o_orderkey AS rec_id, lower(o_orderpriority) AS v, row_number() OVER (PARTITION BY o_custkey // 10, o_orderpriority ORDER BY o_orderkey) AS n FROM orders)
SELECT doc_id, cand_id, rec_id FROM c JOIN r USING (doc_id, v, n)""")
def activity_row_alignment(t: Tables) -> DataFrame:
    """Every record stands in a table row of its own and has a label only: the n-th candidate of a label takes the n-th record."""
    c = t.orders.select(F.floor(F.col("o_custkey") / 10).alias("doc_id"), F.col("o_orderkey").alias("cand_id"), F.col("o_orderpriority").alias("name"), F.lit("").alias("canonical"), F.lit("").alias("esmiles"))
    r = t.orders.select(F.floor(F.col("o_custkey") / 10).alias("doc_id"), F.col("o_orderkey").alias("rec_id"), F.lit(0).alias("table_idx"), F.col("o_orderkey").cast("int").alias("row_idx"), F.lower("o_orderpriority").alias("row_label"), F.lit(None).cast("string").alias("row_smiles"))
    return M.aligned_rows(c, r)


@query("""
WITH m AS (SELECT user_id AS doc_id, event_id % 7 + 1 AS page, min(event_id) AS mol_id FROM events WHERE event_type = 'view' GROUP BY 1, 2),
r AS (SELECT user_id AS doc_id, event_id % 7 + 1 AS page, event_id AS rec_id, value, value AS confidence,
      row_number() OVER (PARTITION BY user_id, event_id % 7 ORDER BY value DESC, event_id) AS n FROM events WHERE event_type = 'click')
SELECT doc_id, page, mol_id, rec_id, value, confidence FROM m JOIN r USING (doc_id, page) WHERE n = 1""")
def page_proximity_fallback(t: Tables) -> DataFrame:
    e = t.events.select(F.col("user_id").alias("doc_id"), (F.col("event_id") % 7 + 1).alias("page"), "event_id", "value", "event_type")
    molecules = e.where("event_type = 'view'").select("doc_id", "page", F.col("event_id").alias("mol_id"), F.col("event_id").alias("ord"))
    records = e.where("event_type = 'click'").select("doc_id", F.col("page").alias("page_num"), F.col("event_id").alias("rec_id"), "value", F.col("value").alias("confidence"))
    return M.page_fallback(molecules, records)


@query("""
WITH r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_type, ts, event_id) AS place, count(*) OVER (PARTITION BY user_id) AS total FROM events)
SELECT user_id, event_id, place::INT AS place, total FROM r WHERE place <= 5""")
def evidence_top_n_with_total(t: Tables) -> DataFrame:
    return R.top_per_group(t.events, "user_id", [F.asc("event_type"), F.asc("ts"), F.asc("event_id")], 5).select("user_id", "event_id", "place", "total")


@query("""
WITH e AS (SELECT l_partkey, l_orderkey, l_linenumber, l_returnflag, row_number() OVER (PARTITION BY l_partkey ORDER BY l_returnflag, l_orderkey, l_linenumber, l_suppkey * 100000000 + l_orderkey * 10 + l_linenumber) AS n FROM lineitem),
g AS (SELECT l_partkey, count(*) AS total, sum(CASE WHEN n <= 50 THEN 1 ELSE 0 END) AS listed, max(CASE WHEN n = 1 THEN l_orderkey END) AS first_doc FROM e GROUP BY 1)
SELECT p.p_partkey AS mol_id, coalesce(g.total, 0) AS evidence_total, coalesce(g.listed, 0)::INT AS n_listed, g.first_doc FROM part p LEFT JOIN g ON g.l_partkey = p.p_partkey""")
def molecule_list_with_evidence(t: Tables) -> DataFrame:
    molecules = t.part.select(F.col("p_partkey").alias("mol_id"), F.lit(None).cast("long").alias("canonical"))
    key = F.col("l_suppkey") * 100000000 + F.col("l_orderkey") * 10 + F.col("l_linenumber")
    evidence = t.lineitem.select(F.col("l_partkey").alias("canonical"), F.col("l_returnflag").alias("kind"), F.col("l_orderkey").alias("doc_id"), F.col("l_linenumber").alias("page"), key.alias("evidence_id"))
    out = E.with_evidence(molecules, evidence)
    return out.select("mol_id", "evidence_total", F.coalesce(F.size("evidence"), F.lit(0)).alias("n_listed"), F.try_element_at("evidence", F.lit(1))["doc_id"].alias("first_doc"))


@query("""
SELECT coalesce('bbox:' || CASE WHEN event_id % 3 = 0 THEN (event_id % 10)::VARCHAR END, 'smi:' || nullif(CASE WHEN event_id % 3 = 1 THEN event_type ELSE '' END, ''), 'pred:' || event_id) AS grp,
       count(*) AS n FROM events GROUP BY 1""")
def prediction_groups(t: Tables) -> DataFrame:
    box = F.when(F.col("event_id") % 3 == 0, (F.col("event_id") % 10).cast("string"))
    smiles = F.when(F.col("event_id") % 3 == 1, F.col("event_type")).otherwise(F.lit(""))
    return t.events.groupBy(E.prediction_group(box, smiles, F.col("event_id")).alias("grp")).agg(F.count("*").alias("n"))


@query("""SELECT event_id, event_type, value FROM events WHERE event_id > 100 AND event_type = 'error' ORDER BY event_id LIMIT 200""")
def diagnostics_filter(t: Tables) -> DataFrame:
    rows = t.events.select(F.col("event_id").alias("seq"), F.col("event_type").alias("level"), "value")
    out = S.diagnostics(rows, after=100, level="error")
    return out.select(F.col("seq").alias("event_id"), F.col("level").alias("event_type"), "value")


@query("""
SELECT 'event_type' AS facet, event_type AS value, count(*) AS n, max(ts) AS last_ts FROM events GROUP BY 2
UNION ALL SELECT 'k', json_extract_string(props, '$.k'), count(*), max(ts) FROM events WHERE json_extract_string(props, '$.k') <> '' GROUP BY 2""")
def diagnostics_stats(t: Tables) -> DataFrame:
    code = F.get_json_object("props", "$.k")
    one = lambda name, c: t.events.where(c.isNotNull() & (c != "")).groupBy(c.alias("value")).agg(F.count("*").alias("n"), F.max("ts").alias("last_ts")).select(F.lit(name).alias("facet"), "value", "n", "last_ts")
    return one("event_type", F.col("event_type")).unionByName(one("k", code))


@query("""SELECT event_id AS id, user_id AS task FROM events WHERE event_id > 9000""")
def log_tail_since(t: Tables) -> DataFrame:
    return S.since(t.events.select(F.col("event_id").alias("id"), F.col("user_id").alias("task")), 9000)


@query("""SELECT user_id AS task, arg_max(event_type, event_id) AS level, arg_max(value, event_id) AS value, max(event_id) AS id FROM events GROUP BY 1""")
def latest_per_task(t: Tables) -> DataFrame:
    return S.latest_per_task(t.events.select(F.col("event_id").alias("id"), F.col("user_id").alias("task"), F.col("event_type").alias("level"), "value"))


@query("""SELECT event_id AS seq, event_type FROM events ORDER BY event_id DESC LIMIT 500""")
def ring_last_500(t: Tables) -> DataFrame:
    return S.ring(t.events.select(F.col("event_id").alias("seq"), "event_type"))


@query("""
SELECT user_id AS doc_id, ts_ms, message FROM (
  SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts_ms DESC, message DESC) AS n
  FROM (SELECT DISTINCT user_id, epoch_us(ts) // 1000 AS ts_ms, event_type AS message FROM events)) WHERE n <= 200""")
def merged_logs(t: Tables) -> DataFrame:
    rows = t.events.select(F.col("user_id").alias("doc_id"), F.unix_millis(F.col("ts").cast("timestamp")).alias("ts_ms"), F.col("event_type").alias("message"))
    return S.merged_logs(rows, 200)


@query("""
WITH l AS (SELECT DISTINCT conv_id AS doc_id, turn + 10 * (conv_id % 97) AS ts_ms, role AS message FROM conversations),
d AS (SELECT doc_id FROM l GROUP BY 1 ORDER BY min(ts_ms) DESC, doc_id DESC LIMIT 50)
SELECT doc_id, ts_ms, message FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY ts_ms DESC, message DESC) AS n FROM l WHERE doc_id IN (SELECT doc_id FROM d)) WHERE n <= 3""")
def merged_logs_of_last(t: Tables) -> DataFrame:
    """Turns as logs, kept for the 50 conversations that came last, three rows each: both limits cut."""
    rows = t.conversations.select(F.col("conv_id").alias("doc_id"), (F.col("turn") + 10 * (F.col("conv_id") % 97)).alias("ts_ms"), F.col("role").alias("message"))
    return S.merged_logs_of_last(rows, 3, 50)


@query("""
WITH e AS (SELECT event_id, value, try_cast(nullif(regexp_extract('> ' || value || ' nM', '([-+]?[0-9]*\\.?[0-9]+(?:[eE][-+]?[0-9]+)?)', 1), '') AS DOUBLE) AS a,
           CASE WHEN event_id % 2 = 0 THEN value ELSE value + 100 END AS b FROM events)
SELECT event_id, coalesce(abs(a - b) <= greatest(1e-6 * greatest(abs(a), abs(b)), 1e-9), false) AS hit FROM e""")
def numeric_cell_match(t: Tables) -> DataFrame:
    cell = F.concat(F.lit("> "), F.col("value").cast("string"), F.lit(" nM"))
    value = F.when(F.col("event_id") % 2 == 0, F.col("value")).otherwise(F.col("value") + 100)
    return t.events.select("event_id", T.number_matches(cell, value).alias("hit"))


_UNIT_SQL = "['nM', 'uM', 'mM', 'pM', 'M', 'mg'][(event_id % 6 + 1)::INT]"
_NM_SQL = f"CASE {_UNIT_SQL} WHEN 'uM' THEN value * 1000 WHEN 'mM' THEN value * 1e6 WHEN 'pM' THEN value / 1000 WHEN 'M' THEN value * 1e9 ELSE value END"


@query(f"SELECT event_id, nm, CASE WHEN nm > 0 THEN 9 - log10(nm) END AS p FROM (SELECT event_id, {_NM_SQL} AS nm FROM events)")
def unit_normalise_pactivity(t: Tables) -> DataFrame:
    unit = F.element_at(F.array(*[F.lit(u) for u in ("nM", "uM", "mM", "pM", "M", "mg")]), (F.col("event_id") % 6 + 1).cast("int"))
    rows = t.events.select("event_id", U.to_nm(F.col("value"), unit).alias("nm"))
    return rows.withColumn("p", U.p_activity(F.col("nm")))


@query("""
SELECT p_brand, count(*) AS n, count(nm) AS tested, count(CASE WHEN nm < 910 THEN 1 END) AS potent, arg_min(p_partkey, (nm, p_partkey)) AS best_id, min(nm) AS best_nm
FROM (SELECT p_brand, p_partkey, CASE WHEN p_size % 3 <> 0 THEN p_retailprice END AS nm FROM part) GROUP BY 1""")
def activity_summary_best(t: Tables) -> DataFrame:
    rows = t.part.select("p_brand", F.col("p_partkey").alias("id"), F.when(F.col("p_size") % 3 != 0, F.col("p_retailprice") - 900).alias("nm"))
    out = Y.summary(rows, "p_brand")
    return out.withColumn("best_nm", F.col("best_nm") + 900)


@query("""
SELECT p_brand, p_type, count(v) AS n_with, count(*) - count(v) AS n_without, min(v) AS min_value, max(v) AS max_value, round(avg(v), 6) AS avg_value
FROM (SELECT p_brand, p_type, CASE WHEN p_size > 5 THEN p_retailprice END AS v FROM part) GROUP BY 1, 2""")
def heatmap_cells(t: Tables) -> DataFrame:
    rows = t.part.withColumn("v", F.when(F.col("p_size") > 5, F.col("p_retailprice")))
    return Y.profile(rows, ["p_brand", "p_type"], "v").withColumn("avg_value", F.round("avg_value", 6))


@query("""
WITH s AS (SELECT p_name, unnest(range(4, 9)) AS n FROM part), k AS (SELECT unnest(list_transform(range(1, (length(p_name) - n + 2)::BIGINT), lambda i: p_name[i:i + n - 1])) AS sub FROM s WHERE n <= length(p_name))
SELECT sub, count(*) AS n FROM k WHERE NOT regexp_matches(sub, '[=#@]') GROUP BY 1 HAVING count(*) >= 2""")
def frequent_kmers(t: Tables) -> DataFrame:
    return Y.frequent_substrings(t.part, "p_name")


_BITS_SQL = "(SELECT vec_id, list_filter(range(0, 64), lambda i: embedding[i + 1] > 0.05) AS bits FROM embeddings)"
_PAIRS_SQL = f"""
SELECT a.vec_id AS a, b.vec_id AS b, len(list_intersect(a.bits, b.bits))::DOUBLE / len(list_distinct(list_concat(a.bits, b.bits))) AS tanimoto
FROM {_BITS_SQL} a JOIN {_BITS_SQL} b ON a.vec_id < b.vec_id
WHERE len(list_intersect(a.bits, b.bits))::DOUBLE / len(list_distinct(list_concat(a.bits, b.bits))) >= 0.4"""


@query(_PAIRS_SQL)
def tanimoto_pairs(t: Tables) -> DataFrame:
    return Y.similar_pairs(_fingerprints(t), 0.4)


def _fingerprints(t: Tables) -> DataFrame:
    return t.embeddings.select(F.col("vec_id").alias("id"), Y.on_bits(F.col("embedding"), 0.05).alias("bits"), (F.col("vec_id") % 50 + 1).cast("double").alias("activity"))


@query(f"""
SELECT p.a, p.b, tanimoto, greatest(x.v, y.v) / least(x.v, y.v) AS fold FROM ({_PAIRS_SQL}) p
JOIN (SELECT vec_id, (vec_id % 50 + 1)::DOUBLE AS v FROM embeddings) x ON x.vec_id = p.a JOIN (SELECT vec_id, (vec_id % 50 + 1)::DOUBLE AS v FROM embeddings) y ON y.vec_id = p.b
WHERE greatest(x.v, y.v) / least(x.v, y.v) >= 5""")
def similarity_cliffs(t: Tables) -> DataFrame:
    return Y.cliffs(_fingerprints(t), 0.4)


@query("""
WITH c AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1)
SELECT event_type, n, n::DOUBLE / sum(n) OVER () AS share, coalesce(sum(n) OVER (ORDER BY event_type ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE / sum(n) OVER () AS "offset" FROM c""")
def donut_shares(t: Tables) -> DataFrame:
    return Y.shares(t.events.groupBy("event_type").agg(F.count("*").alias("n")), "event_type", "n")


@query("""
SELECT event_id, (value - min(value) OVER w) / CASE WHEN max(value) OVER w > min(value) OVER w THEN max(value) OVER w - min(value) OVER w ELSE 1.0 END AS scaled
FROM events WINDOW w AS (PARTITION BY user_id)""")
def sparkline_scaling(t: Tables) -> DataFrame:
    return Y.min_max_scaled(t.events, "user_id", "value").select("event_id", "scaled")


@query("""
SELECT user_id AS doc_id, count(CASE WHEN event_type = 'click' THEN 1 END) AS n_confirmed, count(CASE WHEN event_type = 'view' THEN 1 END) AS n_pending,
       count(CASE WHEN event_type = 'error' THEN 1 END) AS n_rejected, count(DISTINCT event_type) AS n_sources FROM events GROUP BY 1""")
def detection_status_tallies(t: Tables) -> DataFrame:
    status = F.when(F.col("event_type") == "click", "confirmed").when(F.col("event_type") == "view", "pending").when(F.col("event_type") == "error", "rejected").otherwise("other")
    rows = t.events.select(F.col("user_id").alias("doc_id"), status.alias("status"), F.col("event_type").alias("source"))
    return E.detection_tallies(rows, "doc_id").withColumn("n_sources", F.size("sources").cast("long")).drop("sources")


@query("""
SELECT event_id, CASE WHEN event_id % 4 > 0 THEN value * (event_id % 4) / 4 ELSE value END AS composite FROM events WHERE CASE WHEN event_id % 4 > 0 THEN value * (event_id % 4) / 4 ELSE value END >= 0.3""")
def confidence_filter(t: Tables) -> DataFrame:
    reader = (F.col("event_id") % 4) / 4
    return t.events.select("event_id", E.composite(F.col("value"), reader).alias("composite")).where("composite >= 0.3")
