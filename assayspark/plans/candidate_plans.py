"""What users call as a whole: candidates normalised and stored, molecule pages with evidence and addresses, alias chains, the client's library view."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from assayspark.operators import candidates as C
from assayspark.operators import evidence as E
from assayspark.operators import relational as R
from assayspark.scratch import own_path
from assayspark.sources.library import Library

from .registry import Tables, query

# Turns as candidates: seven kinds of strings by the length of the text.
_SQL = """
r AS (SELECT conv_id AS doc_id, turn AS ord, turn + 1 AS page, role AS source, role || turn AS name, length(text) % 7 AS n, (length(text) % 100) / 100.0::DOUBLE AS confidence FROM conversations),
c AS (SELECT *, CASE n WHEN 0 THEN '' WHEN 1 THEN '12345' WHEN 2 THEN '[Re]CC' WHEN 3 THEN 'no string' WHEN 4 THEN 'CCO' WHEN 5 THEN 'OCC' ELSE 'CCC' || ord END AS esmiles,
  CASE WHEN n IN (4, 5) THEN 'CCO' WHEN n = 6 THEN 'CCC' || ord END AS canonical FROM r),
k AS (SELECT *, n < 4 AS rejected, coalesce(canonical, esmiles) AS key, CASE WHEN n < 2 THEN 'low_quality_smiles' WHEN n = 2 THEN 'invalid_element' WHEN n = 3 THEN 'invalid_smiles' END AS reason FROM c),
m AS (SELECT doc_id, rejected, key, min(ord) AS ord, arg_min(esmiles, ord) AS esmiles, arg_min(name, ord) AS name, count(*) AS n_detections, max(confidence) AS top, arg_min(page, (-confidence, ord)) AS page, any_value(reason) AS reason FROM k GROUP BY 1, 2, 3)"""


def _candidates(t: Tables) -> DataFrame:
    rows = t.conversations.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("ord"), F.col("role").alias("source"), F.concat("role", F.col("turn").cast("string")).alias("name"), (F.length("text") % 7).alias("n"), (F.length("text") % 100 / 100.0).alias("confidence"), (F.col("turn") + 1).cast("int").alias("page"))
    last = F.concat(F.lit("CCC"), F.col("ord").cast("string"))
    string = F.when(F.col("n") == 6, last).otherwise(F.get(F.array(*map(F.lit, ("", "12345", "[Re]CC", "no string", "CCO", "OCC"))), F.col("n")))
    canonical = F.when(F.col("n") == 2, "[Re]CC").when(F.col("n").isin(4, 5), "CCO").when(F.col("n") == 6, last)
    return rows.select("doc_id", "ord", string.alias("esmiles"), "name", "source", "confidence", "page", canonical.isNotNull().alias("valid"), canonical.alias("canonical"))


@query(f"""
WITH {_SQL.strip()}
SELECT m.doc_id, row_number() OVER (PARTITION BY m.doc_id ORDER BY rejected, m.ord) AS position, key AS canonical_smiles, esmiles, name, n_detections, top AS top_confidence, reason,
       (SELECT string_agg(source, ',' ORDER BY o) FROM (SELECT source, min(ord) AS o FROM k WHERE k.doc_id = m.doc_id AND k.rejected = m.rejected AND k.key = m.key GROUP BY source)) AS sources FROM m""")
def normalised_candidates(t: Tables) -> DataFrame:
    """Every turn as a candidate: valid, merged, and rejected for each reason."""
    out = C.normalised(_candidates(t))
    return out.select("doc_id", F.col("position").cast("long"), "canonical_smiles", "esmiles", "name", "n_detections", F.get("detections", F.lit(0))["confidence"].alias("top_confidence"), "reason", F.array_join("sources", ",").alias("sources"))


@query(f"""
WITH {_SQL.strip()},
g AS (SELECT *, try_cast(regexp_extract(name, '([0-9]+)$', 1) AS BIGINT) AS t FROM m WHERE NOT rejected),
a AS (SELECT g.doc_id, key AS mol_id, CASE WHEN t % 4 = 1 THEN 'table_row' ELSE 'table' END AS kind, CASE WHEN t % 4 = 1 THEN t + 1 ELSE page END AS page FROM g)
SELECT doc_id, key AS mol_id, 'figure' AS kind, page::INT AS page, top AS confidence FROM g
UNION ALL SELECT a.doc_id, mol_id, kind, a.page::INT, c.confidence FROM a JOIN c ON c.doc_id = a.doc_id AND c.page = a.page""")
def persisted_candidates(t: Tables) -> DataFrame:
    """The candidates committed with a record for each turn, of which every fourth names its molecule; what is stored as evidence."""
    library = Library(t.spark, own_path(t.spark, "molecules"))
    c = _candidates(t)
    label = F.when(F.col("ord") % 4 == 1, F.upper("name"))
    null = lambda kind: F.lit(None).cast(kind)
    records = c.select(
        "doc_id", (F.col("ord") + 1000).alias("rec_id"), F.when(label.isNotNull(), 0).alias("table_idx"), F.when(label.isNotNull(), F.col("ord")).cast("int").alias("row_idx"), null("int").alias("col_idx"), label.alias("row_label"),
        null("string").alias("row_smiles"), F.col("page").alias("page_num"), "confidence", F.col("ord").cast("double").alias("value"), F.lit("IC50").alias("activity_type"), F.lit("nM").alias("unit"), F.col("name").alias("raw_text"),
    )
    library.run(lambda tx: C.persist(tx, C.normalised(c), records))
    return library.read("evidence").select("doc_id", "mol_id", "kind", "page", "confidence")


@query("""
WITH m AS (SELECT doc_id AS mol_id, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS n FROM documents),
e AS (SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY role, turn) AS place, count(*) OVER (PARTITION BY conv_id) AS total,
  '/api/v1/library/documents/' || conv_id || '/crop?rel_path=' || turn || '.png&library_root=lib' AS url FROM conversations)
SELECT mol_id, (SELECT count(*) FROM documents) AS total, coalesce(max(e.total), 0) AS evidence_total, coalesce(string_agg(role || ' ' || url, ';' ORDER BY place) FILTER (place <= 3), '') AS shown
FROM m LEFT JOIN e ON e.conv_id = m.mol_id WHERE m.n > 50 AND m.n <= 100 GROUP BY mol_id""")
def molecule_page_with_urls(t: Tables) -> DataFrame:
    """The second page of fifty, each with its first three pieces of evidence and the addresses of their crops, and how many there are."""
    molecules = t.documents.select(F.col("doc_id").alias("mol_id"), F.col("doc_id").alias("canonical"), "n_chars")
    key = F.col("conv_id") * 1000 + F.col("turn")
    url = E.crop_url(F.col("conv_id"), F.concat(F.lit("crops/"), F.col("turn").cast("string"), F.lit(".png")), "lib")
    evidence = t.conversations.select(F.col("conv_id").alias("canonical"), F.col("role").alias("kind"), F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), key.alias("evidence_id"), url.alias("crop_url"))
    shown = R.page(molecules, [F.desc("n_chars"), F.asc("mol_id")], 2, 50)
    wanted = evidence.join(shown.select(F.col("canonical").alias("_c")), F.col("canonical") == F.col("_c"), "left_semi")
    out = E.with_evidence(shown, wanted, 3)
    text = F.array_join(F.transform("evidence", lambda x: F.concat(x["kind"], F.lit(" "), x["crop_url"])), ";")
    return out.select("mol_id", "total", "evidence_total", F.coalesce(text, F.lit("")).alias("shown"))


@query("""
WITH p AS (SELECT conv_id, turn, conv_id * 1000 + turn AS id, role, regexp_extract(text, '^([^ ]*)', 1) AS label FROM conversations),
o AS (SELECT * FROM p WHERE role = 'system' OR label = 'Es'), f AS (SELECT label, min((conv_id, turn, id)) AS came FROM o WHERE label <> '' GROUP BY 1)
SELECT label, row_number() OVER (ORDER BY came) AS position, (SELECT count(*) FROM o) AS n_occurrences FROM f""")
def coref_chain(t: Tables) -> DataFrame:
    """All predictions of a molecule by its string or a label, over documents and pages, and the names that they give it."""
    rows = t.conversations.select(F.col("conv_id").alias("doc_id"), F.col("turn").alias("page"), (F.col("conv_id") * 1000 + F.col("turn")).alias("id"), F.col("role").alias("mol_smiles"), F.regexp_extract("text", "^([^ ]*)", 1).alias("label_text"))
    chain = E.chain(rows, "system", "Es")
    return chain.select(F.posexplode("aliases").alias("k", "label"), "n_occurrences").select("label", (F.col("k") + 1).cast("long").alias("position"), "n_occurrences")


@query("""
WITH f AS (SELECT * FROM documents ORDER BY doc_id DESC LIMIT 10000),
w AS (SELECT *, row_number() OVER (ORDER BY n_chars ASC NULLS LAST, doc_id) AS position FROM f WHERE lang = 'en' AND n_chars >= 200 AND n_chars <= 4000 AND contains(lower(left(text, 40)), 'th'))
SELECT doc_id, n_chars, position, (SELECT count(*) FROM w) AS total FROM w WHERE position > 20 AND position <= 40""")
def client_library_view(t: Tables) -> DataFrame:
    """The client's view: of the newest ten thousand rows those of a kind, a range and a search, ordered by activity, second page of twenty."""
    newest = t.documents.select("doc_id", "lang", "n_chars", F.substring("text", 1, 40).alias("name")).orderBy(F.desc("doc_id")).limit(R.CLIENT_ROWS)
    kept = R.where_contains(R.where_range(R.where_equal(newest, lang="en"), "n_chars", 200, 4000), "th", ["name"])
    order = R.client_order("n_chars", True, "doc_id")
    page = R.page(kept, order, 2, 20)
    return page.withColumn("position", F.row_number().over(W.orderBy(*order)) + 20).select("doc_id", "n_chars", F.col("position").cast("long"), "total")  # of a page's rows
