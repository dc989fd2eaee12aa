"""Searches by the positional index, and the text evidence of molecules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from assayspark.functions import chem
from assayspark.operators import crops
from assayspark.operators import evidence as E
from assayspark.operators import fulltext as X
from assayspark.operators import relational as R
from assayspark.scratch import own_path

from .registry import Tables, query


def _indexed(t: Tables, df: DataFrame, key: str, columns: list[str]) -> DataFrame:
    path = own_path(t.spark, "index")
    X.write_index(X.positional_index(df, key, columns), key, path)
    return X.open_index(t.spark, path)


def _spaced(column: str) -> str:
    return rf"' ' || array_to_string(regexp_extract_all(strip_accents(lower(coalesce({column}, ''))), '[\p{{L}}\p{{N}}]+'), ' ') || ' '"


@query(f"""
WITH t AS (SELECT conv_id * 1000 + turn AS id, {_spaced("text")} AS a, {_spaced("role")} AS b FROM conversations)
SELECT 'words' AS search, id FROM t WHERE contains(a, ' of the ') OR contains(b, ' of the ')
UNION ALL SELECT 'prefix', id FROM t WHERE contains(a, ' us') OR contains(b, ' us')
UNION ALL SELECT 'first', id FROM t WHERE starts_with(a, ' in ') OR starts_with(b, ' in ')
UNION ALL SELECT 'column', id FROM t WHERE contains(b, ' system ')
UNION ALL SELECT 'both', id FROM t WHERE contains(a, ' la ') AND contains(b, ' assistant ')
UNION ALL SELECT 'either but not', id FROM t WHERE (contains(a, ' die ') OR contains(a, ' der ')) AND NOT contains(b, ' user ')""")
def fulltext_columns(t: Tables) -> DataFrame:
    """Searches of each kind over the texts and roles of turns, answered together."""
    columns = ["text", "role"]
    rows = t.conversations.select((F.col("conv_id") * 1000 + F.col("turn")).alias("id"), *columns)
    in_text, in_role = (lambda w, c=c: X.phrase(w, columns=[c]) for c in columns)
    wanted = {
        "words": X.phrase("Of THE"), "prefix": X.phrase("us", prefix=True), "first": X.phrase("in", first=True), "column": in_role("System"),
        "both": in_text("là") & in_role("assistant"), "either but not": (in_text("die") | in_text("der")) - in_role("user"),
    }
    return X.matches(_indexed(t, rows, "id", columns), "id", wanted, columns)


@query(f"""
WITH t AS (SELECT doc_id, {_spaced("text")} AS a FROM documents)
SELECT 'phrase' AS search, doc_id FROM t WHERE contains(a, ' of the ')
UNION ALL SELECT 'prefix', doc_id FROM t WHERE contains(a, ' des ha')
UNION ALL SELECT 'near', doc_id FROM t WHERE regexp_matches(a, ' der ([^ ]+ ){{0,3}}die ') OR regexp_matches(a, ' die ([^ ]+ ){{0,3}}der ')
UNION ALL SELECT 'near phrase', doc_id FROM t WHERE regexp_matches(a, ' of the ([^ ]+ ){{0,10}}and ') OR regexp_matches(a, ' and ([^ ]+ ){{0,10}}of the ')
UNION ALL SELECT 'folded', doc_id FROM t WHERE contains(a, ' eet')
UNION ALL SELECT 'not', doc_id FROM t WHERE contains(a, ' la ') AND NOT contains(a, ' le ')""")
def fulltext_documents(t: Tables) -> DataFrame:
    """Phrases, prefixes, nearness and exclusion over whole texts."""
    wanted = {
        "phrase": X.phrase("of the"), "prefix": X.phrase("des ha", prefix=True), "near": X.near("der", "die", distance=3), "near phrase": X.near("of the", "and"),
        "folded": X.phrase("éÉt", prefix=True), "not": X.phrase("la") - X.phrase("le"),
    }
    return X.matches(_indexed(t, t.documents, "doc_id", ["text"]), "doc_id", wanted, ["text"])


@query("""
WITH d AS (SELECT doc_id, string_split(text, chr(10)) AS l, regexp_extract_all(text, '[^ \\n]+') AS w, text FROM documents),
r AS (SELECT doc_id, k, l[k + 1] AS line, CASE WHEN k % 3 = 1 THEN '```molecode' || chr(10) || l[k + 1] || chr(10) || '```' ELSE l[k + 1] END AS shown FROM (SELECT *, unnest(range(len(l))) AS k FROM d)),
s AS (SELECT *, coalesce(sum(length(shown) + 1) OVER (PARTITION BY doc_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS at FROM r),
f AS (SELECT doc_id, string_agg(shown, chr(10) ORDER BY k) AS text FROM r GROUP BY 1),
m AS (SELECT doc_id, replace(substr(text, 97 * k + 5, 20), chr(10), ' ') AS mol_id, coalesce(w[13 * k + 3], '') AS word, k FROM (SELECT *, unnest(range(3)) AS k FROM d) WHERE length(text) > 300),
n AS (SELECT doc_id, mol_id, k, CASE WHEN word = '' OR k = 2 THEN 'Mol_' || left(mol_id, 8) ELSE word END AS name FROM m),
h AS (SELECT n.doc_id, n.k, min(s.k) AS block FROM n JOIN s ON s.doc_id = n.doc_id AND s.k % 3 = 1 WHERE contains(s.line, n.name) OR contains(s.line, left(n.mol_id, 12)) GROUP BY 1, 2)
SELECT n.doc_id, n.k, name, coalesce(s.at, 0)::INT AS char_start, coalesce(s.at + length(s.shown), 0)::INT AS char_end, left(coalesce(s.shown, ''), 1000) AS code_text,
       md5(coalesce(left(replace(substr(f.text, (greatest(0, s.at - 200) + 1)::BIGINT, (s.at + length(s.shown) + 200 - greatest(0, s.at - 200))::BIGINT), chr(10), ' '), 500), 'position unresolved')) AS excerpt_md5
FROM n LEFT JOIN h ON h.doc_id = n.doc_id AND h.k = n.k LEFT JOIN s ON s.doc_id = h.doc_id AND s.k = h.block LEFT JOIN f ON f.doc_id = n.doc_id""")
def text_evidence(t: Tables) -> DataFrame:
    """Every third line of a text as a structure block, and three molecules of it: two with a word as name, one with none."""
    lines = F.split("text", "\n", -1)
    fenced = F.transform(lines, lambda x, i: F.when(i % 3 == 1, F.concat(F.lit("```molecode\n"), x, F.lit("\n```"))).otherwise(x))
    docs = t.documents.select("doc_id", F.array_join(fenced, "\n").alias("text"))
    words = F.regexp_extract_all("text", F.lit(r"[^ \n]+"), F.lit(0))
    made = t.documents.where(F.length("text") > 300).select("doc_id", "text", words.alias("w"), F.explode(F.array(*map(F.lit, range(3)))).alias("k"))
    string = F.replace(F.substring(F.col("text"), 97 * F.col("k") + 5, F.lit(20)), F.lit("\n"), F.lit(" "))
    m = made.select("doc_id", string.alias("mol_id"), F.col("k").cast("string").alias("esmiles"), F.when(F.col("k") < 2, F.get("w", 13 * F.col("k") + 2)).alias("name"), F.lit("pending").alias("status"))
    out = E.text_evidence(docs, m)
    return out.select("doc_id", F.col("esmiles").cast("long").alias("k"), "name", "char_start", "char_end", "code_text", F.md5("text_excerpt").alias("excerpt_md5"))


@query("""
WITH s AS (SELECT doc_id, n_chars % 7 AS a, doc_id % 9 AS b, doc_id % 4 AS k FROM documents),
f AS (SELECT *, CASE k WHEN 0 THEN 2 ELSE 6 END AS n, CASE k WHEN 0 THEN 'C[Se.]' ELSE 'c1cc[as]cc1' END AS x, repeat('C', a::INT) AS y, repeat('[NH4+]', b::INT) AS z FROM s)
SELECT doc_id, CASE WHEN b > greatest(n, a) THEN z WHEN a > n THEN y ELSE x END AS main, (n + a + b)::INT AS n_atoms FROM f""")
def main_fragments(t: Tables) -> DataFrame:
    """Strings of three fragments, one of them with a dot within brackets."""
    first = F.when(F.col("doc_id") % 4 == 0, "C[Se.]").otherwise("c1cc[as]cc1")
    text = F.concat_ws(".", first, F.expr("repeat('C', cast(n_chars % 7 as int))"), F.expr("repeat('[NH4+]', cast(doc_id % 9 as int))"))
    made = t.documents.select("doc_id", text.alias("smiles"))
    return made.select("doc_id", chem.main_fragment(F.col("smiles")).alias("main"), chem.atom_count(F.col("smiles")).alias("n_atoms"))


@query("""
SELECT doc_id, row_number() OVER (ORDER BY strip_accents(lower(name)) ASC NULLS LAST, name <> strip_accents(name) ASC, name <> lower(name) ASC, doc_id) AS position
FROM (SELECT doc_id, CASE doc_id % 6 WHEN 0 THEN 'etude' WHEN 1 THEN 'Etude' WHEN 2 THEN 'étude' WHEN 3 THEN 'Zug' WHEN 4 THEN 'zebra' END AS name FROM documents)""")
def table_text_order(t: Tables) -> DataFrame:
    """A table's order by a text column with accents and capitals, as a reader expects it; rows without text come last."""
    name = F.get(F.array(*map(F.lit, ("etude", "Etude", "étude", "Zug", "zebra"))), (F.col("doc_id") % 6).cast("int"))
    return R.ranked(t.documents.select("doc_id", name.alias("name")), R.text_order("name", True, "doc_id")).select("doc_id", "position")


@query()
def embedding_crops(t: Tables) -> DataFrame:
    """Vectors as pictures of eight pixels a row, bright where a component is positive; SQL has no twin, tests compare with a flood fill."""
    size = F.size("embedding")
    whole = t.embeddings.where(F.col("embedding").isNotNull() & (size > 0) & (size % 8 == 0))
    marks = F.array_join(F.transform("embedding", lambda x: F.when(x > 0, F.lit("FF")).otherwise("00")), "")
    return crops.crop_boxes(whole.select(F.col("vec_id").alias("image_id"), F.lit(8).alias("width"), F.unhex(marks).alias("pixels")), reach=3.0, pad=1)
