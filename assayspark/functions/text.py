"""Text rules as column expressions: titles, headings, sections, cells, scores. All but :func:`repetitive` stay in the JVM."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

# Words and patterns that results depend on.
TITLE_PREFIXES = ("Title:", "标题：", "题目：")
HEADER_PHRASES = (
    "INTERNATIONAL APPLICATION PUBLISHED UNDER THE PATENT COOPERATION TREATY (PCT)",
    "INTERNATIONAL APPLICATION PUBLISHED UNDER THE PATENT COOPERATION TREATY",
)
HEADING = (
    r"(?i)^(Abstract|Introduction|Background|Methods|Materials and Methods|Results|Discussion|Conclusion|References|"
    r"Acknowledgments|Supporting Information|Supplementary|Appendix|\d+\.\s+|FIGURES?|TABLES?)$"
)
SECTIONS = (
    (r"(?i)^#{0,3}\s*(abstract|摘要)\b.*$", "## Abstract"),
    (r"(?i)^#{0,3}\s*cross[- ]references\s+to\s+related.*$", "## Cross-References to Related Applications"),
    (r"(?i)^#{0,3}\s*background\b", "## Background"),
    (r"(?i)^#{0,3}\s*summary\b", "## Summary"),
    (r"(?i)^#{0,3}\s*brief\s+description\b", "## Brief Description"),
    (r"(?i)^#{0,3}\s*detailed\s+description\b", "## Detailed Description of the Disclosure"),
    (r"(?i)^#{0,3}\s*definitions?\b", "### Definitions"),
    (r"(?i)^#{0,3}\s*examples?\b", "### Examples"),
    (r"(?i)^#{0,3}\s*claims?\b", "## Claims"),
    (r"(?i)^#{0,3}\s*references?\b", "## References"),
)
SECTION_STARTS = r"(?i)^#{0,3}\s*(abstract|摘要|cross|background|summary|brief|detailed|definition|example|claim|reference)"
CAPS_HEADING = r"^[A-Z][A-Z\s&\-,]{3,59}$"
CAPS_BLOCKED = ("WIPO", "PCT", "WO", "IPC", "EPO", "USPTO", "WO 2026/035726 A1", "BACKGROUND OF THE DISCLOSURE")
PAGE_MARKER = r"<!--\s*PAGE\s+(\d+)\s*-->"
NUMBER = r"[-+]?\d*\.?\d+(?:[eE][-+]?\d+)?"
PAGES = r"(?i)pages?\s*(\d+)(?:\s*[-–]\s*(\d+))?"
BLANK = " \t\n\r\x0b\x0c"
#: A run of any white space.
WHITE = r"[\s\x0b\x1c-\x1f\x85\p{Z}]+"


def strip(c: Column) -> Column:
    """Without white space at both ends."""
    return F.btrim(c, F.lit(BLANK))


def blank(c: Column) -> Column:
    """Nothing but white space; reads no further than the first other character."""
    return F.ltrim(c, F.lit(BLANK)) == ""


def lines_of(text: Column, n: int | None = None) -> Column:
    """The lines of a text, or its first ``n``."""
    return F.split(text if n is None else F.substring_index(text, "\n", n), "\n", -1)


def occurrences(text: Column, term: str | Column) -> Column:
    """How often a term stands in a text without overlap; an empty term never does."""
    t = F.lit(term) if isinstance(term, str) else term
    return F.when(F.length(t) == 0, 0).otherwise(((F.length(text) - F.length(F.replace(text, t, F.lit("")))) / F.length(t)).cast("long"))


def term_frequency(text: Column, query: str) -> Column:
    """Hits of the query's distinct lower-case terms as substrings of the lower-case text."""
    return term_frequencies(text, [query])[0]


def term_frequencies(text: Column, queries: Sequence[str]) -> Column:
    """The hits of several queries, as an array; the text is brought to lower case once, and each distinct term counted once."""
    terms = sorted({t for q in queries for t in q.lower().split()})

    def totals(counts: Column) -> Column:
        each = ([terms.index(t) for t in sorted(set(q.lower().split()))] for q in queries)
        return F.array(*(sum((counts[k] for k in places), F.lit(0).cast("long")) for places in each))

    # Bound by lambdas, so that neither the lower-case text nor a count is computed for every use.
    counted = F.transform(F.array(F.lower(text)), lambda low: F.array(*(occurrences(low, t) for t in terms)) if terms else F.array().cast("array<bigint>"))
    return F.transform(counted, totals)[0]


def relevance(hits: Column, query: str) -> Column:
    """Hits over ten times the number of terms, at most 1."""
    return F.least(hits / F.lit(10.0 * max(1, len(set(query.lower().split())))), F.lit(1.0))


def hash_heading(text: Column) -> Column:
    """The first ``# `` heading within ten lines, else empty."""
    heads = F.filter(lines_of(text, 10), lambda x: x.startswith("# "))
    return F.coalesce(strip(F.substring(F.try_element_at(heads, F.lit(1)), 3, 1 << 30)), F.lit(""))


def page_range(text: Column) -> Column:
    """``start`` and ``end`` of the first mention of pages; one page is its own end."""
    part = lambda k: F.nullif(F.regexp_extract(text, PAGES, k), F.lit(""))
    a, b = part(1), part(2)
    return F.struct(a.try_cast("int").alias("start"), F.coalesce(b, a).try_cast("int").alias("end"))


def title(text: Column) -> Column:
    """A document's title: an explicit prefix within 30 lines, else the first plain line, else the first line in capitals."""

    def chosen(lines: Column) -> Column:
        # A prefix counts if what follows it is of a title's length; the first line wins, then the order of prefixes.
        explicit = F.try_element_at(F.array_sort(F.filter(F.array(*[_prefixed(lines, k) for k in range(len(TITLE_PREFIXES))]), lambda x: x["t"].isNotNull())), F.lit(1))["t"]
        usable = F.filter(lines, lambda x: _sized(x) & ~x.rlike(r"^\d+$") & ~x.rlike(r"^\(\d{1,3}\)\s+") & ~x.isin(*HEADER_PHRASES))
        caps = lambda x: x.rlike(r"^[A-Z][A-Z\s&\-,/]{4,}$")
        plain = F.try_element_at(F.filter(usable, lambda x: ~caps(x)), F.lit(1))
        return F.coalesce(explicit, plain, F.try_element_at(F.filter(usable, caps), F.lit(1)))

    # Bound by a lambda, the text is cut into lines once and not for every rule.
    return F.transform(F.array(F.transform(lines_of(text, 30), strip)), chosen)[0]


def _sized(x: Column) -> Column:
    return (F.length(x) > 3) & (F.length(x) < 200)


def _prefixed(lines: Column, k: int) -> Column:
    """Place, prefix number and title of the first line that the k-th prefix makes a title."""
    prefix = TITLE_PREFIXES[k]
    rest = F.transform(lines, lambda x: F.when(x.startswith(prefix), strip(F.substring(x, len(prefix) + 1, 1 << 30))))
    good = F.transform(rest, lambda x: F.coalesce(_sized(x), F.lit(False)))
    at = F.array_position(good, True)
    return F.struct(at.alias("at"), F.lit(k).alias("k"), F.when(at > 0, F.try_element_at(rest, at.cast("int"))).alias("t"))


def is_heading(line: Column) -> Column:
    """A known heading before the line's first full stop."""
    return strip(F.substring_index(line, ".", 1)).rlike(HEADING)


def rough_line(line: Column) -> Column:
    """A line of rough markdown: headings promoted, blank lines null."""
    return F.transform(F.array(strip(line)), lambda s: F.when(s == "", None).when(is_heading(s), F.concat(F.lit("## "), s)).otherwise(s))[0]


def reorganised_line(line: Column) -> Column:
    """A line after the rules: page markers null, section names mapped, capital headings promoted, others kept."""


    def by_rules(s: Column) -> Column:
        named = F.lit(None).cast("string")
        for pattern, heading in reversed(SECTIONS):
            named = F.when(s.rlike(pattern), F.lit(heading)).otherwise(named)
        many = F.size(F.filter(F.split(s, r"\s+"), lambda x: x != "")) >= 2
        caps = s.rlike(CAPS_HEADING) & ~s.isin(*CAPS_BLOCKED) & many
        # Most lines begin like no section, which one pattern tells.
        plain = F.coalesce(F.when(s.rlike(SECTION_STARTS), named), F.when(caps, F.concat(F.lit("## "), title_cased(s))), line)
        return F.when(s == "", line).otherwise(plain)

    # Bound by a lambda, the stripped line is made once and not for every pattern.
    return F.when(~line.rlike(rf"^\s*{PAGE_MARKER}"), F.transform(F.array(strip(line)), by_rules)[0])


def title_cased(c: Column) -> Column:
    """Each run of letters with a capital first, so also after dashes and signs."""
    return F.array_join(F.transform(F.regexp_extract_all(F.lower(c), F.lit(r"(\p{L}+|[^\p{L}]+)"), F.lit(1)), lambda x: F.initcap(x)), "")


def reorganised(text: Column) -> Column:
    """All lines by :func:`reorganised_line`, markers left out."""
    return F.array_join(F.filter(F.transform(lines_of(text), reorganised_line), lambda x: x.isNotNull()), "\n")


def shingle_ratio(text: Column) -> Column:
    """Distinct share of 8-character shingles at every fourth place of the text with blanks squeezed; null if under 200 long.

    The text is cut into pieces of four characters once; a shingle is a piece and the next.
    """
    body = F.btrim(F.regexp_replace(text, WHITE, " "))

    def ratio(b: Column) -> Column:
        n = F.ceil((b["n"] - 8) / 4).cast("int")
        shingles = F.transform(F.slice(b["pieces"], 1, F.greatest(n, F.lit(0))), lambda x, i: F.concat(x, F.get(b["pieces"], i + 1)))
        both = F.transform(F.array(shingles), lambda s: F.size(F.array_distinct(s)) / F.size(s))
        return F.when(b["n"] >= 200, both[0])

    # Bound by a lambda, what a shingle is made of is computed once and not for every shingle.
    parts = F.transform(F.array(body), lambda b: F.struct(F.length(b).alias("n"), F.regexp_extract_all(b, F.lit(r"((?s).{4})"), F.lit(1)).alias("pieces")))
    return F.transform(parts, ratio)[0]


def _shingles(size: int) -> int:
    return max(0, math.ceil((size - 8) / 4))


def _different(body: str) -> int:
    """How many different 8-character shingles stand at every fourth place: views of the characters' codes, one byte each or four."""
    try:
        codes, kind, step = body.encode("latin-1"), "<u8", 4
    except UnicodeEncodeError:
        codes, kind, step = body.encode("utf-32-le"), "V32", 16
    n = _shingles(len(body))
    return len(np.unique(np.ndarray(n, kind, codes, strides=step))) if n else 0


#: Part of a text that is looked at first.
BEGINNING = 0.3


def _repeats(text: str, least: float) -> bool:
    """The rule of :func:`repetitive` for one text.

    Most texts have so many different shingles in their beginning as the whole needs at most, which the rest can't take
    back; the others are gone through as a whole. A text isn't shorter than without its blanks.
    """
    if _different(" ".join(text[: int(len(text) * BEGINNING)].split())) >= _shingles(len(text)) * least:
        return False
    body = " ".join(text.split())
    return len(body) >= 200 and _different(body) / _shingles(len(body)) < least


@F.pandas_udf(BooleanType())
def repetitive(texts: pd.Series, least: pd.Series) -> pd.Series:
    """Whether :func:`shingle_ratio` is under ``least``; null texts and short ones aren't."""
    return pd.Series([t is not None and _repeats(t, x) for t, x in zip(texts, least, strict=True)], dtype=bool)


def degenerate(text: Column, original: Column) -> Column:
    """A rewrite that lost structure blocks or mostly repeats itself."""
    blocks = lambda c: F.regexp_count(c, F.lit("```molecode\\b"))
    lost = original.contains("```molecode") & (blocks(original) > 0) & (blocks(text) < blocks(original))
    return lost | repetitive(text, F.lit(0.25))


def collapsed(text: Column, original: Column) -> Column:
    """A rewrite of less than half the original's length."""
    return F.length(text) < F.length(original) * 0.5


def tokens_estimate(text: Column) -> Column:
    return F.floor(F.length(text) / 4).cast("long")


def cells(line: Column) -> Column:
    """Cells of a table row, trimmed."""
    return F.transform(F.split(F.btrim(strip(line), F.lit("|")), r"\|", -1), strip)


def first_number(cell: Column) -> Column:
    return F.nullif(F.regexp_extract(cell, f"({NUMBER})", 1), F.lit("")).try_cast("double")


def number_matches(cell: Column, value: Column, rel: float = 1e-6, abs_: float = 1e-9) -> Column:
    """The first number of a cell is the value, within relative or absolute tolerance; null is no match."""
    a = first_number(cell)
    return F.coalesce(F.abs(a - value) <= F.greatest(F.lit(rel) * F.greatest(F.abs(a), F.abs(value)), F.lit(abs_)), F.lit(False))


def json_array(text: Column, schema: str) -> Column:
    """Rows of a JSON array, within a code fence or not; anything else is an empty array."""
    bare = F.regexp_replace(strip(text), r"^```[a-zA-Z]*\s*|\s*```$", "")
    return F.coalesce(F.from_json(F.when(strip(bare).startswith("["), bare), schema), F.from_json(F.lit("[]"), schema))


def query_key(query: Column, *parts: Column) -> Column:
    """Cache key of a query, whatever its case and outer blanks, and of what else its result depends on."""
    base = F.lower(strip(query))
    return F.sha2(base if not parts else F.concat_ws("\x1f", base, *parts), 256)


def truncated(text: Column, n: int = 200) -> Column:
    """At most ``n`` characters, back to the last blank, with dots; shorter texts as they are."""
    cut = F.substring(text, 1, n)
    at = F.length(cut) - F.instr(F.reverse(cut), " ")
    return F.when(F.length(text) <= n, text).otherwise(F.concat(F.when(F.instr(cut, " ") > 0, F.substring(cut, F.lit(1), at)).otherwise(cut), F.lit("...")))


def safe_filename(name: Column) -> Column:
    return strip(F.regexp_replace(name, r'[\\/:*?"<>|]', "_"))


def safe_identifier(name: Column) -> Column:
    """A name of at most 48 word characters, dots and dashes."""
    safe = F.substring(F.regexp_replace(name, r"[^\p{L}\p{N}_\-.]", "_"), 1, 48)
    return F.when(F.coalesce(name, F.lit("")) == "", F.lit("Unnamed")).otherwise(safe)


def highlighted(text: Column, query: str) -> Column:
    """The text in alternating parts outside of and equal to the query, in any case."""
    import re

    return F.split(F.regexp_replace(text, f"(?i)({re.escape(query)})", "\x1f$1\x1f"), "\x1f", -1)
