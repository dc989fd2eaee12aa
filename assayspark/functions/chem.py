"""Lexical chemistry: what can be told from the letters of a string.

Nothing here presents a lexical result as canonical. Canonical forms, fingerprints and descriptors are a toolkit's
results, and come as input columns.
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Token pattern, allowed elements and weights.
TOKEN = (
    r"(\[[^\]]+\]|Br|Cl|Si|Se|Li|Na|Ca|Fe|Zn|Cu|Mn|Co|Ni|Pt|Pd|Sn|Pb|Bi|Te|As|Sb|"
    r"[\#=\+\\/@%\-\(\)\[\]\\\.0-9]|[A-Z][a-z]?)"
)
ELEMENTS = ("C", "N", "O", "S", "F", "Cl", "Br", "I", "P", "B", "Si", "Se", "As", "H", "*")
WEIGHTS = {
    "H": 1.008, "C": 12.011, "N": 14.007, "O": 15.999, "F": 18.998,
    "P": 30.974, "S": 32.065, "Cl": 35.453, "Br": 79.904, "I": 126.904,
}
CANDIDATE = r"[A-Za-z0-9@+\-\[\]\(\)\\/#=%.]{3,}"
#: Tokens of a condensed formula: residues, symbols, numbers and brackets.
CONDENSED = r"R[0-9]*|[A-Z][a-z]+|[A-Z]|[0-9]+|\(|\)"


def tokens(smiles: Column) -> Column:
    """Atom-wise tokens."""
    return F.filter(F.regexp_extract_all(smiles, F.lit(TOKEN), F.lit(1)), lambda x: F.trim(x) != "")


def valid_characters(smiles: Column) -> Column:
    """At most 200 characters, all of the line notation's; blank or null is not valid."""
    return F.coalesce((F.length(smiles) <= 200) & F.trim(smiles).rlike(r"^[A-Za-z0-9@+\-\[\]()\\/#%=.:]+$"), F.lit(False))


def low_quality(smiles: Column) -> Column:
    """Empty, under three characters or digits only."""
    return (F.length(F.coalesce(smiles, F.lit(""))) < 3) | F.coalesce(smiles.rlike(r"^[0-9]+$"), F.lit(False))


def atoms(smiles: Column) -> Column:
    """Element symbols in and out of brackets, aromatic ones in capitals; wildcards as ``*``."""
    found = F.regexp_extract_all(smiles, F.lit(r"\[[0-9]*([A-Z][a-z]?|[a-z][a-z]?|\*)[^\]]*\]|(Cl|Br|[BCNOPSFI]|[bcnops]|\*)"), F.lit(0))
    # Two small letters are one aromatic symbol within brackets only, and none is found outside of them.
    return F.transform(found, lambda x: F.initcap(F.regexp_extract(x, r"^\[?[0-9]*([A-Z][a-z]?|[a-z][a-z]?|\*)", 1)))


def foreign_elements(smiles: Column, allowed: tuple[str, ...] = ELEMENTS) -> Column:
    """Elements that aren't on the list."""
    return F.array_distinct(F.array_except(atoms(smiles), F.array(*[F.lit(a) for a in allowed])))


def balanced(smiles: Column) -> Column:
    """Brackets close and every ring number stands an even number of times: what can be told from the letters."""
    count = lambda c: F.length(smiles) - F.length(F.replace(smiles, F.lit(c), F.lit("")))
    bare = F.regexp_replace(smiles, r"\[[^\]]*\]", "")
    digits = F.regexp_extract_all(bare, F.lit(r"%[0-9]{2}|[0-9]"), F.lit(0))
    even = F.forall(F.array_distinct(digits), lambda d: F.size(F.filter(digits, lambda x: x == d)) % 2 == 0)
    return (count("(") == count(")")) & (count("[") == count("]")) & even


def formula(smiles: Column) -> Column:
    """A rough formula: capital element symbols but H, Cl and Br counted, carbon first."""
    symbols = F.filter(F.regexp_extract_all(smiles, F.lit("([A-Z][a-z]?)"), F.lit(1)), lambda x: ~x.isin("H", "Cl", "Br"))
    distinct = F.array_sort(F.transform(F.array_distinct(symbols), lambda x: F.struct((x != "C").alias("k"), x.alias("s"))))
    part = lambda s: F.concat(s, F.when(F.size(F.filter(symbols, lambda x: x == s)) > 1, F.size(F.filter(symbols, lambda x: x == s)).cast("string")).otherwise(F.lit("")))
    return F.when(F.size(symbols) == 0, smiles).otherwise(F.array_join(F.transform(distinct, lambda x: part(x["s"])), ""))


def rough_weight(smiles: Column) -> Column:
    """A rough weight from capital element symbols but H, to one decimal."""
    known = F.create_map(*[x for k, v in WEIGHTS.items() for x in (F.lit(k), F.lit(v))])
    symbols = F.filter(F.regexp_extract_all(smiles, F.lit("([A-Z][a-z]?)"), F.lit(1)), lambda x: x != "H")
    total = F.aggregate(symbols, F.lit(0.0), lambda acc, x: acc + F.coalesce(F.try_element_at(known, x), F.lit(0.0)))
    return F.floor(total * 10 + 0.5) / 10


def candidates(text: Column) -> Column:
    """Stretches of a text that may be line notation, distinct, in first-seen order; with a sign or digit that words lack."""
    found = F.regexp_extract_all(text, F.lit(CANDIDATE), F.lit(0))
    return F.array_distinct(F.filter(found, lambda x: x.rlike(r"[=#@\[\]()0-9]") & x.rlike("[CNOcno]")))


#: A tag of the extended notation: atom, ring or circle, its index and its group, which may hold any text but its own end.
TAG = r"(?s)<([arc])>([0-9]+):(.*?)</\1>"
# Names that are written in one form only.
GROUP_NAMES = {"OCH3": "OMe", "MeO": "OMe", "CO2H": "COOH", "Tos": "Ts"}
GROUP_CASES = ("Boc", "Me", "Et", "Ph", "OMe", "Ts", "COOH", "CF3", "Ac", "Bn")


def group_name(group: Column) -> Column:
    """A group's name in the one form in which names are compared: numbers without brackets or carets, known names in their own case."""
    out = F.regexp_replace(F.trim(group), r"^R(?:\[([^\]]*)\]|\^(.*))$", "R$1$2")
    out = F.regexp_replace(out, r"^R\[([^\]]*)\](.*)$", "R$1$2")
    known = F.create_map(*[F.lit(x) for name in GROUP_CASES for x in (name.lower(), name)], *[F.lit(x) for a, b in GROUP_NAMES.items() for x in (a.lower(), b) if a.lower() not in {n.lower() for n in GROUP_CASES}])
    return F.coalesce(F.try_element_at(known, F.lower(out)), out)


def layers(esmiles: Column) -> Column:
    """An extended string parted into its plain part, its tags (``kind``, ``idx``, ``group``, ``name``) and what is wrong with it; an extension.

    Tags stand after ``<sep>``; tags elsewhere are taken as well, as long as they are whole. ``error`` is null, or says that tags aren't
    parted off (``separator``), that there is a separator without tags (``empty``), or text between tags (``rest``), where a
    tag that isn't closed, nested in its own kind or without index ends up.
    """
    head = F.regexp_replace(F.regexp_extract(esmiles, r"(?s)^(.*?)(?:<sep>|$)", 1), TAG, "")
    tail = F.when(F.contains(esmiles, F.lit("<sep>")), F.regexp_extract(esmiles, r"(?s)<sep>(.*)$", 1))
    rest = F.trim(F.regexp_replace(F.coalesce(tail, F.lit("")), TAG, ""))
    found = F.regexp_extract_all(esmiles, F.lit(TAG), F.lit(0))
    part = lambda x, k: F.regexp_extract(x, TAG, k)
    tag = lambda x: F.struct(part(x, 1).alias("kind"), part(x, 2).try_cast("integer").alias("idx"), part(x, 3).alias("group"), group_name(part(x, 3)).alias("name"))
    error = F.when((rest != "") | head.rlike("[<>]"), "rest").when(tail.isNull() & (F.size(found) > 0), "separator").when(tail.isNotNull() & (F.size(found) == 0), "empty")
    return F.when(esmiles.isNotNull(), F.struct(F.trim(head).alias("smiles"), F.transform(found, tag).alias("tags"), error.alias("error")))


def fragments(smiles: Column) -> Column:
    """The parts of a string that dots part, but those within brackets."""
    return F.filter(F.split(smiles, r"\.(?![^\[]*\])", -1), lambda x: x != "")


def atom_count(smiles: Column) -> Column:
    """Atoms that are written, hydrogen ones within brackets of their own as well; wildcards count."""
    return F.size(atoms(smiles))


def main_fragment(smiles: Column) -> Column:
    """The fragment with the most atoms, the first of several; null without any."""
    sized = F.transform(fragments(smiles), lambda x, i: F.struct(atom_count(x).alias("n"), (-i).alias("i"), x.alias("x")))
    return F.when(F.size(sized) > 0, F.array_max(sized)["x"])


def _counted(parts: list[str]) -> list:
    """Pairs of element (or nested list) and number from the tokens of a condensed formula."""
    stack: list[list] = [[]]
    for p in parts:
        if p == "(":
            stack.append([])
        elif p == ")":
            inner = stack.pop() if len(stack) > 1 else []
            stack[-1].append([inner, 1])
        elif p.isdigit():
            if stack[-1]:
                stack[-1][-1][1] = int(p)
        else:
            stack[-1].append([p, 1])
    while len(stack) > 1:  # a bracket that isn't closed ends with the formula
        inner = stack.pop()
        stack[-1].append([inner, 1])
    return stack[0]


def condensed(formula_: Column, groups: tuple[str, ...] = ()) -> Column:
    """A condensed formula as JSON pairs of element and number, brackets nested: ``C2H4O`` is [["C",2],["H",4],["O",1]].

    Names in ``groups`` (abbreviations) are taken as they are, earlier ones first, before element symbols.
    """
    pattern = "|".join([*map(re.escape, groups), CONDENSED])

    @F.pandas_udf(T.StringType())
    def parsed(formulas: pd.Series) -> pd.Series:
        token = re.compile(pattern)
        return pd.Series([None if f is None else json.dumps(_counted(token.findall(f)), separators=(",", ":")) for f in formulas])

    return parsed(formula_)
