"""Chat formatting: records of any known layout become canonical turns, formatted by a template and read back.

A record is a JSON object. Its nested field paths (``messages[].content``) are hashed into a fingerprint, which
selects a declarative mapping: a list of rules that name paths, roles and joined fields. Records of unknown
layouts are returned apart with their paths, never guessed. A layout is a value of ``LAYOUTS``; more can be passed.

The template marks turns by ``<|im_start|>role`` and ``<|im_end|>`` lines. Control strings of common templates
inside texts and roles get a word joiner after their first character, and so do those that have joiners there
already, so texts without joiners change only where they could be taken for control strings, and ``unescape``
gives back every text. The loss mask covers the texts of turns of the role ``assistant``, without their marks.

Conversations are cut into records of at most ``PIECE_TURNS`` turns and read back as streams of their records, so no
task holds a conversation, however long. The table is shuffled once, by conversation: a digest of a whole conversation
has to be taken in order, by one task, and all steps before it go along with it.

Defined cases: a null role or text is empty; rows without conv_id are one conversation; rows of one turn (or of none,
which come first) go by role and text; repeated rows are turns of their own; extra columns are left out. A record
that is null or no JSON object, or whose fields aren't those of a layout, is unknown. A conversation with an unknown
record is formatted without it. An empty table gives only what is added to it.
"""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_batches, arrow_schema, small_batches, table

PIECE_TURNS = 16

# ---- layouts -------------------------------------------------------------------------------------------------


@dataclass(frozen=True)
class Say:
    """One turn of a fixed role: the fields that are there and not empty, joined by a blank line."""

    role: str
    fields: tuple[str, ...]


@dataclass(frozen=True)
class Each:
    """A list of objects, each a turn whose role stands in a field and is renamed by ``names``; text may be a list of parts."""

    path: str
    role: str
    text: str
    parts: str | None = None
    names: tuple[tuple[str, str], ...] = ()


@dataclass(frozen=True)
class Pairs:
    """A list of objects, each with a turn for every (field, role) that it has, in this order."""

    path: str
    sides: tuple[tuple[str, str], ...]


@dataclass(frozen=True)
class Layout:
    """Field paths that a record must have, those that it may have, and the rules that give its turns in order."""

    name: str
    paths: tuple[str, ...]
    optional: tuple[str, ...]
    rules: tuple[Say | Each | Pairs, ...]


LAYOUTS = (
    Layout("completion", ("prompt", "completion"), (), (Say("user", ("prompt",)), Say("assistant", ("completion",)))),
    Layout("instruction", ("instruction", "output"), ("input", "system"),
           (Say("system", ("system",)), Say("user", ("instruction", "input")), Say("assistant", ("output",)))),
    Layout("messages", ("messages[].role", "messages[].content"), (), (Each("messages", "role", "content"),)),
    Layout("parts", ("messages[].role", "messages[].content[].type", "messages[].content[].text"), (),
           (Each("messages", "role", "content", parts="text"),)),
    Layout("from_value", ("conversations[].from", "conversations[].value"), (),
           (Each("conversations", "from", "value", names=(("human", "user"), ("gpt", "assistant"))),)),
    Layout("exchange", ("turns[].user", "turns[].assistant"), (), (Pairs("turns", (("user", "user"), ("assistant", "assistant"))),)),
    Layout("row", ("role", "text"), (), (Each("", "role", "text"),)),
)


def fingerprint(paths: Iterator[str] | tuple[str, ...] | set[str]) -> str:
    """The digest of a set of field paths."""
    return hashlib.sha256("\n".join(sorted(set(paths))).encode()).hexdigest()[:32]


def by_fingerprint(layouts: tuple[Layout, ...] = LAYOUTS) -> dict[str, Layout]:
    """Every fingerprint that a layout's records can have, with and without each optional field."""
    out: dict[str, Layout] = {}
    for layout in layouts:
        for n in range(len(layout.optional) + 1):
            for more in combinations(layout.optional, n):
                mark = fingerprint((*layout.paths, *more))
                if mark in out:
                    raise ValueError(f"layouts {out[mark].name} and {layout.name} have the same paths")
                out[mark] = layout
    return out


def field_paths(value: object, at: str = "") -> Iterator[str]:
    """The paths of all leaves; elements of a list share one path, an empty list or object is a leaf."""
    if isinstance(value, dict) and value:
        for key, inner in value.items():
            yield from field_paths(inner, f"{at}.{key}" if at else key)
    elif isinstance(value, list) and value:
        for inner in value:
            yield from field_paths(inner, f"{at}[]")
    else:
        yield at


def with_fingerprint(records: DataFrame) -> DataFrame:
    """Records with ``paths``, the sorted field paths of ``raw``, and their ``fingerprint``; both null where it is no object."""
    out = T.StructType([*records.schema.fields, *records.sparkSession.createDataFrame([], "paths array<string>, fingerprint string").schema.fields])
    shape = arrow_schema(out)
    at = records.columns.index("raw")

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def read(raw: str | None) -> tuple:
            try:
                value = json.loads(raw or "")
            except ValueError:
                return None, None
            if not isinstance(value, dict):
                return None, None
            paths = sorted(set(field_paths(value)))
            return paths, fingerprint(tuple(paths))

        for b in batches:
            found = [read(raw) for raw in b.column(at).to_pylist()]
            columns = [pa.array([f[k] for f in found], shape.field(k - 2).type) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*b.columns, *columns], schema=shape)

    return records.mapInArrow(work, out)


# ---- mappings as column expressions -----------------------------------------------------------------------------

_TURNS = "array<struct<role: string, text: string>>"
#: Texts may be longer than the reader's usual bound on a string.
_READ = {"maxStringLen": str(2**31 - 1)}


def _turn(role: Column, text: Column) -> Column:
    return F.struct(F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))


def _rule(rule: Say | Each | Pairs, raw: Column) -> Column:
    """The turns that a rule finds in a record."""
    if isinstance(rule, Say):
        got = F.from_json(raw, ", ".join(f"`{f}` string" for f in rule.fields), _READ)
        fields = F.filter(F.array(*(got[f] for f in rule.fields)), lambda x: x != "")
        said = F.array_compact(F.array(*(got[f] for f in rule.fields)))
        return F.when(F.size(said) > 0, F.array(_turn(F.lit(rule.role), F.array_join(fields, "\n\n")))).otherwise(F.array().cast(_TURNS))
    if isinstance(rule, Pairs):
        sides = ", ".join(f"`{f}`: string" for f, _ in rule.sides)
        got = F.from_json(raw, f"`{rule.path}` array<struct<{sides}>>", _READ)[rule.path]
        turns = lambda x: F.filter(F.array(*(F.when(x[f].isNotNull(), _turn(F.lit(r), x[f])) for f, r in rule.sides)), lambda t: t.isNotNull())
        return F.flatten(F.transform(got, turns))
    text = f"array<struct<`{rule.parts}`: string>>" if rule.parts else "string"
    one = f"struct<`{rule.role}`: string, `{rule.text}`: {text}>"
    got = F.from_json(raw, f"`{rule.path}` array<{one}>", _READ)[rule.path] if rule.path else F.array(F.from_json(raw, one, _READ))

    def turn(x: Column) -> Column:
        role = x[rule.role]
        for theirs, ours in rule.names:
            role = F.when(x[rule.role] == theirs, ours).otherwise(role)
        said = F.array_join(F.transform(x[rule.text], lambda p: p[rule.parts]), "") if rule.parts else x[rule.text]
        return _turn(role, said)

    return F.transform(got, turn)


def canonical(records: DataFrame, layouts: tuple[Layout, ...] = LAYOUTS) -> DataFrame:
    """Records with their ``layout`` (null: unknown), ``paths`` and ``turns``, an array of role and text (null: unknown)."""
    marked = with_fingerprint(records)
    layout, turns = F.lit(None).cast("string"), F.lit(None).cast(_TURNS)
    for known in layouts:
        marks = [m for m, x in by_fingerprint(layouts).items() if x == known]
        here = F.col("fingerprint").isin(marks)
        layout = F.when(here, known.name).otherwise(layout)
        turns = F.when(here, F.concat(*(_rule(r, F.col("raw")) for r in known.rules)).cast(_TURNS)).otherwise(turns)
    return marked.select(*records.columns, "paths", layout.alias("layout"), turns.alias("turns"))


# ---- template ---------------------------------------------------------------------------------------------------

JOINER = "\u2060"
START, END = "<|im_start|>", "<|im_end|>\n"
#: Control strings of common chat templates. None begins inside another.
CONTROL = (
    "<|im_start|>", "<|im_end|>", "<|im_sep|>", "<|endoftext|>", "<|begin_of_text|>", "<|end_of_text|>", "<|start_header_id|>", "<|end_header_id|>",
    "<|eot_id|>", "<|system|>", "<|user|>", "<|assistant|>", "<|end|>", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>",
    "<start_of_turn>", "<end_of_turn>", "<bos>", "<eos>", "<pad>", "<unk>", "[BOS]", "[EOS]",
)
_ENDS = {first: "|".join(re.escape(c[1:]) for c in CONTROL if c[0] == first) for first in sorted({c[0] for c in CONTROL})}
ESCAPE = "|".join(f"({re.escape(first)}{JOINER}*)(?={rest})" for first, rest in _ENDS.items())
UNESCAPE = "|".join(f"({re.escape(first)}{JOINER}*){JOINER}(?={rest})" for first, rest in _ENDS.items())
_MARKED = re.compile(UNESCAPE)
_GROUPS = "".join(f"${k}" for k in range(1, len(_ENDS) + 1))


def escape(text: Column) -> Column:
    """Text in which no control string stands as such."""
    return F.regexp_replace(text, ESCAPE, _GROUPS + JOINER)


def unescape(text: str) -> str:
    """What ``escape`` was given."""
    return _MARKED.sub(lambda m: "".join(g or "" for g in m.groups()), text)


def _line(role: Column) -> Column:
    """A role for a line of its own: line ends and backslashes are written as pairs."""
    return F.replace(F.replace(escape(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def _role(line: str) -> str:
    return unescape(re.sub(r"\\(.)", lambda m: "\n" if m[1] == "n" else m[1], line))


def formatted(records: DataFrame) -> DataFrame:
    """Canonical records with ``formatted`` and ``loss``, the (start, end) spans of assistant texts in characters of it."""
    head = lambda t: F.concat(F.lit(START), _line(t["role"]), F.lit("\n"))
    pieces = F.transform("turns", lambda t: F.struct(head(t).alias("head"), escape(t["text"]).alias("body"), (t["role"] == "assistant").alias("learn")))
    length = lambda p: F.length(p["head"]) + F.length(p["body"]) + len(END)
    nothing = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start: int, end: int>>").alias("spans"))

    def put(so_far: Column, p: Column) -> Column:
        start = so_far["at"] + F.length(p["head"])
        span = F.struct(start.alias("start"), (start + F.length(p["body"])).alias("end"))
        return F.struct((so_far["at"] + length(p)).alias("at"), F.when(p["learn"], F.array_append(so_far["spans"], span)).otherwise(so_far["spans"]).alias("spans"))

    out = records.withColumn("pieces", pieces)
    text = F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit(END))), "")
    return out.select(*records.columns, text.alias("formatted"), F.aggregate("pieces", nothing, put)["spans"].alias("loss"))


def parsed(text: str) -> Iterator[tuple[str, str]]:
    """(role, text) of every turn of a formatted text."""
    at = 0
    while at < len(text):
        if not text.startswith(START, at):
            raise ValueError("no turn starts here")
        line = text.index("\n", at)
        end = text.index(END, line + 1)
        yield _role(text[at + len(START) : line]), unescape(text[line + 1 : end])
        at = end + len(END)


def read_back(pieces: DataFrame, *, ordered: bool = False) -> DataFrame:
    """One row for each conversation of formatted pieces (``conv_id``, ``piece``), from the formatted text and the mask alone.

    ``ordered`` says that each conversation's pieces already come together and in order, as :func:`records_of` gives them.
    """
    kind = pieces.schema["conv_id"].dataType.simpleString()
    out = pieces.sparkSession.createDataFrame([], f"conv_id {kind}, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long").schema
    shape = arrow_schema(out)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told() -> Iterator[tuple]:
            now, got = None, None
            for b in batches:
                for conv, _, text, starts, ends in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if got is None or conv != now:
                        if got is not None:
                            yield now, got[0], got[1].hexdigest(), got[2], got[3].hexdigest(), got[4]
                        now, got = conv, [0, hashlib.sha256(), 0, hashlib.sha256(), 0]
                    for role, said in parsed(text or ""):
                        got[0] += 1
                        got[1].update(f"{role}\n{said}\n".encode())
                    for start, end in zip(starts or [], ends or [], strict=True):
                        learned = unescape(text[start:end])
                        got[2] += len(learned)
                        got[3].update(learned.encode())
                    got[4] += len(text or "")
            if got is not None:
                yield now, got[0], got[1].hexdigest(), got[2], got[3].hexdigest(), got[4]

        yield from arrow_batches(told(), shape)

    light = pieces.select("conv_id", "piece", "formatted", F.col("loss.start").alias("starts"), F.col("loss.end").alias("ends"))
    light = light if ordered else light.repartition("conv_id").sortWithinPartitions("conv_id", "piece")
    return light.mapInArrow(work, out)


# ---- the conversations table as records -----------------------------------------------------------------------------


def _pieces(rows: DataFrame) -> DataFrame:
    """``conv_id``, ``piece`` from 0 and ``t``, at most PIECE_TURNS turns in order; a conversation's pieces come together and in order."""
    rows = rows.select("conv_id", "turn", *(F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("role", "text")))
    rows = rows.repartition("conv_id").sortWithinPartitions("conv_id", F.col("turn").asc_nulls_first(), "role", "text")
    out = rows.sparkSession.createDataFrame([], f"conv_id {rows.schema['conv_id'].dataType.simpleString()}, piece long, t {_TURNS}").schema
    shape = arrow_schema(out)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def cut() -> Iterator[tuple]:
            now, piece, held = object(), 0, []
            for b in batches:
                for conv, role, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    if held and (conv != now or len(held) == PIECE_TURNS):
                        yield now, piece, held
                        piece, held = piece + 1, []
                    if conv != now:
                        now, piece = conv, 0
                    held.append({"role": role, "text": text})
            if held:
                yield now, piece, held

        yield from arrow_batches(cut(), shape, 200)

    return rows.select("conv_id", "role", "text").mapInArrow(work, out)


def records_of(rows: DataFrame) -> DataFrame:
    """``conv_id``, ``piece`` and ``raw``: turns in records of the layouts that can hold them, chosen by a hash among these."""
    pieces = _pieces(rows)
    roles = F.array_join(F.transform("t", lambda x: F.when(x["role"].isin("system", "user", "assistant"), F.substring(x["role"], 1, 1)).otherwise("-")), "")
    pick = F.pmod(F.xxhash64("conv_id", "piece"), F.lit(60))
    said = lambda k: F.get("t", k)["text"]
    user = said(F.size("t") - F.lit(2))
    blank = F.instr(user, "\n\n")
    # An instruction with an input is one that splits at its first blank line into two parts which aren't empty.
    split = (blank > 1) & (blank + 1 < F.length(user))
    before, after = F.when(split, F.substring(user, F.lit(1), blank - 1)).otherwise(user), F.when(split, F.substring(user, blank + 2, F.length(user)))
    whole = user != ""
    messages = F.to_json(F.struct(F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content"))).alias("messages")))
    parts = F.transform("t", lambda x: F.struct(x["role"].alias("role"), F.array(F.struct(F.lit("text").alias("type"), x["text"].alias("text"))).alias("content")))
    theirs = lambda x: F.when(x["role"] == "user", "human").when(x["role"] == "assistant", "gpt").otherwise(x["role"])
    values = F.transform("t", lambda x: F.struct(theirs(x).alias("from"), x["text"].alias("value")))
    twos = F.transform(F.sequence(F.lit(0), (F.size("t") / 2).cast("int") - 1), lambda k: F.struct(said(2 * k).alias("user"), said(2 * k + 1).alias("assistant")))
    own = F.exists("t", lambda x: x["role"].isin("human", "gpt"))
    last = said(F.size("t") - F.lit(1))
    raw = (
        F.when((roles == "ua") & (pick % 3 == 0), F.to_json(F.struct(said(F.lit(0)).alias("prompt"), said(F.lit(1)).alias("completion"))))
        .when((roles == "ua") & (pick % 3 == 1) & whole, F.to_json(F.struct(before.alias("instruction"), after.alias("input"), last.alias("output"))))
        .when((roles == "sua") & (pick % 2 == 0) & whole, F.to_json(F.struct(said(F.lit(0)).alias("system"), before.alias("instruction"), after.alias("input"), last.alias("output"))))
        .when((F.size("t") == 1) & (pick % 2 == 0), F.to_json(F.struct(F.get("t", F.lit(0))["role"].alias("role"), said(F.lit(0)).alias("text"))))
        .when(roles.rlike("^(ua)+$") & (pick % 4 == 0), F.to_json(F.struct(twos.alias("turns"))))
        .when((pick % 5 < 2) & ~own, F.to_json(F.struct(values.alias("conversations"))))
        .when(pick % 5 == 2, F.to_json(F.struct(parts.alias("messages"))))
        .otherwise(messages)
    )
    return pieces.select("conv_id", "piece", raw.alias("raw"))


#: The conversation that the query adds: texts that look like a template's marks.
MARKS = "</s>[INST] ok [/INST]"


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation and one of control strings: to records, canonical turns, formatted text, and read back."""
    small_batches(spark)
    talks = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    more = spark.createDataFrame([(-7, 0, "user", MARKS), (-7, 1, "assistant", MARKS)], "conv_id long, turn long, role string, text string")
    return read_back(formatted(canonical(records_of(talks.unionByName(more)))), ordered=True)


#: The digests straight from the rows; the template's length by its marks and the escaped texts.
ORACLE = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT * FROM (VALUES (-7, 0, 'user', '{MARKS}'), (-7, 1, 'assistant', '{MARKS}'))),
marked AS (
  SELECT *, length(text) + len(regexp_extract_all(text, '{"|".join(re.escape(c) for c in CONTROL)}'))
         + {len(START) + 1 + len(END)} + length(role) AS chars FROM rows)
SELECT conv_id, count(*)::BIGINT AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(chars)::BIGINT AS formatted_chars
FROM marked GROUP BY conv_id
"""
