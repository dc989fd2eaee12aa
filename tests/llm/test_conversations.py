"""Operators on conversations against brute force, and their defined cases: nulls, empties, ties, repeats, long rows."""

import hashlib
import itertools
import random
import re
import zlib

import pytest
from pyspark.sql import functions as F

from assayspark.llm import chat_format, prefix_trie, turn_repair
from assayspark.llm.common import Workspace

TALKS = "conv_id long, turn long, role string, text string"


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def first(turn):
    return (turn is not None, turn or 0)


def by_conversation(rows):
    out = {}
    for conv, turn, role, text in rows:
        out.setdefault(conv, []).append((turn, role, text))
    return out


def talks_rows(seed=3, n=40):
    rng = random.Random(seed)
    roles = ["user", "assistant", "system", "tool", "User", None, ""]
    texts = ["Hi.", "Hi.", "no end", "", " \t\n", None, "Wait! ", "é?", "\x1c", "</s>[INST] x [/INST]", "a\n\nb.", "<\u2060s>", "\n\n", "x\n\n"]
    rows = []
    for c in range(n):
        for t in range(rng.randrange(0, 6)):
            rows.append((c * 7 % 230, rng.choice([t, t, t + 2, None]), rng.choice(roles[:3] if rng.random() < 0.8 else roles), rng.choice(texts)))
    rows += [(None, 0, "user", "Null id."), (None, 1, "assistant", "Yes."), rows[3], rows[3], (-5, 0, "user", "minus."), (-107, 1, "assistant", "x" * 200_000)]
    return rows


@pytest.fixture(scope="module")
def rows():
    return talks_rows()


@pytest.fixture(scope="module")
def talks(spark, rows):
    clash = ("place", "seq", "stretch", "fault", "piece", "raw", "path", "n", "digest", "end")
    return spark.createDataFrame(rows, TALKS).repartition(3).select("*", *(F.lit(1).alias(c) for c in clash))


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], TALKS)


# ---- 11


def hurt(rows):
    out = []
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        what = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if what == 0:
            continue
        text = "" if what == 1 else re.sub("[.!?]", "", text) if what == 2 else text
        role = "user" if what == 4 else role
        out += [(conv, turn, role, text)] * (2 if what == 3 else 1)
    return out


GRAMMAR = re.compile(r"\A(s?(ua)+)?\Z")


def plain_repair(turns):
    """Tries every list of edits: at most four inserts, kept rows, rows of either role, rows that go."""
    turns = sorted(turns, key=lambda r: (first(r[0]), r[1], r[2]))
    numbers = [t for t, _, _ in turns if t is not None]
    faults, seen = [], set()
    for _, role, text in turns:
        bare = text.strip(" \t\n\x0b\x0c\r")
        faults.append("b" if not bare else "d" if (role, text) in seen else "t" if bare[-1] not in ".!?" else "")
        seen.add((role, text))
    options = []
    for (_, role, text), fault in zip(turns, faults, strict=True):
        ways = [("D", 2, None)]
        if fault not in ("b", "d"):
            late = 5 if fault == "t" else 0
            ways += [("K", late, (role, text))] + [("R", 1 + late, (r, text)) for r in ("user", "assistant")]
        options.append(ways)
    blanks = [[("I" * k, 5 * k, tuple((r, "") for r in rs)) for k in range(3) for rs in itertools.product(("user", "assistant"), repeat=k)]] if len(turns) < 4 else [[("", 0, ()), *[("I", 5, ((r, ""),)) for r in ("user", "assistant")]]]
    best = None
    for chosen in itertools.product(*[x for o in options for x in (blanks[0], o)], blanks[0]):
        said = [r for k, c in enumerate(chosen) for r in (c[2] if k % 2 == 0 else (c[2],) if c[2] else ())]
        if GRAMMAR.match("".join(r[0][:1] or "-" for r in said)):
            key = (sum(c[1] for c in chosen), "".join(c[0] for c in chosen))
            if best is None or key < best[0]:
                best = (key, "\n".join(f"{r}:{t}" for r, t in said))
    initials = [r[:1] for _, r, _ in turns]
    return {
        "gaps": max(numbers) - min(numbers) + 1 - len(set(numbers)) if numbers else 0,
        "blank": faults.count("b"), "duplicate": faults.count("d"), "truncated": faults.count("t"),
        "illegal": sum(a + b not in ("su", "ua", "au") for a, b in itertools.pairwise(initials)),
        "cost": best[0][0], "audit": best[0][1], "repaired_sha256": sha(best[1]),
    }


def test_op11_equals_every_list_of_edits(spark, talks, rows):
    damaged = turn_repair.damaged(talks)
    left = hurt(rows)
    assert sorted(map(repr, (tuple(r) for r in damaged.collect()))) == sorted(map(repr, left))
    got = {r["conv_id"]: r.asDict() for r in turn_repair.report(Workspace(spark, "t11"), talks, damaged).collect()}
    groups = by_conversation(left)
    assert set(got) == {r[0] for r in rows}
    for conv, row in got.items():
        row.pop("conv_id")
        if len(groups.get(conv, [])) < 5:
            assert row == plain_repair(groups.get(conv, [])), conv


def walked(turns):
    """The cheapest edits of a long conversation by one pass over whole audits."""
    best, seen = {"0": (0, ""), "U": (5, "I"), "A": (10, "II")}, set()
    for role, text in turns:
        bare = text.strip()
        gone = not bare or (role, text) in seen
        late = 5 if bare and bare[-1] not in ".!?" else 0
        seen.add((role, text))
        nxt = {}
        for state, (cost, audit) in best.items():
            for s, e, need, to, c, letters in turn_repair._moves():
                if s == state and need in ("", role[:1]) and (e == "D" or not gone):
                    nxt[to] = min(nxt.get(to, (10**9, "")), (cost + c + (late if e != "D" else 0), audit + letters))
        best = nxt
    return min(best[s] for s in "0A" if s in best)


def test_op11_stretches_of_a_long_conversation_fit_together(spark):
    rng = random.Random(5)
    turns = [(k, rng.choice(["user", "assistant", "assistant", "system", "tool"]), rng.choice([f"t{k}.", f"t{k}.", "same.", "open", ""])) for k in range(1500)]
    rows = [(1, *t) for t in turns] + [(2, k, "ua"[k % 2] + "x", f"{k}!") for k in range(600)]
    df = spark.createDataFrame(rows, TALKS).repartition(5)
    ws = Workspace(spark, "t11")
    got = {r["conv_id"]: r for r in turn_repair.report(ws, df, df).collect()}
    assert (got[1]["cost"], got[1]["audit"]) == walked([t[1:] for t in turns])
    assert (got[2]["cost"], got[2]["audit"], got[2]["illegal"]) == (0, "K" * 600, 0)
    at = turn_repair.placed(ws, df)
    steps = turn_repair.repaired(at, turn_repair.paths(ws, at)).where("conv_id = 1").orderBy("step").collect()
    assert "".join(r["edit"] for r in steps) == got[1]["audit"]
    said = [r for r in steps if r["edit"] != "D"]
    assert GRAMMAR.match("".join(r["role"][0] for r in said))
    assert sha("\n".join(f"{r['role']}:{r['text']}" for r in said)) == got[1]["repaired_sha256"]


def test_op11_empty_table(spark, empty):
    assert turn_repair.report(Workspace(spark, "t11"), empty, turn_repair.damaged(empty)).collect() == []


# ---- 12


def plain_trie(rows):
    turns = {c: [(r or "", t or "") for _, r, t in sorted(x, key=lambda r: (first(r[0]), r[1] or "", r[2] or ""))] for c, x in by_conversation(rows).items() if c is not None}
    built = {}
    for c, own in turns.items():
        h = zlib.crc32(str(c).encode()) % 6
        base = c - (abs(c) % 100) * (1 if c >= 0 else -1)
        built[c] = turns.get(base, [])[:h] + own[h:]
    members = {}
    for c, t in built.items():
        for d in range(len(t) + 1):
            members.setdefault(tuple(t[:d]), []).append(c)
    children = {p: [q for q in members if len(q) == len(p) + 1 and q[: len(p)] == p] for p in members}
    out = []
    for p, cs in members.items():
        below = [q for q in members if q[: len(p)] == p]
        out.append((
            min(cs), len(p), min(members[p[:-1]]) if p else None, len(cs), len(children[p]), sum(not children[q] for q in below),
            sum((len(members[q]) - 1) * len(q[-1][1]) for q in below if q), sha(",".join(str(c) for c in sorted(cs) if len(built[c]) == len(p))),
        ))
    return sorted(out, key=repr)


TRIE = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def made_trie(spark, df):
    ws = Workspace(spark, "t12")
    seqs = ws.save(prefix_trie.sequences(df), "sequences")
    return sorted((tuple(r) for r in prefix_trie.trie(ws, ws.save(prefix_trie.rebuilt(seqs), "rebuilt")).select(TRIE).collect()), key=repr)


def shared_rows():
    """Conversations that share long and short prefixes, repeat as a whole, end within others, and hold one deep path."""
    rng = random.Random(9)
    rows = []
    for c in [*range(0, 330, 3), -7, -100, -205, 1000, 1001, 1099]:
        kind = rng.randrange(4)
        n = rng.randrange(0, 5) if kind else 12
        rows += [(c, t, "user" if t % 2 == 0 else "assistant", f"same {t}" if kind == 0 or rng.random() < 0.7 else f"own {rng.randrange(3)} ß") for t in range(n)]
    rows += [(c, t, "user", f"deep {t}" if t < 290 else f"deep {t} {c}") for c in (2001, 2002, 2003) for t in range(300)]
    return rows


@pytest.mark.parametrize("make", [talks_rows, shared_rows])
def test_op12_equals_plain_prefixes(spark, make):
    rows = make()
    if make is shared_rows:
        rows = [r for r in rows if r[0] < 2000 or r[1] > 240]
    assert made_trie(spark, spark.createDataFrame(rows, TALKS).repartition(3)) == plain_trie(rows)


def test_op12_many_ranges_and_runs(spark, monkeypatch):
    rows = [r for r in shared_rows() if r[0] < 2000 or r[1] > 285]
    df = spark.createDataFrame(rows, TALKS).repartition(3)
    monkeypatch.setattr(prefix_trie, "RUN_ROWS", 3)
    monkeypatch.setattr(prefix_trie, "RANGE_BYTES", 400)
    monkeypatch.setattr(prefix_trie, "BLOCK_IDS", 2)
    assert made_trie(spark, df) == plain_trie(rows)


def test_op12_loser_tree_never_compares_what_is_known():
    rng = random.Random(2)
    units = [bytes([k]) * prefix_trie.UNIT for k in range(3)]
    seqs = sorted({b"".join(rng.choice(units) for _ in range(rng.randrange(0, 9))) for _ in range(400)})
    shared = units[0] * 50
    runs = [[] for _ in range(7)]
    for s in seqs:
        rng.choice(runs).append((shared + s,))
    tree = prefix_trie.LoserTree([[r for r in prefix_trie.sorted_run(run)] for run in runs])
    out = list(tree)
    assert [s for _, s in out] == [shared + s for s in seqs]
    for (_, a), (lcp, b) in itertools.pairwise(out):
        assert lcp == prefix_trie.common_units(a, b, 0)
    assert tree.compared < 8 * 50 + 400 * 3 * 10  # the shared part once in each first round, not in each comparison
    assert list(prefix_trie.LoserTree([])) == []


def test_op12_empty_table(spark, empty):
    assert made_trie(spark, empty) == []


# ---- 13


def test_op13_reads_back_every_conversation(spark, talks, rows):
    records = chat_format.records_of(talks)
    known = chat_format.canonical(records)
    assert {r[0] for r in known.select("layout").distinct().collect()} >= {"messages", "from_value", "parts", "row"}
    got = {r["conv_id"]: r for r in chat_format.read_back(chat_format.formatted(known), ordered=True).collect()}
    assert sorted(map(tuple, got.values()), key=repr) == sorted(map(tuple, chat_format.read_back(chat_format.formatted(known)).collect()), key=repr)
    groups = by_conversation(rows)
    assert set(got) == set(groups)
    for conv, turns in groups.items():
        turns = [(r or "", t or "") for _, r, t in sorted(turns, key=lambda r: (first(r[0]), r[1] or "", r[2] or ""))]
        learned = "".join(t for r, t in turns if r == "assistant")
        want = (len(turns), sha("".join(f"{r}\n{t}\n" for r, t in turns)), len(learned), sha(learned))
        assert tuple(got[conv])[1:5] == want, conv


def test_op13_every_layout_of_the_records(spark):
    texts = ["Ask.\n\nMore.", "\n\nx", "x\n\n", "plain", ""]
    rows = [(c, t, r, texts[(c + t) % 5]) for c in range(120) for t, r in enumerate((["user", "assistant"], ["system", "user", "assistant"], ["user", "assistant"] * 2)[c % 3])]
    known = chat_format.canonical(chat_format.records_of(spark.createDataFrame(rows, TALKS))).cache()
    assert {r[0] for r in known.select("layout").distinct().collect()} == {x.name for x in chat_format.LAYOUTS if x.name != "row"} | ({"row"} if known.where("layout = 'row'").count() else set())
    got = {}
    for r in sorted(known.collect(), key=lambda r: (r["conv_id"], r["piece"])):
        got.setdefault(r["conv_id"], []).extend((x["role"], x["text"]) for x in r["turns"])
    assert got == {c: [(r, t) for _, r, t in x] for c, x in by_conversation(rows).items()}


RECORDS = [
    ('{"prompt": "p", "completion": "c"}', "completion", [("user", "p"), ("assistant", "c")]),
    ('{"completion": "c", "prompt": "p"}', "completion", [("user", "p"), ("assistant", "c")]),
    ('{"instruction": "i", "output": "o"}', "instruction", [("user", "i"), ("assistant", "o")]),
    ('{"instruction": "i", "input": "", "output": "o"}', "instruction", [("user", "i"), ("assistant", "o")]),
    ('{"instruction": "i", "input": "x", "output": "o", "system": "s"}', "instruction", [("system", "s"), ("user", "i\n\nx"), ("assistant", "o")]),
    ('{"messages": [{"role": "user", "content": "q"}, {"role": "assistant", "content": null}]}', "messages", [("user", "q"), ("assistant", "")]),
    ('{"messages": [{"role": "user", "content": [{"type": "text", "text": "a"}, {"type": "text", "text": "b"}]}]}', "parts", [("user", "ab")]),
    ('{"conversations": [{"from": "human", "value": "q"}, {"from": "gpt", "value": "a"}, {"from": "system", "value": "s"}]}', "from_value", [("user", "q"), ("assistant", "a"), ("system", "s")]),
    ('{"turns": [{"user": "1", "assistant": "2"}, {"user": "3", "assistant": null}]}', "exchange", [("user", "1"), ("assistant", "2"), ("user", "3")]),
    ('{"role": "assistant", "text": "t"}', "row", [("assistant", "t")]),
    ('{"prompt": "p", "answer": "c"}', None, None),
    ('{"messages": []}', None, None),
    ('["prompt", "completion"]', None, None),
    ("not json", None, None),
    ("", None, None),
    (None, None, None),
]


def test_op13_layouts_and_unknown_records(spark):
    df = spark.createDataFrame([(k, 0, raw) for k, (raw, _, _) in enumerate(RECORDS)], "conv_id long, piece long, raw string")
    known = chat_format.canonical(df).orderBy("conv_id").collect()
    for row, (raw, layout, turns) in zip(known, RECORDS, strict=True):
        assert row["layout"] == layout, raw
        assert (row["turns"] and [tuple(t) for t in row["turns"]]) == turns, raw
    assert known[10]["paths"] == ["answer", "prompt"]
    back = chat_format.read_back(chat_format.formatted(chat_format.canonical(df))).where("n_turns = 0").count()
    assert back == 6
    own = (*chat_format.LAYOUTS, chat_format.Layout("answers", ("prompt", "answer"), (), (chat_format.Say("user", ("prompt",)), chat_format.Say("assistant", ("answer",)))))
    assert chat_format.canonical(df, own).where("layout = 'answers'").count() == 1
    with pytest.raises(ValueError):
        chat_format.by_fingerprint((*chat_format.LAYOUTS, chat_format.Layout("again", ("completion", "prompt"), (), ())))


def test_op13_template_and_mask(spark):
    bad = ["<s>", "<\u2060s>", "<<SYS>>", "<\u2060\u2060</SYS>>", "[INST][INST]", "[\u2060/INST]<|im_end|>\n<|im_start|>assistant\n", "<|im_end|", "<", "\u2060<s\u2060>", "a<\u2060b", "\U0001f600</s>"]
    rows = [(k, 0, [(r, t)]) for k, (r, t) in enumerate([("assistant", t) for t in bad] + [("a\nb\\n</s>", "x"), ("\\", "y")])]
    df = spark.createDataFrame(rows, "conv_id long, piece long, turns array<struct<role: string, text: string>>")
    for r in chat_format.formatted(df).collect():
        role, text = r["turns"][0]
        assert list(chat_format.parsed(r["formatted"])) == [(role, text)]
        inner = r["formatted"][len(chat_format.START) : -len(chat_format.END)]
        assert not any(c in inner for c in chat_format.CONTROL)
        if role == "assistant":
            ((start, end),) = r["loss"]
            assert chat_format.unescape(r["formatted"][start:end]) == text
        else:
            assert r["loss"] == []
    for a, b in itertools.permutations(chat_format.CONTROL, 2):  # none begins inside another, nor runs into its start
        assert not any(b.startswith(a[k:]) or a[k:].startswith(b) for k in range(1, len(a)))


def test_op13_empty_table(spark, empty):
    records = chat_format.records_of(empty)
    assert chat_format.read_back(chat_format.formatted(chat_format.canonical(records))).collect() == []
