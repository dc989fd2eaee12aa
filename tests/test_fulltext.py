"""Searches over the positional index against word lists, and what the plan reads."""

import random

import pytest

from assayspark.operators import fulltext as X

COLUMNS = ["name", "notes"]
WORDS = ["red", "reddish", "green", "blue", "a", "b", "c", "über"]


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(4)
    text = lambda: " ".join(rng.choice(WORDS) for _ in range(rng.randrange(0, 12)))
    made = [(k, text(), text()) for k in range(300)]
    return [*made, (300, None, None), (301, "", "..."), (302, "Über  RED-green", "Ubér1"), (None, "red", "red"), (303, "a b " * 3000, None)]


@pytest.fixture(scope="module")
def index(spark, rows, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "i")
    df = spark.createDataFrame(rows, "id long, name string, notes string").repartition(3)
    X.write_index(X.positional_index(df, "id", COLUMNS), "id", path)
    return X.open_index(spark, path)


def parts(text):
    return X.words(text)


def starts(text, words, prefix=False):
    same = lambda a, b, last: a.startswith(b) if prefix and last else a == b
    n = len(words)
    return [k for k in range(len(text) - n + 1) if all(same(text[k + j], words[j], j == n - 1) for j in range(n))]


def has(row, words, prefix=False, first=False, columns=(1, 2)):
    return any(s == 0 or not first for c in columns for s in starts(parts(row[c]), words, prefix))


def near(row, sides, distance):
    for c in (1, 2):
        found = [[(s, s + len(w)) for s in starts(parts(row[c]), w)] for w in sides]
        for k, mine in enumerate(found):
            for s, e in mine:
                if all(any(s <= t <= e + distance for t, _ in other) for n, other in enumerate(found) if n != k):
                    return True
    return False


CASES = [
    (X.phrase("red green"), lambda r: has(r, ["red", "green"])),
    (X.phrase("RED"), lambda r: has(r, ["red"])),
    (X.phrase("uber"), lambda r: has(r, ["uber"])),
    (X.phrase("Übér", prefix=True), lambda r: has(r, ["uber"], prefix=True)),
    (X.phrase("a red", prefix=True), lambda r: has(r, ["a", "red"], prefix=True)),
    (X.phrase("red", first=True), lambda r: has(r, ["red"], first=True)),
    (X.phrase("red", columns=["notes"]), lambda r: has(r, ["red"], columns=(2,))),
    (X.phrase("a a"), lambda r: has(r, ["a", "a"])),
    (X.phrase("red") & X.phrase("blue"), lambda r: has(r, ["red"]) and has(r, ["blue"])),
    (X.phrase("red") | X.phrase("b c"), lambda r: has(r, ["red"]) or has(r, ["b", "c"])),
    (X.phrase("red") - (X.phrase("blue") | X.phrase("a")), lambda r: has(r, ["red"]) and not has(r, ["blue"]) and not has(r, ["a"])),
    (X.near("red", "blue", distance=2), lambda r: near(r, [["red"], ["blue"]], 2)),
    (X.near("red green", "b", "c", distance=3), lambda r: near(r, [["red", "green"], ["b"], ["c"]], 3)),
    (X.near("a", "b", distance=0), lambda r: near(r, [["a"], ["b"]], 0)),
    (X.all_words("green, blue. green"), lambda r: has(r, ["green"]) and has(r, ["blue"])),
    (X.phrase("..."), lambda r: False),
    (X.phrase("red") & X.phrase(""), lambda r: False),
    (X.phrase("nowhere"), lambda r: False),
]


def test_every_kind_of_search(index, rows):
    got = {}
    for r in X.matches(index, "id", {str(k): s for k, (s, _) in enumerate(CASES)}, COLUMNS).collect():
        got.setdefault(r["search"], []).append(r["id"])
    for k, (_, holds) in enumerate(CASES):
        assert sorted(got.get(str(k), [])) == [r[0] for r in rows if r[0] is not None and holds(r)], k
    assert all(got.get(str(k)) for k in range(15))


def test_words_are_folded():
    assert X.words("Ünïcode ÉTÉ, a_b c-d 12x! ẞ œ łż") == ["unicode", "ete", "a", "b", "c", "d", "12x", "ß", "œ", "łz"]
    assert X.words("e\u0301te\u0301 \u0301 x") == ["ete", "x"] and X.words(None) == X.words(" .,") == []


def test_first_k_by_key(index):
    assert [r["id"] for r in X.search(index, "id", X.phrase("red"), COLUMNS, k=3).collect()] == sorted(r["id"] for r in X.search(index, "id", X.phrase("red"), COLUMNS).collect())[:3]


def test_words_reach_the_scan_and_a_search_shuffles_once(index):
    plan = X.search(index, "id", X.phrase("red green") | X.phrase("bl", prefix=True), COLUMNS)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [Or(In(word, [green,red]),StringStartsWith(word,bl))" in plan
    assert plan.count("Exchange hashpartitioning") == 1


def test_empty_table(spark):
    df = spark.createDataFrame([], "id long, name string, notes string")
    assert X.search(X.positional_index(df, "id", COLUMNS), "id", X.phrase("red"), COLUMNS).collect() == []


def test_index_comes_in_sorted_runs(spark, tmp_path, monkeypatch):
    import pyarrow.parquet as pq

    monkeypatch.setattr(X, "HANDED", 50)
    monkeypatch.setattr(X, "RUN", 300)
    monkeypatch.setattr(X, "GROUP", 100)
    df = spark.createDataFrame([(k, f"w{k % 7} w{k % 11} w{k % 13} w1") for k in range(400)], "id long, t string").coalesce(1)
    made = X.positional_index(df, "id", ["t"])
    X.write_index(made, "id", f"file://{tmp_path}/i")
    (file,) = tmp_path.glob("i/*.parquet")
    got = pq.ParquetFile(file)
    words = [(r["word"], r["id"]) for r in got.read(columns=["word", "id"]).to_pylist()]
    assert got.num_row_groups >= len(words) // 100 and sum(a > b for a, b in zip(words, words[1:], strict=False)) <= len(words) // 300
    assert sorted(words) == sorted({(w, k) for k in range(400) for w in (f"w{k % 7}", f"w{k % 11}", f"w{k % 13}", "w1")})
