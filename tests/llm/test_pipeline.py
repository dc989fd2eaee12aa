"""The pipeline's stages, each judged on its own input."""

import hashlib
import math
import re
import string
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline as P
from assayspark.llm import bpe, mixing, secrets
from assayspark.llm.common import Workspace

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


@pytest.fixture(scope="module")
def stages(spark):
    sf = "/root/testdata/sf0.01"
    ws, docs, out = Workspace(spark, "stages"), spark.read.parquet(f"{sf}/documents.parquet"), []
    for name, f in P.STAGES:
        before, docs = docs, ws.save(f(spark, docs, sf), name)
        out.append((name, before, docs))
    return {name: (a, b) for name, a, b in out}


def test_names_and_columns(stages):
    assert [n for n, _ in P.STAGES] == ["quality_classifier", "minhash_dedup", "secret_scan", "source_mixing", "byte_bpe"]
    assert all(stages[n][1].columns == P.COLUMNS for n, _ in P.STAGES[:-1])


def test_quality_keeps_good_and_drops_poor(stages, spark):
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    a, b = stages["quality_classifier"]
    kept = {r.doc_id for r in b.collect()}
    by = {q: [r.doc_id in kept for r in labels.where(f"quality = {q}").collect()] for q in (0, 1)}
    assert np.mean(by[1]) >= 0.97 and np.mean(by[0]) <= 0.1


def test_one_of_each_group_stays(stages):
    """Against plain sets, collisions counted by shingle, and groups by joining labels."""
    a, b = stages["minhash_dedup"]
    sets, holders = {}, defaultdict(list)
    for r in a.collect():
        words = [w.decode().translate(LOWER) for w in (r.text or "").encode().split()]
        sets[r.doc_id] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    hits = Counter()
    for i in sorted(sets):
        for x in sets[i]:
            hits.update((j, i) for j in holders[x])
            holders[x].append(i)
    group = {i: i for i in sets}
    for (i, j), n in hits.items():
        if 100 * n >= 75 * (len(sets[i]) + len(sets[j]) - n):
            low, high = sorted((group[i], group[j]))
            group = {k: low if g == high else g for k, g in group.items()} if low != high else group
    want = sorted(set(group.values()))
    assert len(want) < len(sets) and sorted(r.doc_id for r in b.collect()) == want


def test_secrets_are_gone(stages):
    """Against the rules run by ``re``, overlapping spans replaced as one; nothing is found in the result."""
    a, b = stages["secret_scan"]
    before = {r.doc_id: r.text for r in a.collect()}
    after = {r.doc_id: r.text for r in b.collect()}
    assert set(before) == set(after)

    def spans(text):
        found = [m.span() for _, pattern, group, least in secrets.RULES for m in re.finditer(pattern, text) if len(m.group(group)) >= least]
        return sorted(found)

    changed = 0
    for i, text in before.items():
        out, at = [], 0
        for start, end in spans(text or ""):
            if start >= at:
                out += [text[at:start], "[SECRET]"]
            at = max(at, end)
        want = "".join(out) + text[at:] if text is not None else None
        changed += want != text
        assert after[i] == want and not spans(after[i] or "")
    assert changed


def test_mix_takes_what_it_decides(stages, spark):
    """Against the sampling written out: exponential keys by weight, sorted within the source, prefix sums to the budget."""
    a, b = stages["source_mixing"]
    weight = {r.doc_id: 1.0 if r.quality == 1 else 0.25 for r in spark.read.parquet("/root/testdata/sf0.01/labels.parquet").collect() if r.quality is not None}
    docs = [(r.doc_id, r.source, len((r.text or "").encode().split())) for r in a.collect()]
    total = Counter()
    for _, source, size in docs:
        total[source] += size
    order = sorted(total, key=lambda x: (x is None, (x or "").encode()))
    open_, target, left = {x: mixing.SOURCE_WEIGHTS[k % 3] for k, x in enumerate(order)}, {}, 1.5 * sum(total.values())
    while open_:
        level = left / sum(open_.values())
        over = [x for x, w in open_.items() if level * w > 2 * total[x]]
        if not over:
            target |= {x: level * w for x, w in open_.items()}
            break
        for x in over:
            target[x], left = 2.0 * total[x], left - 2 * total[x]
            del open_[x]
    want = []
    for x in order:
        full, used = int(target[x] // total[x]), 0
        rest = target[x] - full * total[x]
        key = lambda d: -math.log((int(hashlib.md5(f"mix-1:{d[0]}".encode()).hexdigest()[:13], 16) + 0.5) / 2**52) / weight.get(d[0], 1.0)
        for d in sorted((d for d in docs if d[1] == x), key=key):
            want += [d[0]] * (full + (d[2] > 0 and used + d[2] / 2 <= rest))
            used += d[2]
    assert sorted(r.doc_id for r in b.collect()) == sorted(want)


def test_tokens_decode_to_the_text(stages):
    a, b = stages["byte_bpe"]
    codec = bpe.public_codec()
    texts = {r.doc_id: (r.text or "").encode() for r in a.collect()}
    got = b.collect()
    assert len(got) == a.count()
    for r in got:
        assert codec.decode(np.array(r.ids, dtype=np.int64)) == texts[r.doc_id] and r.n_tokens == len(r.ids)
        assert r.decoded_sha256 == hashlib.sha256(texts[r.doc_id]).hexdigest()


def test_rows_without_id_and_empty_tables(spark):
    sf = "/root/testdata/sf0.001"
    rows = [(None, "some words here to keep", "en", "a", 1), (None, None, None, None, None), (1, "", "en", "a", 0), (2, "x y z", "en", "b", 5), (2, "x y z", "en", "b", 5)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    for name, f in P.STAGES[1:]:
        f(spark, docs, sf).collect()
        assert f(spark, docs.limit(0), sf).count() == 0
    assert P.drop_near_duplicates(spark, docs, sf).where("doc_id = 2").count() == 1


def test_one_id_with_several_texts_is_several_documents(spark):
    text = lambda k: " ".join(f"{k}w{i}" for i in range(40))
    # 5 stands for three texts: one is close to document 3, one to document 7, one stands twice.
    texts = [(3, text("a")), (5, text("a") + " more"), (5, text("b")), (7, text("b") + " more"), (5, text("c")), (5, text("c")), (5, None), (None, text("a"))]
    docs = spark.createDataFrame([(i, t, "en", "a", 1) for i, t in texts], "doc_id long, text string, lang string, source string, n_chars long")
    got = P.drop_near_duplicates(spark, docs, "").select("doc_id", "text").collect()
    want = [(3, text("a")), (5, text("b")), (5, text("c")), (5, None), (None, text("a"))]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
