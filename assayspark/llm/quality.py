"""Quality classifier by positive-unlabelled learning with the non-negative risk estimator.

Trusted positives are reviewed good texts; all other text is unlabelled, a mixture of good and poor in an
unknown proportion. A small net on byte-class statistics is fitted by minimising
``prior * R_p(+) + max(0, R_u(-) - prior * R_p(-))``; where the second part would turn negative (the model
starts to fit single positives) the step goes back along it, as in non-negative risk minimisation. The
class prior is estimated from the same scores: over all documents, the share of unlabelled text in the
region where a first model puts the positives, over the share of the positives there, least over regions.

The net's hidden layer is fitted on a bounded sample (``max_positive`` labelled positives, ``max_unlabelled``
others, those with the smallest hashes). Its output layer is then fitted to all rows of the training part: in
it the risk is convex, so a few Newton steps, each one pass that sums slopes and curvatures in the tasks,
minimise it over every unlabelled text and every positive, as long as the second part stays above zero.
Means, spreads, the prior's counts and the scores cover all documents.

Defined cases: null text is the empty text and is scored; null doc_id is never in the training part and
is reported as held out; repeated rows get equal scores; a label row without a document or with a null
quality is ignored; several label rows of a document count as positive only if all are; without any
positive every score is 0; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Workspace, crc_mod, small_batches, table

#: Rows that the hidden layer is fitted on.
MAX_POSITIVE, MAX_UNLABELLED = 6000, 12000
#: A text is good from this score on.
THRESHOLD = 0.7
#: Bins of a first model's score over which the prior's shares are taken.
BINS = 200


def _byte_classes() -> np.ndarray:
    kind = np.full(256, 9, dtype=np.uint8)  # other symbols
    for k, chars in enumerate((b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz", b"0123456789", b" ", b"\n", b"\t\r\x0b\x0c", b".,;:", b"!?", b"\"'()-")):
        kind[list(chars)] = k
    kind[0x80:0xC0] = 10  # inside a character
    kind[0xC0:] = 11  # first byte of a character beyond ASCII
    return kind


CLASSES = _byte_classes()
N_CLASSES = 12
#: Class shares, shares of class pairs, then figures of words and lines.
N_WORDS = 10
N_FEATURES = N_CLASSES + N_CLASSES**2 + N_WORDS


def features(texts: list[str | None]) -> np.ndarray:
    """Statistics of whole texts, a row for each; no dictionary and nothing but the text goes in."""
    raw = [(t or "").encode("utf-8", "surrogatepass") for t in texts]
    out = np.zeros((len(raw), N_FEATURES), dtype=np.float32)
    for k, text in enumerate(raw):
        n = len(text)
        if not n:
            continue
        kind = CLASSES[np.frombuffer(text, dtype=np.uint8)]
        out[k, :N_CLASSES] = np.bincount(kind, minlength=N_CLASSES) / n
        pair = kind[:-1].astype(np.int16) * N_CLASSES + kind[1:]
        out[k, N_CLASSES : N_CLASSES + N_CLASSES**2] = np.bincount(pair, minlength=N_CLASSES**2) / n
        words, lines = text.split(), text.split(b"\n")
        m, distinct = max(1, len(words)), len(set(words))
        sizes = np.fromiter(map(len, words), dtype=np.int64, count=len(words)) if words else np.zeros(1)
        repeats = sum(a == b for a, b in zip(words, words[1:], strict=False)) / m
        pairs = len(set(zip(words, words[1:], strict=False))) / max(1, m - 1)
        out[k, -N_WORDS:] = (
            distinct / m, np.log1p(m) / 10, np.log1p(distinct) / np.log1p(m), sizes.mean() / 10, sizes.std() / 10,
            len(set(lines)) / len(lines), np.log1p(len(lines)) / 10, min(1.0, 5 * repeats), pairs, max(0.0, 0.5 - pairs),
        )
    return out


def _features_table(docs: DataFrame) -> DataFrame:
    small_batches(docs.sparkSession)
    keep = [f for f in docs.schema.fields if f.name != "text"]

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = features(b.column("text").to_pylist())
            cols = [b.column(f.name) for f in keep]
            yield pa.RecordBatch.from_arrays([*cols, pa.array([r.tobytes() for r in x], pa.binary())], names=[*(f.name for f in keep), "x"])

    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in keep), "x binary"])
    return docs.mapInArrow(work, schema)


def _moments(table_: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """Mean and spread of each feature over all documents; each task sends one row of sums."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n, total, square = 0, np.zeros(N_FEATURES), np.zeros(N_FEATURES)
        for b in batches:
            x = _matrix(b.column("x"))
            n, total, square = n + len(x), total + x.sum(axis=0), square + (x * x).sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([total.tolist()]), pa.array([square.tolist()])], names=["n", "total", "square"])

    parts = table_.select("x").mapInArrow(work, "n long, total array<double>, square array<double>")
    sums = [F.sum(F.try_element_at(c, F.lit(i + 1))).alias(f"{c}{i}") for c in ("total", "square") for i in range(N_FEATURES)]
    got = list(parts.agg(F.sum("n").alias("n"), *sums).first())
    n = max(1, got[0] or 0)
    mean = np.array([v or 0.0 for v in got[1 : 1 + N_FEATURES]]) / n
    return mean, np.sqrt(np.maximum(np.array([v or 0.0 for v in got[1 + N_FEATURES :]]) / n - mean**2, 1e-8))


def _matrix(column: pa.Array) -> np.ndarray:
    rows = column.to_pylist()
    return np.frombuffer(b"".join(rows), dtype=np.float32).reshape(len(rows), N_FEATURES).astype(np.float64)


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


class Net:
    """One hidden layer of rectified units and a logistic output."""

    def __init__(self, inputs: int, hidden: int, rng: np.random.Generator) -> None:
        self.a, self.b = rng.normal(0, np.sqrt(2 / inputs), (inputs, hidden)), np.zeros(hidden)
        self.c, self.d = rng.normal(0, np.sqrt(1 / hidden), hidden), np.zeros(1)

    def parts(self) -> list[np.ndarray]:
        return [self.a, self.b, self.c, self.d]

    def raw(self, x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = np.maximum(x @ self.a + self.b, 0)
        return h, h @ self.c + self.d[0]

    def slopes(self, x: np.ndarray, h: np.ndarray, g: np.ndarray) -> list[np.ndarray]:
        """Slopes of all parts where ``g`` is the slope of the risk by each row's output."""
        back = np.outer(g, self.c) * (h > 0)
        return [x.T @ back, back.sum(axis=0), h.T @ g, np.array([g.sum()])]


def fit_nnpu(p: np.ndarray, u: np.ndarray, prior: float, *, hidden: int = 32, steps: int = 2500, batch: int = 256, rate: float = 2e-3, decay: float = 1e-3, seed: int = 7) -> Net:
    """A small net that minimises the non-negative risk with the logistic loss by Adam on mixed batches."""
    rng = np.random.default_rng(seed)
    net = Net(p.shape[1], hidden, rng)
    m, v = [np.zeros_like(w) for w in net.parts()], [np.zeros_like(w) for w in net.parts()]
    rest = 0.0
    for step in range(1, steps + 1):
        xp, xu = p[rng.integers(0, len(p), batch)], u[rng.integers(0, len(u), 2 * batch)]
        (hp, zp), (hu, zu) = net.raw(xp), net.raw(xu)
        sp, su = _sigmoid(zp), _sigmoid(zu)
        # R_u(-) - prior * R_p(-): if that is negative, only step back along it.
        # One batch is too noisy to tell the sign, so a running mean is used.
        rest += (0.03 if step > 1 else 1) * (np.logaddexp(0, zu).mean() - prior * np.logaddexp(0, zp).mean() - rest)
        gu, gp = su / len(xu), -prior * sp / len(xp)
        if rest < 0:
            gu, gp = -gu, -gp
        else:
            gp = gp - prior * (1 - sp) / len(xp)
        both = zip(net.parts(), net.slopes(xp, hp, gp), net.slopes(xu, hu, gu), m, v, strict=True)
        now = rate * (0.1 if step > 0.8 * steps else 1)
        for w, g1, g2, mi, vi in both:
            g = g1 + g2 + decay * w
            mi += 0.1 * (g - mi)
            vi += 0.001 * (g * g - vi)
            w -= now * (mi / (1 - 0.9**step)) / (np.sqrt(vi / (1 - 0.999**step)) + 1e-8)
    return net


def fit_contrast(p: np.ndarray, u: np.ndarray) -> np.ndarray:
    """A first model that only tells positives from unlabelled text, for the prior."""
    x = np.r_[np.c_[p, np.ones(len(p))], np.c_[u, np.ones(len(u))]]
    y = np.r_[np.ones(len(p)), np.zeros(len(u))]
    weight = np.r_[np.full(len(p), 0.5 / len(p)), np.full(len(u), 0.5 / len(u))]
    w = np.zeros(x.shape[1])
    for _ in range(30):  # Newton steps with a small ridge
        s = _sigmoid(x @ w)
        h = (x * (weight * s * (1 - s))[:, None]).T @ x + 1e-3 * np.eye(x.shape[1])
        step = np.linalg.solve(h, x.T @ (weight * (y - s)) - 1e-3 * w)
        w += step
        if np.abs(step).max() < 1e-6:
            break
    return w


def prior_from(pos: np.ndarray, unl: np.ndarray, least: float = 0.5) -> float:
    """Share of positives in unlabelled text from counts by score bin, highest score first.

    If the top region held positives only, its unlabelled share over its positive share were the prior;
    the least ratio over regions with enough positives is taken.
    """
    p, u = np.cumsum(pos[::-1]), np.cumsum(unl[::-1])
    if not p[-1] or not u[-1]:
        return 0.5
    fp, fu = p / p[-1], u / u[-1]
    ok = fp >= least
    return float(np.clip((fu[ok] / fp[ok]).min(), 0.05, 0.98))


class Model:
    """A fitted classifier; without a net every score is 0."""

    def __init__(self, mean: np.ndarray, spread: np.ndarray, net: Net | None, prior: float) -> None:
        self.mean, self.spread, self.net, self.prior = mean, spread, net, prior

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread, -8, 8)

    def score(self, x: np.ndarray) -> np.ndarray:
        return _sigmoid(self.net.raw(self.scaled(x))[1]) if self.net and len(x) else np.zeros(len(x))


def _half() -> Column:
    """Documents whose counts give the prior; the other half fits the first model, so that it isn't flattered."""
    return F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2)) == 1


def _sample(rows: DataFrame, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Features of the ``n`` rows with the smallest hashes, and which half they are of."""
    got = rows.orderBy(F.xxhash64("doc_id"), "doc_id", "x").limit(n).select("x", _half().alias("half")).toArrow().combine_chunks()
    if not len(got):
        return np.zeros((0, N_FEATURES)), np.zeros(0, dtype=bool)
    return _matrix(got.column("x")), np.array(got.column("half").to_pylist(), dtype=bool)


def _sums(part: DataFrame, model: Model, c: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, float, float, float, float]:
    """Over all rows, with output weights ``c`` (the last is the offset): the sums that the risk and its derivatives are made of.

    Of positives: number, hidden values, softplus; of the others: number, slopes, curvatures, softplus.
    """
    size = len(c)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(4 + 2 * size + size * size)
        for b in batches:
            if not len(b):
                continue
            h = np.c_[model.net.raw(model.scaled(_matrix(b.column("x"))))[0], np.ones(len(b))]
            good = np.array([g == 1 for g in b.column("good").to_pylist()], dtype=bool)
            z = h @ c
            s, soft, u = _sigmoid(z), np.logaddexp(0, z), ~good
            curve = (h[u] * (s[u] * (1 - s[u]))[:, None]).T @ h[u]
            total += np.r_[good.sum(), u.sum(), soft[good].sum(), soft[u].sum(), h[good].sum(axis=0), s[u] @ h[u], curve.ravel()]
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(total), dtype=np.int32)), pa.array(total)], names=["at", "v"])

    got = part.select("good", "x").mapInArrow(work, "at int, v double").groupBy("at").agg(F.sum("v").alias("v")).orderBy("at").collect()
    t = np.array([r["v"] for r in got]) if got else np.zeros(4 + 2 * size + size * size)
    return t[4 : 4 + size], t[4 + size : 4 + 2 * size], t[4 + 2 * size :].reshape(size, size), *t[:4]


def fit_output(part: DataFrame, model: Model, prior: float, steps: int = 6, decay: float = 1e-2) -> None:
    """Newton steps on the output layer over all rows; a step that would make the non-negative part negative is halved or left out."""
    c = np.r_[model.net.c, model.net.d]
    sums = _sums(part, model, c)
    for _ in range(steps):
        hp, slope, curve, n_p, n_u, soft_p, soft_u = sums
        if not n_p or not n_u:
            return
        grad = slope / n_u - prior * hp / n_p + decay * c
        step = np.linalg.solve(curve / n_u + decay * np.eye(len(c)), grad)
        risk = lambda s, w: s[6] / s[4] - prior * (s[0] @ w) / s[3] + decay / 2 * (w @ w)
        now, scale = risk(sums, c), 1.0
        while scale > 0.1:
            new = _sums(part, model, c - scale * step)
            if new[6] / new[4] >= prior * new[5] / new[3] and risk(new, c - scale * step) <= now:
                break
            scale /= 2
        else:
            return
        c, sums = c - scale * step, new
        model.net.c, model.net.d = c[:-1], c[-1:]
        if np.abs(scale * step).max() < 1e-3:
            return


def train(feats: DataFrame, *, max_positive: int = MAX_POSITIVE, max_unlabelled: int = MAX_UNLABELLED) -> Model:
    """Fit on rows with ``doc_id``, ``held_out``, ``good`` (1 for trusted positives, else null) and features ``x``."""
    mean, spread = _moments(feats)
    part = feats.where(~F.col("held_out"))
    (p, p_half), (u, u_half) = _sample(part.where("good = 1"), max_positive), _sample(part.where("good IS NULL"), max_unlabelled)
    model = Model(mean, spread, None, 0.5)
    if not len(p) or not len(u):
        return model
    p, u = model.scaled(p), model.scaled(u)
    own = len(p) > p_half.sum() and len(u) > u_half.sum()
    first = fit_contrast(p[~p_half], u[~u_half]) if own else fit_contrast(p, u)

    def bins(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pos, unl = np.zeros(BINS, dtype=np.int64), np.zeros(BINS, dtype=np.int64)
        for b in batches:
            x = model.scaled(_matrix(b.column("x")))
            at = np.minimum((_sigmoid(x @ first[:-1] + first[-1]) * BINS).astype(int), BINS - 1)
            good = np.array([g == 1 for g in b.column("good").to_pylist()], dtype=bool)
            pos += np.bincount(at[good], minlength=BINS)
            unl += np.bincount(at[~good], minlength=BINS)
        yield pa.RecordBatch.from_arrays([pa.array(range(BINS), pa.int32()), pa.array(pos), pa.array(unl)], names=["bin", "pos", "unl"])

    counts = part.where(_half() | F.lit(not own)).select("good", "x").mapInArrow(bins, "bin int, pos long, unl long").groupBy("bin").agg(F.sum("pos").alias("pos"), F.sum("unl").alias("unl")).orderBy("bin").collect()
    prior = prior_from(np.array([r["pos"] for r in counts]), np.array([r["unl"] for r in counts]))
    model = Model(mean, spread, fit_nnpu(p, u, prior), prior)
    fit_output(part, model, prior)
    return model


def _marked(feats: DataFrame, labels: DataFrame) -> DataFrame:
    """Features with what may be learned from: ``held_out``, and ``good`` for trusted positives of the training part."""
    good = (
        labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull())
        .groupBy(F.col("doc_id").alias("label_id")).agg(F.min("quality").alias("good")).where("good = 1")
    )
    held = F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(True))
    marked = feats.join(good, F.col("doc_id") == F.col("label_id"), "left").drop("label_id").withColumn("held_out", held)
    return marked.withColumn("good", F.when(~F.col("held_out"), F.col("good").cast("int")))


def learn(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit the classifier on ``docs``; the features of all documents are written to the shared folder meanwhile."""
    ws = Workspace(docs.sparkSession, "quality")
    model = train(_saved(ws, docs, labels))
    ws.drop("marked")
    return model


def _saved(ws: Workspace, docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Features with their marks as one table: passes over it need no join."""
    marked = ws.save(_marked(ws.save(_features_table(docs.select("doc_id", "text")), "features"), labels), "marked")
    ws.drop("features")
    return marked


def accepted(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, with all columns, whose text scores THRESHOLD or more."""
    small_batches(docs.sparkSession)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield b.filter(pa.array(model.score(features(b.column("text").to_pylist())) >= THRESHOLD))

    return docs.mapInArrow(work, docs.schema)


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id``, ``held_out``, ``score`` and ``predicted`` of every document."""
    ws = Workspace(docs.sparkSession, "quality")
    feats = _saved(ws, docs, labels)
    model = train(feats)
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            score = model.score(_matrix(b.column("x")))
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(score), pa.array((score >= THRESHOLD).astype(np.int32))], names=["doc_id", "score", "predicted"])

    scored = feats.select("doc_id", "x").mapInArrow(work, f"doc_id {kind}, score double, predicted int")
    held = F.coalesce(crc_mod(F.col("doc_id"), 4) == 2, F.lit(True))
    return scored.select("doc_id", held.alias("held_out"), "score", "predicted")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
