"""The part of a molecule's picture that is worth reading: connected components of its pixels and the largest cluster of them.

Pictures are rows of grey values, one picture a row, so they are cut up by Spark and each is small. Foreground is what is 200 or brighter:
that is the background of dark lines, as the rule that results depend on has it.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

BRIGHT, REACH, LEAST, PAD = 200, 12.0, 2, 8


def _find(parent: list[int], k: int) -> int:
    while parent[k] != k:
        parent[k] = parent[parent[k]]
        k = parent[k]
    return k


def _join(parent: list[int], a: int, b: int) -> None:
    a, b = _find(parent, a), _find(parent, b)
    parent[max(a, b)] = min(a, b)


def components(bright: np.ndarray) -> list[dict]:
    """8-connected components of a mask in the order of their first pixel: box, number of pixels and centre.

    Runs of a row are joined with those of the row before that they touch, by corners too.
    """
    edges = np.diff(np.pad(bright.astype(np.int8), ((0, 0), (1, 1))), axis=1)
    (row, start), end = np.nonzero(edges == 1), np.nonzero(edges == -1)[1]  # row by row, ends exclusive
    parent = list(range(len(row)))
    first = np.searchsorted(row, np.arange(bright.shape[0] + 1))
    for y in range(1, bright.shape[0]):
        a, b, z = first[y - 1], first[y], first[y + 1]
        while a < first[y] and b < z:
            if start[a] <= end[b] and start[b] <= end[a]:
                _join(parent, a, b)
            if end[a] < end[b]:
                a += 1
            else:
                b += 1
    root = np.array([_find(parent, k) for k in range(len(parent))], dtype=np.int64)
    out = []
    for k in np.unique(root):
        y, x0, x1 = row[root == k], start[root == k], end[root == k]
        n = x1 - x0
        out.append({"x0": int(x0.min()), "y0": int(y.min()), "x1": int(x1.max()) - 1, "y1": int(y.max()), "n": int(n.sum()), "cx": float(((x0 + x1 - 1) / 2 * n).sum() / n.sum()), "cy": float((y * n).sum() / n.sum())})
    return out


def clusters(points: np.ndarray, reach: float = REACH, least: int = LEAST) -> np.ndarray:
    """The density cluster of each point, from 0 in the order of their first core points, -1 for none; neighbours are looked for in the cells of a grid around."""
    cells: dict[tuple[int, int], list[int]] = {}
    keys = [tuple(c) for c in np.floor(points / reach).astype(int)]
    for k, c in enumerate(keys):
        cells.setdefault(c, []).append(k)
    near = []
    for k, (x, y) in enumerate(keys):
        around = [j for dx in (-1, 0, 1) for dy in (-1, 0, 1) for j in cells.get((x + dx, y + dy), ())]
        near.append([j for j in around if ((points[j] - points[k]) ** 2).sum() <= reach * reach])
    core = [len(n) >= least for n in near]
    parent = list(range(len(points)))
    for k, others in enumerate(near):
        for j in others:
            if core[k] and core[j]:
                _join(parent, k, j)
    heads = sorted({_find(parent, k) for k in range(len(points)) if core[k]})
    number = {h: n for n, h in enumerate(heads)}
    # A point at the edge of several clusters goes to the first.
    return np.array([number[_find(parent, k)] if core[k] else min((number[_find(parent, j)] for j in near[k] if core[j]), default=-1) for k in range(len(points))], dtype=int)


def crop_boxes(images: DataFrame, reach: float = REACH, least: int = LEAST, pad: int = PAD) -> DataFrame:
    """``image_id``, ``n_components`` and the box (``x0``, ``y0``, ``x1``, ``y1``) to be cut out: round the first component of the cluster with the most.

    ``images``: image_id, ``width``, ``pixels`` (one byte each, row by row). Without a cluster, pixels or a width that divides them the
    box is null, and the picture stays whole.
    """
    kind = images.schema["image_id"].dataType.simpleString()

    def boxed(pixels: bytes | None, width: float) -> tuple:
        if not pixels or not width or width != width or len(pixels) % int(width):
            return 0, None, None, None, None
        grey = np.frombuffer(pixels, dtype=np.uint8).reshape(-1, int(width))
        found = components(grey >= BRIGHT)
        chosen = found[0] if len(found) == 1 else None
        if len(found) > 1:
            label = clusters(np.array([(c["cx"], c["cy"]) for c in found]), reach, least)
            sizes = {k: int((label == k).sum()) for k in dict.fromkeys(label.tolist()) if k >= 0}
            if sizes:
                chosen = found[int(np.flatnonzero(label == max(sizes, key=sizes.__getitem__))[0])]
        if chosen is None:
            return len(found), None, None, None, None
        height = grey.shape[0]
        return len(found), max(chosen["x0"] - pad, 0), max(chosen["y0"] - pad, 0), min(chosen["x1"] + pad, int(width)), min(chosen["y1"] + pad, height)

    def work(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            rows = [(i, *boxed(p, w)) for i, w, p in part.itertuples(index=False)]
            yield pd.DataFrame(rows, columns=["image_id", "n_components", "x0", "y0", "x1", "y1"], dtype=object)

    return images.select("image_id", "width", "pixels").mapInPandas(work, f"image_id {kind}, n_components int, x0 int, y0 int, x1 int, y1 int")
