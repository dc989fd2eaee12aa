"""Rules that no query shows: paths, figures, notes, detector boxes, units, colours, recognition, crops."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from assayspark.functions import chem, units
from assayspark.functions import geometry as G
from assayspark.functions import text as T
from assayspark.operators import crops
from assayspark.operators import sections as X
from assayspark.sources import files


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_artifact_paths(spark):
    doc = F.lit("d1")
    assert [one(spark, files.artifact_path(doc, k)) for k in ("source", "reorganized", "report")] == ["storage/d1/source.pdf", "storage/d1/reorganized.md", "storage/d1/report.json"]
    assert one(spark, files.crop_path(doc, F.lit(3), F.lit(12))) == "d1_page_0003_mol_0012.png"
    assert one(spark, files.rewritten_crop(F.lit("old/crops/a.png"), doc, "old/crops/")) == "storage/d1/crops/a.png"
    assert one(spark, files.rewritten_crop(F.lit("else/a.png"), doc, "old/crops/")) == "else/a.png"


def test_figures_and_notes(spark):
    pages = spark.createDataFrame([("d", 1, [[[0.0, 1.0], [2.0, 3.0]], []]), ("d", 2, None), ("d", 3, [])], "doc_id string, page_num int, figures array<array<array<double>>>")
    assert [tuple(r) for r in files.first_figures(pages).collect()] == [("d", 1, 0, [0.0, 1.0])]
    notes = spark.createDataFrame([("a", "x"), ("b", "y")], "id string, title string")
    assert [r["id"] for r in files.note_deleted(notes, "a").collect()] == ["b"] and files.note_deleted(notes, "none").count() == 2


def test_detector_boxes(spark):
    box = lambda x0, y0, x1, y1: G.box(*(F.lit(float(v)) for v in (x0, y0, x1, y1)))
    boxes = ((0, 0, 100, 100), (0, 0, 5, 5), (0, 0, 1000, 1000), (0, 0, 0, 50), (0, 0, 500, 20))
    assert [one(spark, G.plausible(box(*b), F.lit(1e6))) for b in boxes] == [True, False, False, False, False]
    assert [one(spark, G.detector_class(F.lit(k))) for k in (0, 1, 2)] == [1, 3, 3]
    pixels = one(spark, G.pixels_to_pdf(box(200, 400, 400, 800), F.lit(200.0 / 72), F.lit(792.0)))
    assert list(pixels) == [72.0, 504.0, 144.0, 648.0]


def test_client_units_and_colours(spark):
    got = [one(spark, units.client_nm(F.lit(v), F.lit(u))) for v, u in ((2.0, "uM"), (2.0, "UM"), (3.0, "nM"), (1.0, "mM"))]
    assert got[0] == 2000.0 and got[2] == 3.0 and got[3] == 1e6 and got[1] in (2.0, None)
    assert got[1] == 2.0
    shades = [one(spark, units.colour(F.lit(v).cast("double"))) for v in (-1.0, 0.0, 12.0, 99.0, None)]
    assert shades == ["rgb(220, 38, 38)", "rgb(220, 38, 38)", "rgb(34, 197, 38)", "rgb(34, 197, 38)", "transparent"]


def test_rough_weight_and_reorganised(spark):
    assert one(spark, chem.rough_weight(F.lit("CCO"))) == 40.0
    text = "<!-- PAGE 1 -->\nABSTRACT\nbody of text\nOUR METHODS AND MORE\nPCT\n  Claims of it\n\nkeep"
    assert one(spark, T.reorganised(F.lit(text))) == "## Abstract\nbody of text\n## Our Methods And More\nPCT\n## Claims\n\nkeep"


def test_recognition_in_turns(spark):
    pages = spark.createDataFrame([(k, "text" if k == 0 else None if k % 2 else " \n", None if k == 9 else f"i{k}".encode()) for k in range(10)], "page int, text string, image binary").repartition(2)

    def first(images):
        if b"i4" in images:
            raise RuntimeError("down")
        return [" " if i == b"i3" else f"one {i.decode()}" for i in images]

    got = {r["page"]: r["text"] for r in X.recognised(pages.coalesce(1).sortWithinPartitions("page"), [first, lambda images: [f"two {i.decode()}" for i in images]], size=3).collect()}
    assert got[0] == "text" and got[9] == "" and got[3] == "two i3"
    assert [got[k][:3] for k in (1, 2, 4, 5, 6, 7, 8)] == ["one", "one", "two", "two", "two", "one", "one"]
    chained = spark.createDataFrame([("", "b"), ("a", "b"), (None, None)], "x string, y string").select(X.ocr_chain(None, ["x", "y"]).alias("t")).collect()
    assert [r["t"] for r in chained] == ["b", "a", ""]


def flooded(mask):
    seen, out = np.zeros_like(mask), []
    for y, x in zip(*np.nonzero(mask), strict=True):
        if not seen[y, x]:
            todo, here = [(y, x)], []
            seen[y, x] = True
            while todo:
                a, b = todo.pop()
                here.append((a, b))
                for i in range(max(0, a - 1), min(mask.shape[0], a + 2)):
                    for j in range(max(0, b - 1), min(mask.shape[1], b + 2)):
                        if mask[i, j] and not seen[i, j]:
                            seen[i, j] = True
                            todo.append((i, j))
            out.append(here)
    return out


@pytest.mark.parametrize("share", [0.05, 0.3, 0.5, 0.8])
def test_components_equal_a_flood_fill(share):
    rng = np.random.default_rng(int(share * 100))
    for shape in ((1, 1), (1, 9), (9, 1), (13, 17), (30, 30)):
        mask = rng.random(shape) < share
        want = [(min(x for _, x in c), min(y for y, _ in c), max(x for _, x in c), max(y for y, _ in c), len(c), np.mean([x for _, x in c]), np.mean([y for y, _ in c])) for c in flooded(mask)]
        got = [tuple(c[k] for k in ("x0", "y0", "x1", "y1", "n", "cx", "cy")) for c in crops.components(mask)]
        assert np.allclose(got, want) if want else got == []


def plain_clusters(points, reach, least):
    near = [[j for j in range(len(points)) if ((points[j] - points[k]) ** 2).sum() <= reach * reach] for k in range(len(points))]
    label, n = [-1] * len(points), 0
    for k in range(len(points)):
        if label[k] == -1 and len(near[k]) >= least:
            todo = [k]
            label[k] = n
            while todo:
                a = todo.pop()
                if len(near[a]) >= least:
                    for j in near[a]:
                        if label[j] == -1:
                            label[j] = n
                            todo.append(j)
            n += 1
    return label


@pytest.mark.parametrize("least", [1, 2, 4])
def test_clusters_equal_plain_density_clusters(least):
    rng = np.random.default_rng(least)
    for n in (1, 2, 40, 120):
        points = rng.random((n, 2)) * 120
        assert crops.clusters(points, 12.0, least).tolist() == plain_clusters(points, 12.0, least)


def test_crop_boxes(spark):
    def picture(*dots):
        p = np.zeros((40, 60), dtype=np.uint8)
        for y, x in dots:
            p[y : y + 2, x : x + 2] = 255
        return p.tobytes()

    rng = random.Random(1)
    rows = [(1, 60, picture((5, 5), (30, 40), (30, 46), (36, 40))), (2, 60, picture((5, 5))), (3, 60, picture((0, 0), (38, 58))), (4, 60, picture()), (5, 60, b""), (6, 7, bytes(60)), (7, None, picture()), (8, 60, None), (9, 1, bytes([255])), (10, 60, bytes(rng.randrange(200) for _ in range(2400)))]
    got = {r[0]: tuple(r)[1:] for r in crops.crop_boxes(spark.createDataFrame(rows, "image_id long, width int, pixels binary")).collect()}
    nothing = (None,) * 4
    assert got == {1: (4, 32, 22, 49, 39), 2: (1, 0, 0, 14, 14), 3: (2, *nothing), 4: (0, *nothing), 5: (0, *nothing), 6: (0, *nothing), 7: (0, *nothing), 8: (0, *nothing), 9: (1, 0, 0, 1, 1), 10: (0, *nothing)}


def test_what_an_application_has_kept_can_be_cleared(spark):
    import os

    from assayspark import scratch

    df = scratch.kept(spark.range(3).toDF("k"), "some")
    assert df.count() == 3
    folder = os.path.dirname(scratch.own_path(spark, "x")).removeprefix("file://")
    assert any(n.startswith("some-") for n in os.listdir(folder))
    scratch.clear(spark)
    assert not os.path.exists(folder)
