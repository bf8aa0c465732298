"""Queries on 8 x 8 images made of embeddings."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from ..operators import images
from ..sources import tables
from .registry import query, r

I = "px AS (SELECT vec_id AS img_id, (i // 8)::INT AS r, (i % 8)::INT AS c, embedding[i + 1]::DOUBLE AS v FROM embeddings, range(64) g(i))"  # noqa: E741
B = f"{I}, b AS (SELECT img_id, r, c, v > 0 AS \"on\" FROM px)"


@query("img_binarize", f'WITH {I} SELECT img_id, r, c, v / (SELECT max(v) FROM px) > 0.3 AS "on" FROM px')
def _(spark, sf):
    return images.binarize(tables.images(spark, sf), 0.3)


@query("img_invert", f"WITH {I} SELECT img_id, r, c, (SELECT max(v) FROM px) - v AS v FROM px")
def _(spark, sf):
    return images.invert(tables.images(spark, sf))


@query("img_invert_binary", f'WITH {B} SELECT img_id, r, c, NOT "on" AS "on" FROM b')
def _(spark, sf):
    return images.invert(tables.binary_images(spark, sf))


@query("img_pad", f'WITH {B} SELECT e.vec_id AS img_id, (i // 10)::INT AS r, (i % 10)::INT AS c, coalesce("on", false) AS "on" FROM embeddings e CROSS JOIN range(100) g(i) LEFT JOIN b ON b.img_id = e.vec_id AND b.r = i // 10 - 1 AND b.c = i % 10 - 1')
def _(spark, sf):
    return images.pad(tables.binary_images(spark, sf))


@query("img_to_point_cloud", f'WITH {B} SELECT img_id, c::DOUBLE AS x, (7 - r)::DOUBLE AS y FROM b WHERE "on"')
def _(spark, sf):
    return images.to_cloud(tables.binary_images(spark, sf)).select("img_id", F.col("coords")[0].alias("x"), F.col("coords")[1].alias("y"))


for _name, _d in (("diagonal", (1, 1)), ("right", (1, 0)), ("mixed", (-1, 1))):
    _n = math.sqrt(sum(x * x for x in _d))
    _e = " + ".join(f"({a} {'' if x >= 0 else '- 7'}) * {x / _n!r}::DOUBLE" for a, x in zip("cr", _d, strict=True))

    @query(f"img_height_{_name}", f'WITH {B}, h AS (SELECT *, {_e} AS v FROM b) SELECT img_id, r, c, round(CASE WHEN "on" THEN v ELSE (SELECT max(v) FROM h) + 1 END, 6)::DOUBLE + 0.0::DOUBLE AS v FROM h')
    def _(spark, sf, d=_d):
        return images.height(tables.binary_images(spark, sf), tuple(map(float, d))).withColumn("v", r("v"))


@query("img_radial", f'WITH {B}, h AS (SELECT *, sqrt((c - 3) * (c - 3) + (r - 4) * (r - 4)) AS v FROM b) SELECT img_id, r, c, round(CASE WHEN "on" AND v <= 3.5 THEN v ELSE (SELECT max(v) FROM h WHERE v <= 3.5) + 1 END, 6) + 0.0 AS v FROM h')
def _(spark, sf):
    return images.radial(tables.binary_images(spark, sf), (3.0, 4.0), 3.5).withColumn("v", r("v"))


@query("img_density", f'WITH {B} SELECT a.img_id, a.r, a.c, count(*) FILTER (b."on")::DOUBLE AS v FROM b a JOIN b ON a.img_id = b.img_id AND (a.r - b.r) * (a.r - b.r) + (a.c - b.c) * (a.c - b.c) <= 9 GROUP BY ALL')
def _(spark, sf):
    return images.density(tables.binary_images(spark, sf), 3.0)


def _near(limit: int, sign: str) -> str:
    d = 'SELECT a.img_id, a.r, a.c, a."on", min(abs(a.r - b.r) + abs(a.c - b.c)) FILTER (b."on") AS d, min(abs(a.r - b.r) + abs(a.c - b.c)) FILTER (NOT b."on") AS e FROM b a JOIN b ON a.img_id = b.img_id GROUP BY ALL'
    v = {
        "dilation": f"CASE WHEN d <= {limit} THEN d ELSE 16 END",
        "erosion": f"CASE WHEN e <= {limit} THEN e ELSE 16 END",
        "signed_distance": f'CASE WHEN "on" THEN CASE WHEN e <= {limit} THEN e - 1 ELSE 16 END ELSE CASE WHEN d <= {limit} THEN -d ELSE -16 END END',
    }[sign]
    return f"WITH {B}, n AS ({d}) SELECT img_id, r, c, ({v})::DOUBLE AS v FROM n"


for _limit in (None, 2):
    for _name, _f in (("dilation", images.dilation), ("erosion", images.erosion), ("signed_distance", images.signed_distance)):

        @query(f"img_{_name}{'' if _limit is None else f'_{_limit}'}", _near(_limit or 16, _name))
        def _(spark, sf, f=_f, limit=_limit):
            return f(tables.binary_images(spark, sf), limit)
