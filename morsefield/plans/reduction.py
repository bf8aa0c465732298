"""Persistent homology as SQL: the reduction of boundary matrices over two elements, for the checks of small complexes.

A query builds ``cell`` (id, key, k, f): the cells of each complex with a key, a dimension and a value, and ``face`` (id, key,
fkey). Cells are numbered by value; a column is a bit string whose first bits are the last cells. In each round a column
that has the same lowest cell as an earlier one gets that one added, for all columns at once, until no two agree.
"""

from __future__ import annotations

#: Faces of cells that are lists of vertices, by leaving out one of them.
SIMPLICES = "face AS (SELECT id, key, key[1:i - 1] || key[i + 1:] AS fkey FROM (SELECT id, key, unnest(range(1, len(key) + 1)) AS i FROM cell WHERE len(key) > 1))"

REDUCED = """ord AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY f, k, key) AS i, count(*) OVER (PARTITION BY id) AS n FROM cell),
 col AS (SELECT c.id, c.i AS j, bit_or(set_bit(repeat('0', c.n::INT)::BIT, (c.n - o.i)::INT, 1)) AS b FROM ord c JOIN face ON face.id = c.id AND face.key = c.key JOIN ord o ON o.id = face.id AND o.key = face.fkey GROUP BY c.id, c.i),
 red AS (SELECT id, j, b, bit_position('1'::BIT, b) AS p, 0 AS turn FROM col UNION ALL
  SELECT id, j, nb, bit_position('1'::BIT, nb), turn + 1 FROM (SELECT id, j, turn, CASE WHEN p > 0 AND j > fj THEN xor(b, fb) ELSE b END AS nb, max((p > 0 AND j > fj)::INT) OVER (PARTITION BY id) AS more
   FROM (SELECT id, j, b, p, turn, first_value(j) OVER w AS fj, first_value(b) OVER w AS fb FROM red WINDOW w AS (PARTITION BY id, p ORDER BY j))) WHERE more = 1),
 low AS (SELECT id, j, p FROM (SELECT *, max(turn) OVER (PARTITION BY id) AS last FROM red) WHERE turn = last),
 pairs AS (SELECT o.id, o.k AS hdim, o.f AS birth, e.f AS death, o.i FROM low JOIN ord e ON e.id = low.id AND e.i = low.j JOIN ord o ON o.id = low.id AND o.i = o.n + 1 - low.p WHERE low.p > 0),
 dgm AS (SELECT id, hdim, birth, death FROM pairs UNION ALL
  SELECT o.id, o.k, o.f, 'inf'::DOUBLE FROM ord o LEFT JOIN low ON low.id = o.id AND low.j = o.i WHERE coalesce(low.p, 0) = 0 AND NOT EXISTS (SELECT 1 FROM pairs WHERE pairs.id = o.id AND pairs.i = o.i))"""

#: What an operator returns: classes of these dimensions that live at all.
REPORT = "SELECT id AS cloud_id, hdim::INT AS hdim, round(birth, 6) + 0.0 AS birth, round(death, 6) + 0.0 AS death FROM dgm WHERE hdim {dims} AND birth < death"


def report(dims: str = "IN (0, 1)") -> str:
    return REPORT.format(dims=dims)


def flag_cells(vertices: str, edges: str, value: str = "greatest(x.f, y.f, z.f)") -> str:
    """Cells of a flag complex up to triangles. vertices: (id, v, f); edges: (id, a, b, f) with a < b, or in both directions."""
    return f"""vx AS ({vertices}), ed AS ({edges}),
 cell AS (SELECT id, [v] AS key, 0 AS k, f FROM vx UNION ALL SELECT id, [a, b], 1, f FROM ed UNION ALL
  SELECT x.id, [x.a, x.b, y.b], 2, {value} FROM ed x JOIN ed y ON y.id = x.id AND y.a = x.b JOIN ed z ON z.id = x.id AND z.a = x.a AND z.b = y.b)"""


def diagram(prefix: str, cells: str, faces: str = SIMPLICES, dims: str = "IN (0, 1)") -> str:
    return f"WITH RECURSIVE {prefix}, {cells}, {faces}, {REDUCED} {report(dims)}"
