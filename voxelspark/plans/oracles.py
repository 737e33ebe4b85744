"""DuckDB SQL for the registered queries, written from the definitions and not from the Spark plans.

The boxes of fx_blocks touch no box of their own class by a face, so at connectivity 1 each box is one lesion and its shape
is known in closed form.
"""

from __future__ import annotations

FX = {
    "fx_classes": "SELECT * FROM (VALUES (1, 'Epithelium'), (2, 'Stroma'), (3, 'rbc'), (4, 'Intraluminal secretion')) t(class_index, class_name)",
    "fx_sections": "SELECT DISTINCT CAST(l_linenumber - 1 AS INT) AS section_index, CAST(l_linenumber + CASE WHEN l_linenumber > 4 THEN 2 ELSE 0 END AS INT) AS section_number FROM lineitem",
    "fx_voxels": "SELECT CAST(l_linenumber - 1 AS INT) AS z, CAST(l_partkey % 40 AS INT) AS y, CAST(l_suppkey % 40 AS INT) AS x, CAST(sum(CAST(l_quantity AS BIGINT)) % 5 AS INT) AS label FROM lineitem GROUP BY 1, 2, 3",
    "fx_blocks": "SELECT z, y, x, CAST(((y // 8) * 2 + (x // 8) * 3 + z // 3) % 5 AS INT) AS label FROM (SELECT DISTINCT CAST(l_linenumber - 1 AS INT) AS z FROM lineitem), (SELECT DISTINCT CAST(l_partkey % 40 AS INT) AS y FROM lineitem), (SELECT DISTINCT CAST(l_suppkey % 40 AS INT) AS x FROM lineitem UNION SELECT CAST(l_partkey % 40 AS INT) FROM lineitem)",
    "fx_nuclei": "SELECT c_custkey + 1 AS instance_id, CAST(c_custkey % 7 AS INT) AS section_index, CAST((c_custkey % 7) * 8 AS DOUBLE) AS z_um, CAST((c_custkey * 7919) % 32000 AS DOUBLE) / 100 AS y_um, CAST(abs(CAST(round(c_acctbal * 100) AS BIGINT)) % 32000 AS DOUBLE) / 100 AS x_um, CAST(4 + (c_custkey % 9) AS DOUBLE) AS feret_diameter_um FROM customer",
    "fx_points": "SELECT vec_id AS id, CAST(embedding[1] AS DOUBLE) * 1000 AS z, CAST(embedding[2] AS DOUBLE) * 1000 AS y, CAST(embedding[3] AS DOUBLE) * 1000 AS x, CAST(label % 5 AS INT) AS label FROM embeddings",
    "fx_at": "SELECT n.*, CAST(least(greatest(floor(z_um / 8), 0), 6) AS INT) AS vz, CAST(least(greatest(floor(y_um / 8), 0), 39) AS INT) AS vy, CAST(least(greatest(floor(x_um / 8), 0), 39) AS INT) AS vx FROM fx_nuclei n",
    "fx_classed": "SELECT a.instance_id, a.section_index, a.z_um, a.y_um, a.x_um, a.feret_diameter_um, coalesce(v.label, 0) AS class_index, vz, vy, vx FROM fx_at a LEFT JOIN fx_voxels v ON v.z = vz AND v.y = vy AND v.x = vx",
    "fx_boxes": "SELECT z // 3 AS bz, y // 8 AS by_, x // 8 AS bx, label AS class_index, count(*) AS n, avg(z) AS mz, avg(y) AS my, avg(x) AS mx, min(z) AS lz, min(y) AS ly, min(x) AS lx, max(z) + 1 AS hz, max(y) + 1 AS hy, max(x) + 1 AS hx FROM fx_blocks WHERE label > 0 GROUP BY 1, 2, 3, 4",
    "fx_lesions": "SELECT row_number() OVER (ORDER BY b.class_index, lz, ly, lx) AS instance_id, b.*, c.class_name, n * 512.0 AS volume_um3, CASE WHEN n * 512.0 >= 5e4 THEN 'large' ELSE 'small' END AS size_class, hz - lz AS a, hy - ly AS b, hx - lx AS c FROM fx_boxes b JOIN fx_classes c ON c.class_index = b.class_index",
}
_NEEDS = {"fx_at": ["fx_nuclei"], "fx_classed": ["fx_voxels", "fx_nuclei", "fx_at"], "fx_boxes": ["fx_blocks"], "fx_lesions": ["fx_blocks", "fx_boxes", "fx_classes"]}


def sql(body: str, *views: str, recursive: str = "") -> str:
    names: list[str] = []
    for v in views:
        names += [n for n in (*_NEEDS.get(v, []), v) if n not in names]
    ctes = [f"{n} AS ({FX[n].replace('b.*, c.class_name', 'b.*, c.class_name')})" for n in names]
    if recursive:
        ctes.append(recursive)
    return f"WITH {'RECURSIVE ' if recursive else ''}{', '.join(ctes)} {body}" if ctes else body


_SPHERE = "4.0 / 3 * pi() * pow({r} / 1000.0, 3)"
_CODE = "z * 4398046511104 + y * 2097152 + x"


def _reach(connectivity: int) -> str:
    return f"reach AS (SELECT z, y, x, label, z AS sz, y AS sy, x AS sx FROM fx_voxels WHERE label > 0 UNION SELECT v.z, v.y, v.x, v.label, r.sz, r.sy, r.sx FROM reach r JOIN fx_voxels v ON v.label = r.label AND abs(v.z - r.z) + abs(v.y - r.y) + abs(v.x - r.x) = {connectivity})"


def _box_components(connectivity: int) -> str:
    box = "box AS (SELECT DISTINCT z // 3 AS bz, y // 8 AS b2, x // 8 AS bx, label, min(CAST(z AS BIGINT) * 4398046511104 + CAST(y AS BIGINT) * 2097152 + x) OVER (PARTITION BY z // 3, y // 8, x // 8) AS seed FROM fx_blocks WHERE label > 0)"
    reach = f"reach AS (SELECT bz, b2, bx, label, seed FROM box UNION SELECT o.bz, o.b2, o.bx, o.label, r.seed FROM reach r JOIN box o ON o.label = r.label AND greatest(abs(o.bz - r.bz), abs(o.b2 - r.b2), abs(o.bx - r.bx)) = 1 AND abs(o.bz - r.bz) + abs(o.b2 - r.b2) + abs(o.bx - r.bx) <= {connectivity})"
    return sql("SELECT f.z, f.y, f.x, f.label, g.component FROM fx_blocks f JOIN (SELECT bz, b2, bx, min(seed) AS component FROM reach GROUP BY 1, 2, 3) g ON g.bz = f.z // 3 AND g.b2 = f.y // 8 AND g.bx = f.x // 8 WHERE f.label > 0", "fx_blocks", recursive=f"{box}, {reach}")


def _neighborhood() -> str:
    cols = []
    for r in (16, 32, 50):
        c = [f"count(*) FILTER (d2 <= {r * r} AND c = {k})" for k in (1, 2, 3, 4)]
        t = f"count(*) FILTER (d2 <= {r * r} AND c > 0)"
        cols += [f"count(*) FILTER (d2 <= {r * r}) - 1 AS n_neighbors_r{r}", f"round((count(*) FILTER (d2 <= {r * r}) - 1) / ({_SPHERE.format(r=r)}), 6) AS density_cells_per_mm3_r{r}"]
        cols += [f"round(CASE WHEN {t} > 0 THEN CAST({x} AS DOUBLE) / {t} END, 6) AS composition_frac_{k}_r{r}" for k, x in zip((1, 2, 3, 4), c, strict=True)]
        cols.append("round(" + " + ".join(f"CASE WHEN {x} > 0 THEN -(CAST({x} AS DOUBLE) / {t}) * ln(CAST({x} AS DOUBLE) / {t}) ELSE 0.0 END" for x in c) + f", 6) AS shannon_entropy_r{r}")
    return f"SELECT instance_id, {', '.join(cols)} FROM (SELECT p.instance_id, q.class_index AS c, pow(p.z_um - q.z_um, 2) + pow(p.y_um - q.y_um, 2) + pow(p.x_um - q.x_um, 2) AS d2 FROM fx_classed p, fx_classed q) WHERE d2 <= 2500 GROUP BY 1"


def _kde(tail: str) -> str:
    """Gaussian of one voxel, cut at four, mirrored borders; by direct sums over the axes."""
    kernel = "k AS (SELECT o, exp(-0.5 * o * o) / sum(exp(-0.5 * o * o)) OVER () AS w FROM (SELECT unnest(range(-4, 5)) AS o))"
    h = "h AS (SELECT CAST(least(floor(z_um / 8), 6) AS INT) AS z, CAST(least(floor(y_um / 8), 39) AS INT) AS y, CAST(least(floor(x_um / 8), 39) AS INT) AS x, CAST(count(*) AS DOUBLE) AS v FROM fx_nuclei WHERE z_um BETWEEN 0 AND 56 AND y_um BETWEEN 0 AND 320 AND x_um BETWEEN 0 AND 320 GROUP BY 1, 2, 3)"
    steps, prev = [kernel, h], "h"
    for axis, n in (("z", 7), ("y", 40), ("x", 40)):
        m = f"((({axis} + o) % {2 * n} + {2 * n}) % {2 * n})"
        keep = [c if c != axis else f"CAST(CASE WHEN {m} >= {n} THEN {2 * n - 1} - {m} ELSE {m} END AS INT) AS {axis}" for c in "zyx"]
        steps.append(f"g{axis} AS (SELECT z, y, x, sum(v) AS v FROM (SELECT {', '.join(keep)}, v * w AS v FROM {prev}, k) GROUP BY 1, 2, 3)")
        prev = f"g{axis}"
    return f"WITH fx_nuclei AS ({FX['fx_nuclei']}), {', '.join(steps)} {tail}"


_EDT = "inside AS (SELECT f.z, f.y, f.x FROM fx_blocks f JOIN fx_lesions l ON l.instance_id = 1 AND f.z >= l.lz AND f.z < l.hz AND f.y >= l.ly AND f.y < l.hy AND f.x >= l.lx AND f.x < l.hx), grid AS (SELECT z, y, x FROM (SELECT unnest(range(0, 7)) AS z), (SELECT unnest(range(0, 40)) AS y), (SELECT unnest(range(0, 40)) AS x)), d AS (SELECT g.z, g.y, g.x, min((g.z - i.z) * (g.z - i.z) + (g.y - i.y) * (g.y - i.y) + (g.x - i.x) * (g.x - i.x)) AS d2 FROM grid g, inside i GROUP BY 1, 2, 3)"


def _profile() -> str:
    nuclei = "u AS (SELECT vz, vy, vx, count(*) AS al, " + ", ".join(f"count(*) FILTER (class_index = {c}) AS n{c}" for c in (1, 2, 3, 4)) + " FROM fx_classed GROUP BY 1, 2, 3)"
    cells = "s AS (SELECT (SELECT min(k) FROM (SELECT unnest(range(0, 12)) AS k) WHERE d2 * 64 <= ((k + 1) * 10) * ((k + 1) * 10)) AS shell, al, n1, n2, n3, n4 FROM d LEFT JOIN u ON vz = d.z AND vy = d.y AND vx = d.x WHERE d2 > 0)"
    sums = "t AS (SELECT k AS shell_index, k * 10.0 AS r_lo_um, (k + 1) * 10.0 AS r_hi_um, 'shell' AS band, count(shell) AS n_voxels, coalesce(sum(al), 0) AS n_nuclei, " + ", ".join(f"coalesce(sum(n{c}), 0) AS n{c}" for c in (1, 2, 3, 4)) + " FROM (SELECT unnest(range(0, 12)) AS k) LEFT JOIN s ON shell = k GROUP BY 1)"
    band = lambda name, lo, hi, where: f"SELECT -1, {lo}.0, {hi}.0, '{name}', sum(n_voxels), sum(n_nuclei), sum(n1), sum(n2), sum(n3), sum(n4) FROM t WHERE {where}"
    rows = f"SELECT * FROM t UNION ALL {band('proximal', 0, 50, 'r_hi_um <= 50')} UNION ALL {band('distal', 80, 120, 'r_lo_um >= 80')}"
    fr = ", ".join(f"round(CASE WHEN n1 + n2 + n3 + n4 > 0 THEN CAST(n{c} AS DOUBLE) / (n1 + n2 + n3 + n4) END, 4) AS composition_frac_{c}" for c in (1, 2, 3, 4))
    out = f"SELECT CAST(shell_index AS INT) AS shell_index, CAST(r_lo_um AS DOUBLE) AS r_lo_um, CAST(r_hi_um AS DOUBLE) AS r_hi_um, band, CAST(n_voxels AS BIGINT) AS n_voxels, CAST(n_nuclei AS BIGINT) AS n_nuclei, {fr}, round(CASE WHEN n_voxels > 0 THEN n_nuclei / (n_voxels * 512 / 1e9) END, 4) AS density_cells_per_mm3 FROM ({rows})"
    return sql(out, "fx_classed", "fx_lesions", recursive=f"{_EDT}, {nuclei}, {cells}, {sums}")


def _composition(centres: str, cells: str, r2: float, views: tuple[str, ...]) -> str:
    cols = ", ".join(f"round(CASE WHEN count(label) > 0 THEN CAST(count(*) FILTER (label = {c}) AS DOUBLE) / count(label) ELSE 0 END, 9) AS composition_frac_{c}" for c in (1, 2, 3, 4))
    return sql(f"SELECT id, {cols} FROM ({centres}) p LEFT JOIN (SELECT * FROM {cells} WHERE label > 0) v ON (v.z - p.z) * (v.z - p.z) + (v.y - p.y) * (v.y - p.y) + (v.x - p.x) * (v.x - p.x) <= {r2} GROUP BY 1", *views)


_EVEN = "CAST(round_even({}, 0) AS INT)"


def gradient_sql(select: str) -> str:
    """What `select` takes from s(z, y, x, dwz, dwy, dwx), the parts of the gradient of the smoothed density."""
    return _kde(", f AS (SELECT g.z, g.y, g.x, coalesce(v, 0) / 512 AS v FROM (SELECT z, y, x FROM (SELECT unnest(range(0, 7)) AS z), (SELECT unnest(range(0, 40)) AS y), (SELECT unnest(range(0, 40)) AS x)) g LEFT JOIN gx ON gx.z = g.z AND gx.y = g.y AND gx.x = g.x), s AS (SELECT z, y, x, " + ", ".join(f"coalesce((lead(v) OVER {a} - lag(v) OVER {a}) / 16, (lead(v) OVER {a} - v) / 8, (v - lag(v) OVER {a}) / 8) AS d{a}" for a in ("wz", "wy", "wx")) + " FROM f WINDOW wz AS (PARTITION BY y, x ORDER BY z), wy AS (PARTITION BY z, x ORDER BY y), wx AS (PARTITION BY z, y ORDER BY x))" + select)


def oracle_sql() -> dict[str, str]:
    per = "ORDER BY section_index"
    out = {
        "volumetrics_basic": sql("SELECT c.class_index, c.class_name, count(v.label) AS n_voxels, round(count(v.label) * 512.0, 9) AS volume_um3, round(count(v.label) * 512.0 / 1e9, 9) AS volume_mm3, round(CAST(count(v.label) AS DOUBLE) / sum(count(v.label)) OVER (), 9) AS volume_fraction FROM fx_classes c LEFT JOIN fx_voxels v ON v.label = c.class_index GROUP BY 1, 2", "fx_classes", "fx_voxels"),
        "connected_components_6": sql("SELECT z, y, x, label, min(CAST(sz AS BIGINT) * 4398046511104 + CAST(sy AS BIGINT) * 2097152 + sx) AS component FROM reach GROUP BY 1, 2, 3, 4", "fx_voxels", recursive=_reach(1)),
        "connected_components_18": _box_components(2),
        "connected_components_26": _box_components(3),
        "volumetrics_full": sql("SELECT c.class_index, c.class_name, coalesce(sum(n), 0)::BIGINT AS n_voxels, coalesce(sum(n), 0) * 512.0::DOUBLE AS volume_um3, count(n) AS n_components, coalesce(max(n), 0) * 512.0::DOUBLE AS largest_um3, coalesce(arg_min(n, component), 0) * 512.0::DOUBLE AS first_um3 FROM fx_classes c LEFT JOIN (SELECT label, component, count(*) AS n FROM (SELECT z, y, x, label, min((sz, sy, sx)) AS component FROM reach GROUP BY 1, 2, 3, 4) GROUP BY 1, 2) s ON s.label = c.class_index GROUP BY 1, 2", "fx_classes", "fx_voxels", recursive=_reach(1)),
        "lesion_features_basic": sql("SELECT instance_id, class_index, class_name, n AS n_voxels, CAST(volume_um3 AS DOUBLE) AS volume_um3, round(volume_um3 / 1e9, 6) AS volume_mm3, round(mz * 8, 6) AS centroid_z_um, round(my * 8, 6) AS centroid_y_um, round(mx * 8, 6) AS centroid_x_um, CAST(lz * 8 AS DOUBLE) AS bbox_min_z_um, CAST(ly * 8 AS DOUBLE) AS bbox_min_y_um, CAST(lx * 8 AS DOUBLE) AS bbox_min_x_um, CAST(hz * 8 AS DOUBLE) AS bbox_max_z_um, CAST(hy * 8 AS DOUBLE) AS bbox_max_y_um, CAST(hx * 8 AS DOUBLE) AS bbox_max_x_um, round(pow(6 * volume_um3 / pi(), 1.0 / 3), 6) AS equivalent_diameter_um, round(CAST(n AS DOUBLE) / (a * b * c), 6) AS extent, size_class, lz AS seed_z_voxel, ly AS seed_y_voxel, lx AS seed_x_voxel FROM fx_lesions", "fx_lesions"),
        "lesion_axes": sql("SELECT instance_id, round(8 * sqrt(20 * greatest(a * a - 1, b * b - 1, c * c - 1) / 12.0), 4) AS axis_major_length_um, round(8 * sqrt(20 * least(a * a - 1, b * b - 1, c * c - 1) / 12.0), 4) AS axis_minor_length_um FROM fx_lesions", "fx_lesions"),
        "lesion_euler": sql("SELECT l.instance_id, CAST(sum(CASE WHEN (abs(p.z) % 2 + abs(p.y) % 2 + abs(p.x) % 2) % 2 = 1 THEN 1 ELSE -1 END) AS BIGINT) AS euler_number FROM fx_lesions l JOIN (SELECT DISTINCT f.z // 3 AS bz, f.y // 8 AS b2, f.x // 8 AS bx, 2 * f.z + i AS z, 2 * f.y + j AS y, 2 * f.x + k AS x FROM fx_blocks f, (SELECT unnest([-1, 0, 1]) AS i), (SELECT unnest([-1, 0, 1]) AS j), (SELECT unnest([-1, 0, 1]) AS k) WHERE f.label > 0) p ON p.bz = l.bz AND p.b2 = l.by_ AND p.bx = l.bx GROUP BY 1", "fx_lesions"),
        "lesion_surface": sql("SELECT instance_id, round(64 * (2 * ((a - 1) * (b - 1) + (b - 1) * (c - 1) + (a - 1) * (c - 1)) + 4 * (a + b + c - 3) * sqrt(0.5) + sqrt(3)), 4) AS surface_area_um2 FROM fx_lesions", "fx_lesions"),
        "lesion_hull": sql("SELECT instance_id, round(8 * sqrt(CASE WHEN least(a, b, c) = 1 THEN a * a + b * b + c * c ELSE (a - 1) * (a - 1) + (b - 1) * (b - 1) + (c - 1) * (c - 1) + 2 * greatest(a, b, c) - 1 END), 4) AS feret_diameter_max_um, 1.0::DOUBLE AS solidity FROM fx_lesions", "fx_lesions"),
        "nucleus_class": sql("SELECT instance_id, class_index FROM fx_classed", "fx_classed"),
        "nuclei_to_lesions": sql("SELECT n.instance_id, coalesce(l.instance_id, 0) AS lesion_id FROM fx_at n LEFT JOIN fx_lesions l ON vz >= lz AND vz < hz AND vy >= ly AND vy < hy AND vx >= lx AND vx < hx", "fx_at", "fx_lesions"),
        "lesion_cell_density": sql("SELECT l.instance_id, count(n.instance_id) AS n_nuclei, round(coalesce(sum(8.0 / (4 + feret_diameter_um)), 0), 4) AS n_nuclei_corrected, round(count(n.instance_id) / (volume_um3 / 1e9), 4) AS density_cells_per_mm3, round(coalesce(sum(8.0 / (4 + feret_diameter_um)), 0) / (volume_um3 / 1e9), 4) AS density_corrected_cells_per_mm3 FROM fx_lesions l LEFT JOIN fx_at n ON vz >= lz AND vz < hz AND vy >= ly AND vy < hy AND vx >= lx AND vx < hx GROUP BY 1, volume_um3", "fx_at", "fx_lesions"),
        "lesion_composition": _composition(f"SELECT instance_id AS id, {_EVEN.format('mz')} AS z, {_EVEN.format('my')} AS y, {_EVEN.format('mx')} AS x FROM fx_lesions", "fx_blocks", 25, ("fx_lesions",)),
        "local_composition": _composition(f"SELECT instance_id AS id, {_EVEN.format('z_um / 8')} AS z, {_EVEN.format('y_um / 8')} AS y, {_EVEN.format('x_um / 8')} AS x FROM fx_nuclei", "fx_voxels", 9, ("fx_nuclei", "fx_voxels")),
        "stereological_count": sql("SELECT section_index, round(sum(8.0 / (4.0 + feret_diameter_um)), 6) AS n_corrected, count(*) AS n_profiles FROM fx_nuclei GROUP BY 1", "fx_nuclei"),
        "class_density": sql("SELECT c.class_index, c.class_name, round(coalesce(v.n, 0) * 512 / 1e9, 4) AS class_volume_mm3, coalesce(k.n, 0) AS n_nuclei, round(CASE WHEN v.n > 0 THEN coalesce(k.n, 0) / (v.n * 512 / 1e9) ELSE 0 END, 4) AS density_cells_per_mm3 FROM fx_classes c LEFT JOIN (SELECT label, count(*) AS n FROM fx_voxels GROUP BY 1) v ON v.label = c.class_index LEFT JOIN (SELECT class_index, count(*) AS n FROM fx_classed GROUP BY 1) k ON k.class_index = c.class_index", "fx_classes", "fx_classed"),
        "sphere_density": sql(f"SELECT p.instance_id AS id, count(*) AS n_nuclei, round(count(*) / ({_SPHERE.format(r=32)}), 4) AS density_cells_per_mm3 FROM fx_nuclei p JOIN fx_nuclei q ON pow(p.z_um - q.z_um, 2) + pow(p.y_um - q.y_um, 2) + pow(p.x_um - q.x_um, 2) <= 1024 GROUP BY 1", "fx_nuclei"),
        "point_pairs": sql("SELECT p.label, q.label AS other, count(*) AS n_pairs, round(sum(pow(p.z - q.z, 2) + pow(p.y - q.y, 2) + pow(p.x - q.x, 2)), 3) AS sum_d2 FROM fx_points p JOIN fx_points q ON pow(p.z - q.z, 2) + pow(p.y - q.y, 2) + pow(p.x - q.x, 2) <= 2500 GROUP BY 1, 2", "fx_points"),
        "neighborhood_features": sql(_neighborhood(), "fx_classed"),
        "nn_distance": sql("SELECT p.instance_id, " + ", ".join(f"round(sqrt(min(pow(p.z_um - q.z_um, 2) + pow(p.y_um - q.y_um, 2) + pow(p.x_um - q.x_um, 2)) FILTER (q.class_index = {c})), 6) AS nn_dist_um_class_{c}" for c in (1, 2, 3, 4)) + " FROM fx_classed p LEFT JOIN fx_classed q ON q.instance_id <> p.instance_id GROUP BY 1", "fx_classed"),
        "density_histogram": sql("SELECT CAST(least(floor(z_um / 8), 6) AS INT) AS z, CAST(least(floor(y_um / 8), 39) AS INT) AS y, CAST(least(floor(x_um / 8), 39) AS INT) AS x, count(*) AS n FROM fx_nuclei WHERE z_um BETWEEN 0 AND 56 AND y_um BETWEEN 0 AND 320 AND x_um BETWEEN 0 AND 320 GROUP BY 1, 2, 3", "fx_nuclei"),
        "density_kde": _kde("SELECT z, y, x, round(v / 512 * 1e6, 4) AS value FROM gx"),
        "density_gradient": gradient_sql(" SELECT z, round(sum(sqrt(dwz * dwz + dwy * dwy + dwx * dwx)) * 1e6, 3) AS sum_gradient, round(max(sqrt(dwz * dwz + dwy * dwy + dwx * dwx)) * 1e6, 3) AS max_gradient FROM s GROUP BY 1"),
        "radial_profile": _profile(),
        "profile_lesions": sql("SELECT CAST(p AS DOUBLE) AS percentile, instance_id, CAST(volume_um3 AS DOUBLE) AS volume_um3 FROM (SELECT min(p) AS p, rank FROM (SELECT p, least(CAST(floor((SELECT count(*) FROM fx_lesions) * p / 100.0) AS INT), (SELECT count(*) FROM fx_lesions) - 1) AS rank FROM (VALUES (50), (90), (99)) t(p)) GROUP BY 2) JOIN (SELECT instance_id, volume_um3, row_number() OVER (ORDER BY volume_um3, instance_id) - 1 AS rank FROM fx_lesions) USING (rank)", "fx_lesions"),
        "top10_lesions": sql("SELECT instance_id, class_name, CAST(volume_um3 AS DOUBLE) AS volume_um3 FROM fx_lesions ORDER BY volume_um3 DESC, instance_id LIMIT 10", "fx_lesions"),
        "lesion_class_summary": sql("SELECT class_index, class_name, count(*) AS n_lesions, count(*) FILTER (size_class = 'large') AS n_large, CAST(median(volume_um3) AS DOUBLE) AS median_um3, CAST(max(volume_um3) AS DOUBLE) AS max_um3, CAST(sum(volume_um3) AS DOUBLE) AS total_um3 FROM fx_lesions GROUP BY 1, 2", "fx_lesions"),
        "neighborhood_class_summary": sql(f"SELECT c.class_index, count(*) AS n_nuclei, median(n_neighbors_r32) AS median_neighbors, round(avg(e), 6) AS mean_entropy FROM fx_classed c JOIN (SELECT instance_id, n_neighbors_r32, shannon_entropy_r32 AS e FROM ({_neighborhood().replace(', 6) AS shannon', ', 12) AS shannon')})) f USING (instance_id) GROUP BY 1", "fx_classed"),
        "manifest_natural_order": "SELECT CAST(row_number() OVER (ORDER BY s_suppkey) - 1 AS INT) AS section_index, (CASE WHEN s_suppkey % 3 = 0 THEN 'section_' ELSE 'Section_' END) || s_suppkey || (CASE WHEN s_suppkey % 2 = 0 THEN '.SVS' ELSE '.tif' END) AS filename FROM supplier WHERE s_suppkey % 7 <> 0",
        "manifest_thickness": "SELECT CAST(s_suppkey AS INT) AS section_index, coalesce(sum(CASE WHEN s_suppkey % 4 = 0 THEN 12.0::DOUBLE ELSE s_suppkey % 5 + 1 END) OVER (ORDER BY s_suppkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS z_um, CASE WHEN s_suppkey % 4 = 0 THEN NULL ELSE CAST(s_suppkey % 5 + 1 AS DOUBLE) END AS thickness_um FROM supplier",
        "section_number_check": sql(f"SELECT * FROM (SELECT section_index, n AS section_number, lag(n) OVER ({per}) AS previous FROM (SELECT section_index, CASE WHEN section_index = 5 THEN 3 ELSE section_number END AS n FROM fx_sections)) WHERE previous >= section_number", "fx_sections"),
        "section_z": sql(f"SELECT section_index, CAST((section_number - first(section_number) OVER ({per})) * 8 AS DOUBLE) AS z_um FROM fx_sections", "fx_sections"),
        "plane_sources": sql("SELECT CAST(p AS INT) AS plane, p * 8.0::DOUBLE AS z_um, coalesce(min(section_index), -1) AS section_index FROM (SELECT unnest(range(0, 9)) AS p) LEFT JOIN fx_sections ON section_number - 1 = p GROUP BY p", "fx_sections"),
        "plane_sources_12um": sql("SELECT CAST(p AS INT) AS plane, p * 12.0::DOUBLE AS z_um, arg_min(section_index, (abs(p * 12 - section_index * 8), section_index)) AS section_index FROM (SELECT unnest(range(0, 5)) AS p), fx_sections GROUP BY p", "fx_sections"),
        "missing_sections": sql("SELECT section_index FROM fx_sections WHERE section_index NOT IN (SELECT z FROM fx_voxels WHERE z % 3 <> 1)", "fx_sections", "fx_voxels"),
        "volume_build": sql("SELECT CAST(section_number - 1 AS INT) AS z, label, count(*) AS n FROM fx_voxels JOIN fx_sections ON section_index = z WHERE label <> 0 GROUP BY 1, 2", "fx_sections", "fx_voxels"),
        "global_instance_ids": sql("SELECT instance_id AS ordinal, section_index, row_number() OVER (ORDER BY section_index, instance_id) AS instance_id FROM fx_nuclei", "fx_nuclei"),
        "affine_centroids": sql("SELECT instance_id, round((1 + section_index * 0.01::DOUBLE) * (y_um / 32) + section_index * 0.02::DOUBLE * (x_um / 32) + section_index * 100.0::DOUBLE, 9) AS y_um, round(section_index * -0.02::DOUBLE * (y_um / 32) + (1 - section_index * 0.01::DOUBLE) * (x_um / 32) + section_index * 10.0::DOUBLE, 9) AS x_um FROM fx_nuclei", "fx_nuclei"),
        "nuclei_section_z": sql("SELECT n.section_index, CAST((s.section_number - 1) * 8 AS DOUBLE) AS z_um, count(*) AS n FROM fx_nuclei n JOIN fx_sections s ON s.section_index = n.section_index GROUP BY 1, 2", "fx_nuclei", "fx_sections"),
        "smooth_transforms": sql("SELECT s.section_index, round(sum(w * (1 + j * 0.01)), 6) AS a00, round(sum(w * j * 100), 6) AS a02 FROM (SELECT section_index, w, least(greatest(section_index + o, 0), 6) AS j FROM fx_sections, (SELECT o, exp(-0.5 * o * o) / sum(exp(-0.5 * o * o)) OVER () AS w FROM (SELECT unnest(range(-4, 5)) AS o))) s GROUP BY 1", "fx_sections"),
        "resample_labels": sql(f"SELECT v.z AS section_index, CAST(a AS INT) AS y, CAST(b AS INT) AS x, label FROM fx_voxels v JOIN (SELECT unnest(range(0, 25)) AS a) ON v.y = {_EVEN.format('(a + 0.5::DOUBLE) * 40 / 25 - 0.5::DOUBLE')} JOIN (SELECT unnest(range(0, 16)) AS b) ON v.x = {_EVEN.format('(b + 0.5::DOUBLE) * 40 / 16 - 0.5::DOUBLE')}", "fx_voxels"),
        "core_window_dedup": sql("SELECT instance_id, CAST(floor(y_um / 64) AS INT) AS row, CAST(floor(x_um / 64) AS INT) AS col FROM fx_nuclei", "fx_nuclei"),
        "overlap_argmax": sql("SELECT p.section_index, p.y, p.x, CAST(CASE WHEN v.label IS NULL THEN 0 ELSE arg_max(c, (m, -c)) END AS INT) AS label FROM (SELECT CAST(l_linenumber - 1 AS INT) AS section_index, CAST(l_partkey % 40 AS INT) AS y, CAST(l_suppkey % 40 AS INT) AS x, l_orderkey % 5 AS c, sum(l_quantity) / count(*) AS m FROM lineitem GROUP BY 1, 2, 3, 4) p LEFT JOIN (SELECT * FROM fx_voxels WHERE label <> 0) v ON v.z = p.section_index AND v.y = p.y AND v.x = p.x GROUP BY 1, 2, 3, v.label", "fx_voxels"),
        "block_mean": sql("SELECT z AS section_index, CAST(y // 6 AS INT) AS y, CAST(x // 6 AS INT) AS x, CAST(floor(avg(label * 50)) AS INT) AS value FROM fx_voxels WHERE y < 36 AND x < 36 GROUP BY 1, 2, 3", "fx_voxels"),
        "tissue_mask": sql("SELECT z, y, x, (0.2125::DOUBLE * (label * 60 + y % 16) + 0.7154::DOUBLE * (label * 55) + 0.0721::DOUBLE * (label * 62)) / 255 > 0.8::DOUBLE AS background FROM fx_voxels", "fx_voxels"),
        "tissue_bbox": sql("SELECT CAST(coalesce(greatest(min(y) - 2, 0), 0) AS INT) AS y0, CAST(coalesce(greatest(min(x) - 2, 0), 0) AS INT) AS x0, CAST(coalesce(least(max(y) + 3, 40), 40) AS INT) AS y1, CAST(coalesce(least(max(x) + 3, 40), 40) AS INT) AS x1 FROM (SELECT y, x FROM fx_voxels WHERE label = 4 AND y BETWEEN 10 AND 30 AND x BETWEEN 5 AND 20 GROUP BY 1, 2 HAVING count(DISTINCT z) >= 2)", "fx_voxels"),
        "instance_features": sql("SELECT section_index, label, round(my, 6) AS centroid_y, round(mx, 6) AS centroid_x, round(n * 0.25, 6) AS area_um2, round(CASE WHEN mid + root > 0 THEN sqrt(greatest(1 - (mid - root) / (mid + root), 0)) ELSE 0 END, 6) AS eccentricity, round(CASE WHEN root > 1e-9 THEN 0.5 * atan2(2 * b, a - c) ELSE 0 END, 6) AS orientation FROM (SELECT *, sqrt(pow((a - c) / 2, 2) + b * b) AS root, (a + c) / 2 AS mid FROM (SELECT z AS section_index, label, avg(y) AS my, avg(x) AS mx, count(*) AS n, var_pop(y) + 1.0 / 12 AS a, var_pop(x) + 1.0 / 12 AS c, covar_pop(y, x) AS b FROM fx_blocks WHERE label > 0 GROUP BY 1, 2))", "fx_blocks"),
        "label_overlay": sql("SELECT z AS section_index, y, x, label, " + ", ".join(f"CAST(floor({p} * 0.6::DOUBLE + (CASE WHEN label > 0 THEN {q} ELSE {p} END) * 0.4::DOUBLE) AS INT) AS {n}" for n, p, q in (("r", "x * 5", "label * 60"), ("g", "y * 5", "255 - label * 60"), ("b", "200", "label * 30"))) + " FROM fx_voxels", "fx_voxels"),
        "pyramid_levels": sql("SELECT section_index, CAST(l AS INT) AS level, CAST(w // CAST(pow(2, l) AS INT) AS INT) AS width, CAST(h // CAST(pow(2, l) AS INT) AS INT) AS height, CAST(pow(2, l) AS INT) AS downsample, 3 AS best FROM (SELECT section_index, section_number * 300 + 100 AS h, section_number * 200 + 64 AS w FROM fx_sections), (SELECT unnest(range(0, 7)) AS l) WHERE w >= pow(2, l) AND h >= pow(2, l)", "fx_sections"),
        "task_sections": sql("SELECT CAST(instance_id AS INT) AS section_index FROM fx_nuclei WHERE instance_id % 3 = 1", "fx_nuclei"),
        "resume_todo": "SELECT DISTINCT CAST(c_custkey % 500 AS INT) AS section_index FROM customer WHERE c_custkey % 500 NOT IN (SELECT o_orderkey % 400 FROM orders GROUP BY 1 HAVING bool_or(o_orderstatus = 'F') AND bool_or(o_orderstatus <> 'F'))",
        "cache_merge": "SELECT p_partkey AS section_index, p_size AS size, CASE WHEN p_partkey % 4 <> 0 AND p_partkey % 5 = 0 THEN p_partkey * 10 + 1 ELSE p_partkey * 10 END AS mtime, 8.0::DOUBLE AS mpp, p_partkey % 3 <> 0 AND p_partkey % 4 <> 0 AND p_partkey % 5 = 0 AS stale FROM part WHERE p_partkey % 3 <> 0 OR p_partkey % 4 <> 0",
        "class_entropy": sql("SELECT z, round(-sum(f * ln(f)), 9) AS entropy FROM (SELECT z, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY z) AS f FROM fx_voxels WHERE label > 0 GROUP BY z, label) GROUP BY 1", "fx_voxels"),
        "affine_fit": sql("SELECT section_index, " + ", ".join(f"round({a}, 6) AS a{i}0, round({b}, 6) AS a{i}1, round(m{t} - ({a}) * mu - ({b}) * mv, 6) AS a{i}2" for i, t in enumerate("yx") for a, b in [(f"(vv * u{t} - uv * v{t}) / (uu * vv - uv * uv)", f"(uu * v{t} - uv * u{t}) / (uu * vv - uv * uv)")]) + " FROM (SELECT section_index, avg(u) AS mu, avg(v) AS mv, avg(y) AS my, avg(x) AS mx, var_pop(u) AS uu, var_pop(v) AS vv, covar_pop(u, v) AS uv, covar_pop(u, y) AS uy, covar_pop(v, y) AS vy, covar_pop(u, x) AS ux, covar_pop(v, x) AS vx FROM (SELECT section_index, y_um AS u, x_um AS v, y_um * (1 + section_index * 0.01) + x_um * 0.02 + section_index + feret_diameter_um AS y, y_um * -0.02 + x_um * (1 - section_index * 0.01) - section_index AS x FROM fx_nuclei) GROUP BY 1)", "fx_nuclei"),
    }
    for name, tile, lo, hi, stride in (("tile_grid_core", 512, 64, 576, 512), ("tile_grid_overlap", 448, 0, 448, 358)):
        out[name] = sql(f"SELECT section_index, CAST(y // {stride} AS INT) AS row, CAST(x // {stride} AS INT) AS col, CAST(greatest(y - {lo}, 0) AS INT) AS y0, CAST(greatest(x - {lo}, 0) AS INT) AS x0, CAST(least(y + {hi}, h) AS INT) AS y1, CAST(least(x + {hi}, w) AS INT) AS x1 FROM (SELECT section_index, h, w, y, unnest(range(0, w, {stride})) AS x FROM (SELECT *, unnest(range(0, h, {stride})) AS y FROM (SELECT section_index, section_number * 300 + 100 AS h, section_number * 200 + 64 AS w FROM fx_sections)))", "fx_sections")
    return out
