"""The queries in SQL for DuckDB, each from the tables up and by the textbook form of every formula."""

from __future__ import annotations

OPEN = "(pi() - asin(1737100.0 / 2037100.0))"
SHELLS = 667
SCALE, SCALE_10MHZ = 3, 5

# Rows and meridians of the twelve faces, in units of nside and of an eighth of a turn.
FACE_ROW = "[2, 2, 2, 2, 3, 3, 3, 3, 4, 4, 4, 4]"
FACE_MERIDIAN = "[1, 3, 5, 7, 0, 2, 4, 6, 1, 3, 5, 7]"

_BITS = range(14)
_X = " + ".join(f"(((ipf >> {2 * k}) & 1) << {k})" for k in _BITS)
_Y = " + ".join(f"(((ipf >> {2 * k + 1}) & 1) << {k})" for k in _BITS)

PIXELS = f"""
k AS (SELECT CAST(pow(2, floor(log2(sqrt(count(*) / 12.0)))) AS BIGINT) AS nside FROM part),
p0 AS (SELECT range AS ipix, nside FROM k, range(0, (SELECT 12 * nside * nside FROM k))),
p1 AS (SELECT *, ipix // (nside * nside) AS face, ipix % (nside * nside) AS ipf FROM p0),
p2 AS (SELECT *, ({_X})::BIGINT AS ix, ({_Y})::BIGINT AS iy FROM p1),
p3 AS (SELECT *, {FACE_ROW}[face + 1] * nside - ix - iy - 1 AS jr FROM p2),
p4 AS (SELECT *, CASE WHEN jr < nside THEN 'north' WHEN jr > 3 * nside THEN 'south' ELSE 'equator' END AS region,
         CASE WHEN jr < nside THEN jr WHEN jr > 3 * nside THEN 4 * nside - jr ELSE nside END AS nr,
         CASE WHEN jr >= nside AND jr <= 3 * nside THEN (jr - nside) % 2 ELSE 0 END AS kshift FROM p3),
p5 AS (SELECT *, ({FACE_MERIDIAN}[face + 1] * nr + ix - iy + 1 + kshift) // 2 AS jp0 FROM p4),
pix AS (SELECT *, CASE WHEN jp0 > 4 * nside THEN jp0 - 4 * nside WHEN jp0 < 1 THEN jp0 + 4 * nside ELSE jp0 END AS jp FROM p5)"""
ANGLES = f"""{PIXELS},
ang AS (SELECT ipix, nside, acos(CASE region WHEN 'north' THEN 1 - nr * nr / (3.0 * nside * nside)
           WHEN 'south' THEN -1 + nr * nr / (3.0 * nside * nside) ELSE (2 * nside - jr) * 2.0 / (3 * nside) END::DOUBLE) AS theta,
         pi() / 2 * (jp - (kshift + 1) / 2.0::DOUBLE) / nr AS phi FROM pix)"""
SKY = f"""{ANGLES},
geo AS (SELECT ipix, nside, pi() / 2 - theta AS lat, -(CASE WHEN phi > pi() THEN phi - 2 * pi() ELSE phi END) AS lon FROM ang),
sky AS (SELECT ipix, p_retailprice::DOUBLE * (4 * pi() / (12 * nside * nside)) AS b,
          cos(lat) * cos(lon) AS l, cos(lat) * sin(lon) AS m, sin(lat) AS n FROM geo JOIN part ON p_partkey = ipix)"""
HALF = f"""
h0 AS (SELECT label::INT AS day, vec_id::BIGINT AS bid, {', '.join(f'embedding[{k + 1}]::DOUBLE * {SCALE} AS {c}' for k, c in enumerate('uvw'))},
         {', '.join(f'embedding[{k + 4}]::DOUBLE AS {c}' for k, c in enumerate(('x1', 'y1', 'z1', 'x2', 'y2', 'z2')))} FROM embeddings),
half AS (SELECT *, sqrt(u * u + v * v + w * w) AS bll FROM h0)"""
BOTH = f"""{HALF},
both_ AS (SELECT day, bid, s.sgn, u * s.sgn AS u, v * s.sgn AS v, w * s.sgn AS w, x1, y1, z1, x2, y2, z2, bll
          FROM half, (VALUES (1), (-1)) s(sgn)),
shell AS (SELECT *, ceil((bll - 0.25) / 0.5)::INT AS g FROM both_),
hist AS (SELECT day, g, count(*) AS cnt FROM shell WHERE g BETWEEN 1 AND {SHELLS} GROUP BY day, g),
dens AS (SELECT day, g, cnt, 2 * pi() / 3 * (pow(g / 2.0::DOUBLE + 0.25, 3) - pow(g / 2.0::DOUBLE - 0.25, 3)) / cnt AS dcf FROM hist)"""
GAIN = "CASE WHEN bll = 0 THEN 'nan'::DOUBLE ELSE sqrt(abs(1 - 4 * pow(sin(asin(w / bll)), 2))) / abs(cos(asin(w / bll))) * 1.5 END"


def _weights(offset: int) -> str:
    return f"""{BOTH},
wt AS (SELECT s.*, least((CASE WHEN s.g = 0 THEN 1 / (4 * pi()) ELSE d.dcf END) * ({GAIN}), 0.125) AS wt
       FROM shell s LEFT JOIN dens d ON d.day = s.day AND d.g = s.g + {offset})"""


def _angle(k: int) -> str:
    size = f"sqrt(x{k} * x{k} + y{k} * y{k} + z{k} * z{k})"
    return f"(CASE WHEN {size} = 0 THEN 'nan'::DOUBLE ELSE acos((l * x{k} + m * y{k} + n * z{k}) / {size}) END)"


_SEEN = f"{_angle(1)} <= {OPEN} AND {_angle(2)} <= {OPEN}"
_HIDDEN = f"(({_angle(1)} > {OPEN} AND NOT isnan({_angle(1)})) OR ({_angle(2)} > {OPEN} AND NOT isnan({_angle(2)})))"
_FORWARD = "-2 * pi() * (u * l + v * m + w * (n - 1))"
VISS = f"""{SKY},{HALF},
pairs AS (SELECT day, bid, b, {_FORWARD} AS ph FROM half, sky WHERE {_SEEN}),
sums AS (SELECT day, bid, sum(b * cos(ph)) AS re, sum(b * sin(ph)) AS im, count(*) AS n FROM pairs GROUP BY day, bid),
viss AS (SELECT h.day, h.bid, coalesce(re, 0) AS re, coalesce(im, 0) AS im, coalesce(n, 0) AS n_visible FROM half h LEFT JOIN sums s ON s.day = h.day AND s.bid = h.bid)"""
REPHASED = """
mir AS (SELECT v.day, v.bid, s.sgn, re, im * s.sgn AS im, -2 * pi() * w * s.sgn AS a
        FROM viss v JOIN half h ON h.day = v.day AND h.bid = v.bid, (VALUES (1), (-1)) s(sgn)),
rep AS (SELECT day, bid, sgn, re * cos(a) - im * sin(a) AS re, re * sin(a) + im * cos(a) AS im FROM mir)"""


def _image(masked: bool, offset: int = 0) -> str:
    weights = _weights(offset).replace(HALF + ",", "", 1)
    keep = f"WHERE NOT {_HIDDEN}" if masked else ""
    return f"""{VISS},{REPHASED},{weights},
bl AS (SELECT w_.*, r.re, r.im FROM wt w_ JOIN rep r ON r.day = w_.day AND r.bid = w_.bid AND r.sgn = w_.sgn),
inv AS (SELECT day, ipix, wt * (re * cos(2 * pi() * (u * l + v * m + w * n)) - im * sin(2 * pi() * (u * l + v * m + w * n))) AS c FROM sky, bl {keep}),
img0 AS (SELECT day, ipix, sum(c) AS c FROM inv GROUP BY day, ipix),
img AS (SELECT d.day, s.ipix, coalesce(i.c, 0) AS c FROM sky s CROSS JOIN (SELECT DISTINCT day FROM half) d
        LEFT JOIN img0 i ON i.day = d.day AND i.ipix = s.ipix)"""


def _rounded(*columns: str, places: int = 4) -> str:
    return ", ".join(f"round({c}, {places}) AS {c}" for c in columns)


def _at_10mhz(sql: str) -> str:
    """Other lengths, and shells up to the same length in metres."""
    return sql.replace(f"::DOUBLE * {SCALE} AS", f"::DOUBLE * {SCALE_10MHZ} AS").replace(f"BETWEEN 1 AND {SHELLS}", "BETWEEN 1 AND 6667")


_GENERAL = _image(False).split("inv AS (")[0] + """inv AS (SELECT day, ipix,
         wt * (re * cos(2 * pi() * (u * l + v * m + w * n)) - im * sin(2 * pi() * (u * l + v * m + w * n))) AS c_re,
         wt * (re * sin(2 * pi() * (u * l + v * m + w * n)) + im * cos(2 * pi() * (u * l + v * m + w * n))) AS c_im FROM sky, bl WHERE sgn = 1)"""
_SETTINGS = f"""SELECT unnest(['nside', 'npix', 'resolution_degrees', 'theta', 'phi', 'wavelength', 'shells']) AS name,
  round(unnest([nside::DOUBLE, 12.0::DOUBLE * nside * nside, degrees(sqrt(4 * pi() / (12 * nside * nside))), pi() - {OPEN}, {OPEN}, 3e8 / 1e6,
    ceil(100000.0::DOUBLE / (3e8 / 1e6) * 2)]), 6) AS value FROM k"""
_SPREAD = lambda v: " + ".join(f"((({v} >> {k}) & 1) << {2 * k})" for k in range(14))
_VIEW = f"""
place AS (SELECT range // 800 AS row, range % 800 AS col, 2 - (range % 800 + 0.5::DOUBLE) * (4.0::DOUBLE / 800) AS x, 1 - (range // 800 + 0.5::DOUBLE) * (2.0::DOUBLE / 400) AS y FROM range(320000)),
aux AS (SELECT row, col, x, asin(y) AS a FROM place WHERE x * x / 4 + y * y < 1),
dir AS (SELECT row, col, asin((2 * a + sin(2 * a)) / pi()) AS lat, x * (pi() / 2) / cos(a) AS lon FROM aux),
pos AS (SELECT row, col, cos(pi() / 2 - lat) AS z, (CASE WHEN lon < 0 THEN lon + 2 * pi() ELSE lon END) / (pi() / 2) AS t, nside FROM dir, k),
par AS (SELECT *, least(floor(t), 3)::BIGINT AS q, sqrt(3 * (1 - abs(z))) AS s, abs(z) > 2.0::DOUBLE / 3 AS cap FROM pos),
dia AS (SELECT *, CASE WHEN cap THEN least(floor(nside * s * (t - q)), nside - 1) ELSE floor(nside * (0.5::DOUBLE + t - 0.75::DOUBLE * z)) END::BIGINT AS up,
          CASE WHEN cap THEN least(floor(nside * s * (1 - (t - q))), nside - 1) ELSE floor(nside * (0.5::DOUBLE + t + 0.75::DOUBLE * z)) END::BIGINT AS down FROM par),
fac AS (SELECT *, CASE WHEN cap THEN CASE WHEN z > 0 THEN q ELSE q + 8 END WHEN up // nside = down // nside THEN (up // nside) % 4 + 4
          WHEN up // nside < down // nside THEN (up // nside) % 4 ELSE (down // nside) % 4 + 8 END AS face,
          CASE WHEN cap THEN CASE WHEN z > 0 THEN nside - 1 - down ELSE up END ELSE down % nside END AS fx,
          CASE WHEN cap THEN CASE WHEN z > 0 THEN nside - 1 - up ELSE down END ELSE nside - 1 - up % nside END AS fy FROM dia),
view_ AS (SELECT row, col, face * nside * nside + ({_SPREAD('fx')}) + 2 * ({_SPREAD('fy')}) AS ipix FROM fac)"""
_COLUMNS = ("u", "v", "w", "x1", "y1", "z1", "x2", "y2", "z2", "bll")
_TOTAL = "SELECT ipix, round(sum(CASE WHEN isnan(c) THEN 0 ELSE c END), 3) AS c FROM img GROUP BY ipix"
_NUMBERED = f"{HALF}, num AS (SELECT *, row_number() OVER (PARTITION BY day ORDER BY bid) - 1 AS rn FROM half)"

ORACLE_SQL = {
    "pix_face": f"WITH {PIXELS} SELECT ipix, face::INT AS face, ipf FROM pix",
    "pix_xy": f"WITH {PIXELS} SELECT ipix, ix, iy FROM pix",
    "pix_ring": f"WITH {PIXELS} SELECT ipix, jr, nr, kshift FROM pix",
    "pix_jp": f"WITH {PIXELS} SELECT ipix, jp FROM pix",
    "pix_region_counts": f"WITH {PIXELS} SELECT region, count(*) AS n FROM pix GROUP BY region",
    "pix2ang": f"WITH {ANGLES} SELECT ipix, {_rounded('theta', 'phi', places=6)} FROM ang",
    "pix_resolution": f"WITH {PIXELS} SELECT nside, 12 * nside * nside AS npix, round(degrees(sqrt(4 * pi() / (12 * nside * nside))), 6) AS degrees, round(4 * pi() / (12 * nside * nside), 9) AS area FROM k",
    "sky_lmn": f"WITH {SKY} SELECT ipix, round(b, 4) AS b, {_rounded('l', 'm', 'n', places=6)} FROM sky",
    "satellite_norm": f"WITH {HALF} SELECT day, bid, round(sqrt(x1 * x1 + y1 * y1 + z1 * z1), 6) AS norm1, round(sqrt(x2 * x2 + y2 * y2 + z2 * z2), 6) AS norm2 FROM half",
    "baseline_mirror": f"WITH {BOTH} SELECT day, bid, sgn, {_rounded('u', 'v', 'w', 'bll', places=6)} FROM both_",
    "baseline_zip": f"WITH {_NUMBERED} SELECT day, rn, {_rounded('u', 'v', 'w', 'x1', 'y1', 'z1', 'x2', 'y2', 'z2', 'bll', places=6)} FROM num",
    "baseline_half": f"WITH {_NUMBERED}, c AS (SELECT day, count(*) AS n FROM half GROUP BY day) SELECT num.day, rn, round(bll, 6) AS bll FROM num JOIN c ON c.day = num.day WHERE rn < n // 2",
    "shell_id": f"WITH {BOTH} SELECT day, bid, g FROM shell WHERE sgn = 1",
    "shell_hist": f"WITH {BOTH} SELECT day, g, cnt FROM hist",
    "shell_sorted": f"WITH {BOTH} SELECT day, g, bid FROM shell WHERE sgn = 1 ORDER BY day, g, bid LIMIT 100",
    "shell_sorted_all": f"WITH {BOTH} SELECT day, g, bid FROM shell WHERE sgn = 1 ORDER BY day, g, bid",
    "shell_dcf": f"WITH {BOTH} SELECT day, g, round(dcf, 6) AS dcf FROM dens",
    "shell_dcf_shifted": f"WITH {BOTH} SELECT day, g - 1 AS g, round(dcf, 6) AS dcf FROM dens WHERE g > 1",
    "incl_gain": f"WITH {HALF} SELECT day, bid, round({GAIN}, 4) AS dg FROM half",
    "weight": f"WITH {_weights(0)} SELECT day, bid, sgn, round(wt, 6) AS wt FROM wt",
    "weight_shifted": f"WITH {_weights(1)} SELECT day, bid, sgn, round(wt, 6) AS wt FROM wt",
    "vis_mask_count": f"WITH {VISS} SELECT day, bid, n_visible FROM viss",
    "vis_forward": f"WITH {VISS} SELECT day, bid, {_rounded('re', 'im')} FROM viss",
    "vis_amplitude": f"WITH {VISS} SELECT day, bid, round(sqrt(re * re + im * im), 4) AS amp FROM viss",
    "vis_rephased": f"WITH {VISS},{REPHASED} SELECT day, bid, sgn, {_rounded('re', 'im')} FROM rep",
    "preview_vis": f"WITH {VISS} SELECT day, bid, {_rounded('re', 'im')} FROM (SELECT *, row_number() OVER (PARTITION BY day ORDER BY bid) AS k FROM viss) WHERE k <= 3",
    "point_source": f"WITH {SKY},{HALF} SELECT day, bid, round(b, 4) AS amp FROM half, sky WHERE ipix = 100",
    "image_noblockage": f"WITH {_image(False)} SELECT day, ipix, round(c, 4) AS c FROM img",
    "image_blockage": f"WITH {_image(True)} SELECT day, ipix, round(c, 4) AS c FROM img",
    "image_blockage_shifted": f"WITH {_image(True, 1)} SELECT day, ipix, round(c, 4) AS c FROM img",
    "image_total": f"WITH {_image(False)} {_TOTAL}",
    "image_total_blockage": f"WITH {_image(True)} {_TOTAL}",
    "image_general": f"WITH {_GENERAL} SELECT day, ipix, round(sum(c_re), 4) AS c_re, round(sum(c_im), 4) AS c_im FROM inv GROUP BY day, ipix",
    "image_10mhz": f"WITH {_at_10mhz(_image(True))} SELECT day, ipix, round(c, 4) AS c FROM img",
    "image_10mhz_noblockage": f"WITH {_at_10mhz(_image(False))} SELECT day, ipix, round(c, 4) AS c FROM img",
    "image_from_files": f"WITH {_image(True)} SELECT day, ipix, round(c, 4) AS c FROM img",
    "viss_injected": f"WITH {_image(False)} SELECT day, ipix, round(c, 4) AS c FROM img",
    "preview_image": f"WITH {_image(True)} SELECT day, ipix, round(c, 4) AS c FROM img WHERE ipix < 3",
    "map_export": f"WITH {_image(True)} {_TOTAL} ORDER BY ipix",
    "map_mollweide": f"WITH {_image(True)}, total AS ({_TOTAL}), {_VIEW} SELECT row::INT AS row, col::INT AS col, c FROM view_ LEFT JOIN total USING (ipix)",
    "mollweide_counts": f"WITH {PIXELS}, {_VIEW} SELECT ipix, count(*) AS n FROM view_ GROUP BY ipix",
    "text_roundtrip": f"WITH {_NUMBERED} SELECT day, rn, {_rounded(*_COLUMNS, places=6)} FROM num",
    "text_roundtrip_all": f"WITH {_NUMBERED} SELECT day, rn, true AS same FROM num",
    "list_counted": f"WITH {PIXELS} SELECT ipix AS rn, round(p_retailprice::DOUBLE, 4) AS b FROM pix JOIN part ON p_partkey = ipix",
    "list_angles": f"WITH {ANGLES} SELECT ipix AS rn, {_rounded('theta', 'phi', places=6)} FROM ang",
    "constants_log": f"WITH {PIXELS} {_SETTINGS}",
}
