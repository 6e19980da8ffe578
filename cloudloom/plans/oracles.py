"""DuckDB SQL with the rows of the core queries."""

from __future__ import annotations

from .clouds import SQL
from .queries import BOXES, CAP, CENTRES, CHAINS, COLOUR_BITS, HEADER, POSITION_BITS, RADIUS, WEIGHT
from ..params import SPELLINGS, chain

ORACLES: dict[str, str] = {}
PB, CB = POSITION_BITS, COLOUR_BITS
XYZ, RGB = "xyz", "rgb"


def each(template: str, over: str = XYZ, sep: str = ", ") -> str:
    return sep.join(template.replace("%", c) for c in over)


def add(name: str, source: str, body: str, *ctes: str) -> None:
    ORACLES[name] = "WITH " + ", ".join([f"p AS ({SQL[source]})", *ctes]) + " " + body


BOUNDS = f"b AS (SELECT cloud_id, count(*) AS n, {each('min(%) AS min_%, max(%) AS max_%', XYZ + RGB)} FROM p GROUP BY cloud_id)"


def code(c: str, bits: int) -> str:
    """A quantised code in 32-bit arithmetic."""
    v, lo, hi = (f"CAST({x} AS FLOAT)" for x in (c, f"min_{c}", f"max_{c}"))
    top = f"CAST({float((1 << bits) - 1)} AS FLOAT)"
    scaled = f"floor(CAST(CAST(CAST({v} - {lo} AS FLOAT) * CAST({top} / CAST({hi} - {lo} AS FLOAT) AS FLOAT) AS FLOAT) + CAST(0.5 AS FLOAT) AS FLOAT))"
    return f"CASE WHEN CAST({hi} - {lo} AS FLOAT) > CAST(1.1920928955078125e-07 AS FLOAT) THEN greatest(0, least({(1 << bits) - 1}, CAST({scaled} AS BIGINT))) ELSE 0 END"


def back(q: str, c: str, bits: int) -> str:
    lo, hi = (f"CAST({x} AS FLOAT)" for x in (f"min_{c}", f"max_{c}"))
    step = f"CAST(CAST({hi} - {lo} AS FLOAT) / CAST({float((1 << bits) - 1)} AS FLOAT) AS FLOAT)"
    return f"CASE WHEN {hi} - {lo} <= 0 THEN {lo} ELSE CAST(CAST({q} AS DOUBLE) * CAST({step} AS DOUBLE) + CAST({lo} AS DOUBLE) AS FLOAT) END"


def colour_code(c: str, bits: int) -> str:
    same = f"CASE WHEN min_{c} = 0 AND max_{c} = 255 THEN CAST({c} AS BIGINT) ELSE {code(c, bits)} END"
    return same if bits == 8 else code(c, bits)


def colour_back(q: str, c: str, bits: int) -> str:
    step = f"CAST(CAST(max_{c} - min_{c} AS FLOAT) / CAST({float((1 << bits) - 1)} AS FLOAT) AS FLOAT)"
    return f"CAST(greatest(0, least(255, round(CAST({q} AS DOUBLE) * CAST({step} AS DOUBLE) + min_{c}))) AS INTEGER)"


def codes(bits: int, colour_bits: int = CB) -> str:
    positions = ", ".join(f"{code(c, bits)} AS q{c}" for c in XYZ)
    colours = ", ".join(f"{colour_code(c, colour_bits)} AS q{c}" for c in RGB)
    return f"q AS (SELECT p.*, b.* EXCLUDE (cloud_id), {positions}, {colours} FROM p JOIN b USING (cloud_id))"


def test_cloud(bits: int = PB, colour_bits: int = CB) -> str:
    positions = ", ".join(f"{back(f'q{c}', c, bits)} AS {c}" for c in XYZ)
    colours = ", ".join(f"{colour_back(f'q{c}', c, colour_bits)} AS {c}" for c in RGB)
    return f"t AS (SELECT cloud_id, idx, {positions}, {colours} FROM q)"


def d2(a: str, b: str) -> str:
    return " + ".join(f"(CAST({a}.{c} AS DOUBLE) - CAST({b}.{c} AS DOUBLE)) * (CAST({a}.{c} AS DOUBLE) - CAST({b}.{c} AS DOUBLE))" for c in XYZ)


def match(name: str, a: str, b: str) -> str:
    best = f"row_number() OVER (PARTITION BY {a}.cloud_id, {a}.idx ORDER BY {d2(a, b)}, {b}.idx)"
    return f"{name} AS (SELECT cloud_id, idx, ref_idx, sqrt(d2) AS dist FROM (SELECT {a}.cloud_id, {a}.idx, {b}.idx AS ref_idx, {d2(a, b)} AS d2, {best} AS k FROM {a} JOIN {b} ON {a}.cloud_id = {b}.cloud_id) WHERE k = 1)"


PAIR = [BOUNDS, codes(PB), test_cloud()]
FORWARD = match("f", "t", "p")
SYMMETRIC = [
    match("g", "p", "t"),
    "fa AS (SELECT f.*, (row_number() OVER (PARTITION BY f.cloud_id ORDER BY f.idx) - 1) % b.n AS place FROM f JOIN b USING (cloud_id))",
    "ga AS (SELECT *, row_number() OVER (PARTITION BY cloud_id ORDER BY idx) - 1 AS place FROM g)",
    "s AS (SELECT fa.cloud_id, fa.idx, (fa.dist + ga.dist) * 0.5::DOUBLE AS dist FROM fa JOIN ga ON fa.cloud_id = ga.cloud_id AND fa.place = ga.place)",
]


def ranked(name: str, source: str, value: str, **percents: float) -> str:
    at = ", ".join(f"max(CASE WHEN place = floor({p / 100.0}::DOUBLE * (n - 1) + 0.5) THEN v END) AS {k}" for k, p in percents.items())
    return f"{name} AS (SELECT cloud_id, {at} FROM (SELECT cloud_id, {value} AS v, row_number() OVER (PARTITION BY cloud_id ORDER BY {value}) - 1 AS place, count(*) OVER (PARTITION BY cloud_id) AS n FROM {source}) GROUP BY cloud_id)"


def distances(source: str, prefix: str = "d1") -> list[str]:
    return [ranked("r", source, "dist", **{f"{prefix}_median": 50.0, f"{prefix}_p95": 95.0}), f"e AS (SELECT cloud_id, sqrt(avg(dist * dist)) AS {prefix}_rmse FROM {source} GROUP BY cloud_id)"]


def shown(*columns: str, digits: int = 9) -> str:
    return ", ".join(f"round({c}, {digits}) AS {c}" for c in columns)


MAD = [
    ranked("m", "s", "dist", median=50.0),
    "o AS (SELECT s.*, median, abs(dist - median) AS off FROM s JOIN m USING (cloud_id))",
    ranked("a", "o", "off", mad=50.0),
    "ratio AS (SELECT cloud_id, avg(CASE WHEN dist > median + 3.0::DOUBLE * mad THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END) AS outlier_ratio FROM o JOIN a USING (cloud_id) GROUP BY cloud_id)",
]
LUMA = [("y", "0.2126::DOUBLE * {a}r + 0.7152::DOUBLE * {a}g + 0.0722::DOUBLE * {a}b"), ("cb", "-0.1146::DOUBLE * {a}r + -0.3854::DOUBLE * {a}g + 0.5::DOUBLE * {a}b + 128.0::DOUBLE"), ("cr", "0.5::DOUBLE * {a}r + -0.4542::DOUBLE * {a}g + -0.0458::DOUBLE * {a}b + 128.0::DOUBLE")]


def _mse() -> list[str]:
    square = lambda e: f"({e.format(a='t.')} - ({e.format(a='p.')})) * ({e.format(a='t.')} - ({e.format(a='p.')}))"
    mse = ", ".join(f"avg({square(e)}) AS {n}_mse" for n, e in LUMA)
    psnr = ", ".join(f"CASE WHEN {n}_mse <= 0 THEN 'inf'::DOUBLE ELSE 20.0::DOUBLE * log10(255.0::DOUBLE / sqrt({n}_mse)) END AS {n}_psnr" for n, _ in LUMA)
    return [
        f"mse AS (SELECT f.cloud_id, {mse} FROM f JOIN t ON f.cloud_id = t.cloud_id AND f.idx = t.idx JOIN p ON f.cloud_id = p.cloud_id AND f.ref_idx = p.idx GROUP BY f.cloud_id)",
        f"col AS (SELECT *, {psnr} FROM mse)",
    ]


add("cloud_bounds", "points_li", f"SELECT cloud_id, count(*) AS n, {each('min(%) AS min_%, max(%) AS max_%')} FROM p GROUP BY cloud_id")
add("color_bounds", "points_li", f"SELECT cloud_id, {each('min(%) AS min_%, max(%) AS max_%', RGB)} FROM p GROUP BY cloud_id")
add("splat_bounds", "splats_emb", "SELECT cloud_id, count(*) AS n, " + each("CAST((CAST(max(%) AS DOUBLE) + CAST(min(%) AS DOUBLE)) * 0.5::DOUBLE AS FLOAT) AS centre_%, CAST((CAST(max(%) AS DOUBLE) - CAST(min(%) AS DOUBLE)) * 0.5::DOUBLE AS FLOAT) AS extent_%") + " FROM p GROUP BY cloud_id")
add("qnt_positions", "points_li", "SELECT cloud_id, idx, qx, qy, qz FROM q", BOUNDS, codes(12))
add("qnt_colors", "points_li", "SELECT cloud_id, idx, qr, qg, qb FROM q", BOUNDS, codes(12))
add("qnt_roundtrip", "points_li", "SELECT * FROM t", *PAIR)
INDEX_BITS = "CASE WHEN n <= 1 THEN 0 ELSE length(ltrim(bin(n - 1), '0')) END"
add("storage_bits", "points_ev", f"SELECT cloud_id, n, CAST({INDEX_BITS} AS INTEGER) AS index_bits, CAST(CASE WHEN {INDEX_BITS} = 0 THEN 0 WHEN {INDEX_BITS} <= 8 THEN 8 WHEN {INDEX_BITS} <= 16 THEN 16 ELSE 32 END AS INTEGER) AS wide_bits FROM (SELECT cloud_id, CAST(count(DISTINCT r) AS INTEGER) AS n FROM p GROUP BY cloud_id)")
add("delta_encode", "points_li", "SELECT cloud_id, idx, " + each("(q% - lag(q%, 1, 0) OVER (PARTITION BY cloud_id ORDER BY idx)) & 4095 AS delta_q%") + " FROM q", BOUNDS, codes(12))
add("delta_roundtrip", "points_li", "SELECT cloud_id, idx, qx, qy, qz FROM q", BOUNDS, codes(12))
add("nn_join", "points_emb", "SELECT cloud_id, idx, ref_idx, round(dist, 9) AS dist FROM f", *PAIR, FORWARD)
add("knn_join", "points_emb", f"SELECT cloud_id, idx, CAST(rank AS INTEGER) AS rank, ref_idx, round(d2, 9) AS d2 FROM (SELECT p.cloud_id, p.idx, r.idx AS ref_idx, {d2('p', 'r')} AS d2, row_number() OVER (PARTITION BY p.cloud_id, p.idx ORDER BY {d2('p', 'r')}, r.idx) AS rank FROM p JOIN p r ON p.cloud_id = r.cloud_id) WHERE rank <= 4")
add("axis_ties", "points_li", "SELECT cloud_id, max(n) AS max_ties, CAST(CASE WHEN max(n) <= 32 THEN 32 WHEN max(n) <= 128 THEN 128 WHEN max(n) <= 512 THEN 512 WHEN max(n) <= 1024 THEN 1024 WHEN max(n) <= 2048 THEN 2048 WHEN max(n) <= 8192 THEN 8192 ELSE 0 END AS INTEGER) AS bucket FROM (" + each("SELECT cloud_id, '%' AS axis, % AS v, count(*) AS n FROM p GROUP BY ALL", XYZ, " UNION ALL ") + ") GROUP BY cloud_id")
add("d1_metrics", "points_emb", f"SELECT cloud_id, {shown('d1_rmse', 'd1_median', 'd1_p95')} FROM e JOIN r USING (cloud_id)", *PAIR, FORWARD, *distances("f"))
add("d1_symmetric", "points_emb", f"SELECT cloud_id, {shown('d1_rmse', 'd1_median', 'd1_p95')} FROM e JOIN r USING (cloud_id)", *PAIR, FORWARD, *SYMMETRIC, *distances("s"))
add("d1_chamfer", "points_emb", "SELECT cloud_id, round(avg(dist), 9) AS mean_distance, round(max(dist), 9) AS hausdorff FROM (SELECT cloud_id, dist FROM f UNION ALL SELECT cloud_id, dist FROM g) GROUP BY cloud_id", *PAIR, FORWARD, match("g", "p", "t"))
add("outlier_abs", "points_emb", "SELECT cloud_id, round(avg(CASE WHEN dist > 0.0002::DOUBLE THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 9) AS outlier_ratio FROM f GROUP BY cloud_id", *PAIR, FORWARD)
add("outlier_mad3", "points_emb", "SELECT cloud_id, round(outlier_ratio, 9) AS outlier_ratio FROM ratio", *PAIR, FORWARD, *SYMMETRIC, *MAD)
add("ycbcr", "points_ev", "SELECT cloud_id, idx, " + ", ".join(f"round({e.format(a='')}, 9) AS {n}" for n, e in LUMA) + " FROM p")
add("color_psnr", "points_emb", f"SELECT cloud_id, {shown(*(f'{n}_{m}' for n in ('y', 'cb', 'cr') for m in ('mse', 'psnr')), digits=6)} FROM col", *PAIR, FORWARD, *_mse())
SIZE = f"(40 + (n * {3 * PB + 3 * CB} + 7) // 8)"
add(
    "sweep_quality", "points_emb", f"SELECT cloud_id, n, round(8.0::DOUBLE * {SIZE} / greatest(n, 1), 6) AS bpp, {shown('d1_rmse', 'd1_median', 'd1_p95', 'outlier_ratio', 'y_psnr', 'cb_psnr', 'cr_psnr', digits=6)} FROM b JOIN e USING (cloud_id) JOIN r USING (cloud_id) JOIN ratio USING (cloud_id) JOIN col USING (cloud_id)",
    *PAIR, FORWARD, *SYMMETRIC, *distances("s"), *MAD, *_mse(),
)
_SWEEPS, _CTES = [], [BOUNDS]
for _b in (8, 11, 16):
    off = " + ".join(f"(CAST({back(code(c, _b), c, _b)} AS DOUBLE) - CAST({c} AS DOUBLE)) * (CAST({back(code(c, _b), c, _b)} AS DOUBLE) - CAST({c} AS DOUBLE))" for c in XYZ)
    _SWEEPS.append(f"SELECT 'p{_b}' AS sweep_name, 8.0::DOUBLE * (40 + (count(*) * {3 * _b + 24} + 7) // 8) / count(*) AS bpp, sqrt(avg({off})) AS rmse FROM p JOIN b USING (cloud_id) GROUP BY cloud_id")
add("sweep_summary", "points_li", "SELECT sweep_name, count(*) AS n, round(list_sort(list(bpp))[count(bpp) // 2 + 1], 6) AS bpp_median, round(list_sort(list(rmse))[count(rmse) // 2 + 1], 6) AS rmse_median FROM (" + " UNION ALL ".join(_SWEEPS) + ") GROUP BY sweep_name", *_CTES)

BIN = "(r >> 3) | ((g >> 3) << 5) | ((b >> 3) << 10)"
HIST = f"h AS (SELECT cloud_id, {BIN} AS bin, count(*) AS n, {each('CAST(sum(%) AS BIGINT) AS sum_%', RGB)} FROM p GROUP BY ALL)"
ENTRIES = f"e AS (SELECT cloud_id, row_number() OVER (PARTITION BY cloud_id ORDER BY n DESC, bin) - 1 AS entry, bin, n, {each('CAST((sum_% + n // 2) // n AS INTEGER) AS p%', RGB)} FROM h QUALIFY entry < {CAP})"
add("palette_hist", "points_li", "SELECT * FROM h", HIST)
add("palette_topk", "points_li", "SELECT cloud_id, CAST(entry AS INTEGER) AS entry, bin, n, pr, pg, pb FROM e", HIST, ENTRIES)
FAR = each("(p% - %) * (p% - %)", RGB, " + ")
CENTRE_FAR = " + ".join(f"(p{c} - ((((m.bin >> {5 * i}) & 31) << 3) + 4)) * (p{c} - ((((m.bin >> {5 * i}) & 31) << 3) + 4))" for i, c in enumerate(RGB))
PALETTE = [
    f"bins AS (SELECT cloud_id, {BIN} AS bin, arg_min(r, idx) AS r, arg_min(g, idx) AS g, arg_min(b, idx) AS b FROM p GROUP BY ALL)",
    "miss AS (SELECT * FROM bins ANTI JOIN e USING (cloud_id, bin))",
    f"around AS (SELECT m.cloud_id, m.bin, entry, e.bin AS bin2, {FAR} AS far, greatest(abs((e.bin & 31) - (m.bin & 31)), abs(((e.bin >> 5) & 31) - ((m.bin >> 5) & 31)), abs((e.bin >> 10) - (m.bin >> 10))) AS shell, "
    f"(((e.bin & 31) - (m.bin & 31) + 2) * 5 + ((e.bin >> 5) & 31) - ((m.bin >> 5) & 31) + 2) * 5 + (e.bin >> 10) - (m.bin >> 10) + 2 AS k, {CENTRE_FAR} AS off FROM miss m JOIN e ON m.cloud_id = e.cloud_id)",
    "near AS (SELECT cloud_id, bin, arg_min(entry, (shell, far, k)) AS entry FROM around WHERE shell <= 2 GROUP BY ALL)",
    "rest AS (SELECT cloud_id, bin, arg_min(entry, (off, entry)) AS entry FROM around ANTI JOIN near USING (cloud_id, bin) GROUP BY ALL)",
    "all_bins AS (SELECT cloud_id, bin, entry FROM e UNION ALL SELECT * FROM near UNION ALL SELECT * FROM rest)",
]
OWN_BIN = BIN.replace("(r ", "(p.r ").replace("(g ", "(p.g ").replace("(b ", "(p.b ")
add("palette_assign", "points_li", f"SELECT p.cloud_id, idx, CAST(entry AS INTEGER) AS entry FROM p JOIN all_bins a ON p.cloud_id = a.cloud_id AND {OWN_BIN} = a.bin", HIST, ENTRIES, *PALETTE)
add("palette_estimate", "points_li", "SELECT cloud_id, n, (n * 60 + 7) // 8 AS plain, (n * 44 + 7) // 8 + 2 + 768 AS indexed, (n * 44 + 7) // 8 + 2 + 768 + 256 < (n * 60 + 7) // 8 AS wins FROM (SELECT cloud_id, count(*) AS n FROM p GROUP BY cloud_id)")
MORTON = " | ".join(f"(((q{c} >> {i}) & 1) << {3 * i + j})" for i in range(16) for j, c in enumerate(XYZ))
add("morton_order", "points_li", "SELECT cloud_id, idx, morton, row_number() OVER (PARTITION BY cloud_id ORDER BY morton, idx) - 1 AS rank FROM z", BOUNDS, codes(16), f"z AS (SELECT cloud_id, idx, {MORTON} AS morton FROM q)")
add("sogp_planes", "points_li", "SELECT cloud_id, idx, " + each("q% & 255 AS lo_%, q% >> 8 AS hi_%") + " FROM q", BOUNDS, codes(16))
add("sogp_roundtrip", "points_li", "SELECT cloud_id, idx, " + ", ".join(f"{back(f'q{c}', c, 16)} AS d{c}" for c in XYZ) + " FROM q", BOUNDS, codes(16))

SH = "0.28209479177387814::DOUBLE"
DC = lambda c: f"((CAST({c} AS DOUBLE) / 255.0::DOUBLE - 0.5::DOUBLE) / {SH})"
SHARE = "greatest(1e-6::DOUBLE, least(0.999999::DOUBLE, CAST(a AS DOUBLE) / 255.0::DOUBLE))"
LOGIT = f"ln({SHARE} / (1.0::DOUBLE - {SHARE}))"
LOGS = lambda c: f"CASE WHEN isfinite(scale_{c}) AND scale_{c} > 0 THEN ln(CAST(scale_{c} AS DOUBLE)) ELSE 0.0::DOUBLE END"
add(
    "splat_ply_fields", "splats_emb", "SELECT cloud_id, idx, " + ", ".join(f"round({DC(c)}, 9) AS f_dc_{i}" for i, c in enumerate(RGB)) + f", round({LOGIT}, 9) AS opacity, " + ", ".join(f"round({LOGS(c)}, 9) AS log_{c}" for c in XYZ)
    + ", " + ", ".join(f"round(CASE WHEN isfinite(rot_{c}) THEN CAST(rot_{c} AS DOUBLE) ELSE {1 if c == 'w' else 0} END, 9) AS q{c}" for c in "wxyz") + " FROM p",
)
BYTE = lambda v: f"CAST(greatest(0, least(255, floor(({v}) * 255.0::DOUBLE + 0.5::DOUBLE))) AS INTEGER)"
SIGMOID = f"(1.0::DOUBLE / (1.0::DOUBLE + exp(-({LOGIT}))))"
add("splat_ply_roundtrip", "splats_emb", "SELECT cloud_id, idx, " + ", ".join(f"{BYTE(f'{SH} * {DC(c)} + 0.5::DOUBLE')} AS {c}" for c in RGB) + f", {BYTE(SIGMOID)} AS a, " + ", ".join(f"round(exp({LOGS(c)}), 6) AS scale_{c}" for c in XYZ) + " FROM p")
SCALE = lambda c: f"CASE WHEN isfinite(scale_{c}) AND CAST(scale_{c} AS DOUBLE) >= exp(-30.0::DOUBLE) THEN CAST(greatest(1, least(255, round((ln(CAST(scale_{c} AS DOUBLE)) + 12.0::DOUBLE) * (254.0::DOUBLE / 21.0::DOUBLE) + 1.0::DOUBLE))) AS INTEGER) ELSE 0 END"
SCALES = "k AS (SELECT *, " + ", ".join(f"{SCALE(c)} AS s{c}" for c in XYZ) + " FROM p)"
add("gsp_scale_codes", "splats_emb", "SELECT cloud_id, idx, sx, sy, sz, " + each("round(CASE WHEN s% = 0 THEN 0.0::DOUBLE ELSE exp(-12.0::DOUBLE + (s% - 1) * (21.0::DOUBLE / 254.0::DOUBLE)) END, 6) AS v%") + " FROM k", SCALES)
ROTATION = [
    "u0 AS (SELECT *, sqrt(" + each("CAST(rot_% AS DOUBLE) * CAST(rot_% AS DOUBLE)", "wxyz", " + ") + ") AS len, CASE WHEN rot_w < 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END AS sgn FROM {src})",
    "u1 AS (SELECT *, " + ", ".join(f"CASE WHEN len > 0 THEN sgn * CAST(rot_{c} AS DOUBLE) / len ELSE {1.0 if c == 'w' else 0.0} END AS n{c}" for c in "wxyz") + " FROM u0)",
    "u2 AS (SELECT *, 2.0::DOUBLE * acos(least(1.0::DOUBLE, nw)) AS theta, sqrt(greatest(0.0::DOUBLE, 1.0::DOUBLE - least(1.0::DOUBLE, nw) * least(1.0::DOUBLE, nw))) AS sn FROM u1)",
    "u3 AS (SELECT *, " + ", ".join(f"CASE WHEN sn > 1e-8 THEN n{c} / sn ELSE {1.0 if c == 'x' else 0.0} END AS a{c}" for c in XYZ) + " FROM u2)",
    "u4 AS (SELECT *, ax / (abs(ax) + abs(ay) + abs(az)) AS ou, ay / (abs(ax) + abs(ay) + abs(az)) AS ov FROM u3)",
    "u5 AS (SELECT *, CASE WHEN az < 0 THEN (1.0::DOUBLE - abs(ov)) * CASE WHEN ou < 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END ELSE ou END AS fu, CASE WHEN az < 0 THEN (1.0::DOUBLE - abs(ou)) * CASE WHEN ov < 0 THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END ELSE ov END AS fv FROM u4)",
    f"u6 AS (SELECT *, {BYTE('fu * 0.5::DOUBLE + 0.5::DOUBLE')} AS u, {BYTE('fv * 0.5::DOUBLE + 0.5::DOUBLE')} AS v, {BYTE('theta / pi()')} AS angle FROM u5)",
]
_ROT = [c.replace("{src}", "p") for c in ROTATION]
add(
    "gsp_rotation_codes", "splats_emb", "SELECT cloud_id, idx, u, v, angle, round(cos(half), 6) AS qw, " + ", ".join(f"round(sin(half) * {c} / sqrt(bx * bx + by_ * by_ + bz * bz), 6) AS q{n}" for n, c in (("x", "bx"), ("y", "by_"), ("z", "bz"))) + " FROM w2",
    *_ROT,
    "w1 AS (SELECT *, u / 255.0::DOUBLE * 2.0::DOUBLE - 1.0::DOUBLE AS da, v / 255.0::DOUBLE * 2.0::DOUBLE - 1.0::DOUBLE AS db, angle / 255.0::DOUBLE * pi() * 0.5::DOUBLE AS half FROM u6)",
    "w2 AS (SELECT *, 1.0::DOUBLE - abs(da) - abs(db) AS bz, CASE WHEN 1.0::DOUBLE - abs(da) - abs(db) < 0 THEN (1.0::DOUBLE - abs(db)) * CASE WHEN da < 0 THEN -1 ELSE 1 END ELSE da END AS bx, CASE WHEN 1.0::DOUBLE - abs(da) - abs(db) < 0 THEN (1.0::DOUBLE - abs(da)) * CASE WHEN db < 0 THEN -1 ELSE 1 END ELSE db END AS by_ FROM w1)",
)
LEN = "sqrt(" + each("CAST(rot_% AS DOUBLE) * CAST(rot_% AS DOUBLE)", "wxyz", " + ") + ")"
add("splat_normalised", "splats_emb", "SELECT cloud_id, idx, " + ", ".join(f"round(CASE WHEN {LEN} > 0 THEN CAST(rot_{c} AS DOUBLE) / {LEN} ELSE {1 if c == 'w' else 0} END, 9) AS q{c}" for c in "wxyz") + ", " + each("round(CAST(% AS DOUBLE) / 255.0::DOUBLE, 9) AS share_%", "rgba") + " FROM p")
HALF_STEP = lambda c: f"pow(2.0::DOUBLE, greatest(-14, floor(log2(abs(CAST({c} AS DOUBLE))))) - 10)"
HALF_COUNT = lambda c: f"round_even(abs(CAST({c} AS DOUBLE)) / {HALF_STEP(c)}, 0)"
HALF_BITS = lambda c: f"CASE WHEN {c} = 0 THEN 0 ELSE CAST((greatest(-14, floor(log2(abs(CAST({c} AS DOUBLE))))) + 14) * 1024 + {HALF_COUNT(c)} AS BIGINT) + CASE WHEN {c} < 0 THEN 32768 ELSE 0 END END"
HALF = lambda c: f"CAST(CASE WHEN {c} = 0 THEN 0 ELSE sign({c}) * {HALF_COUNT(c)} * {HALF_STEP(c)} END AS FLOAT)"
WORDS = f"CAST(r AS BIGINT) + (CAST(g AS BIGINT) << 8) + (CAST(b AS BIGINT) << 16) + (CAST(a AS BIGINT) << 24) AS w0, {HALF_BITS('x')} + ({HALF_BITS('y')} << 16) AS w1, {HALF_BITS('z')} + (CAST(u AS BIGINT) << 16) + (CAST(v AS BIGINT) << 24) AS w2, CAST(sx AS BIGINT) + (CAST(sy AS BIGINT) << 8) + (CAST(sz AS BIGINT) << 16) + (CAST(angle AS BIGINT) << 24) AS w3"
add("gsp_words", "splats_emb", f"SELECT cloud_id, idx, {WORDS} FROM u6", SCALES, *(c.replace("{src}", "k") for c in ROTATION))

H = "((CAST(idx AS BIGINT) * 2654435761 + 12345) % 4294967296)"
DRAW = f"(({H} * 69069 + ({H} >> 16)) % 4294967296)"
add("sample_rate", "points_li", f"SELECT cloud_id, idx FROM (SELECT cloud_id, idx, {DRAW} AS d, row_number() OVER (PARTITION BY cloud_id ORDER BY {DRAW}, idx) AS k FROM p) WHERE d < {int(0.1 * 2**32)} OR k = 1")
add("sample_count", "points_li", f"SELECT cloud_id, idx FROM p QUALIFY row_number() OVER (PARTITION BY cloud_id ORDER BY {DRAW}, idx) <= 100")
NEAR = " OR ".join("(" + " + ".join(f"(CAST({c} AS DOUBLE) - {v}::DOUBLE) * (CAST({c} AS DOUBLE) - {v}::DOUBLE)" for c, v in zip(XYZ, centre, strict=True)) + f" <= {RADIUS**2!r}::DOUBLE)" for centre in CENTRES)
add("sample_biased", "points_emb", f"SELECT cloud_id, idx FROM p QUALIFY row_number() OVER (PARTITION BY cloud_id ORDER BY ln((CAST({DRAW} AS DOUBLE) + 0.5::DOUBLE) / 4294967296.0::DOUBLE) / CASE WHEN {NEAR} THEN {WEIGHT}::DOUBLE ELSE 1.0::DOUBLE END DESC, idx) <= 20")
BUCKET = f"u AS (SELECT cloud_id, idx, count(*) OVER (PARTITION BY cloud_id) AS n, row_number() OVER (PARTITION BY cloud_id ORDER BY {DRAW}, idx) - 1 AS place FROM p)"
BUCKETS = "CASE WHEN place < n * 50 // 100 THEN 0 WHEN place < n * 80 // 100 THEN 1 ELSE 2 END"
add("partition_pct", "points_li", f"SELECT cloud_id, idx, {BUCKETS} AS bucket FROM u", BUCKET)
add("partition_pick", "points_li", f"SELECT cloud_id, idx FROM u WHERE {BUCKETS} = 2", BUCKET)
GRID = ", ".join(f"CAST(least(CASE WHEN max_{c} > min_{c} THEN floor((CAST({c} AS DOUBLE) - min_{c}) / (CAST(max_{c} AS DOUBLE) - min_{c}) * {float(n)}::DOUBLE) ELSE 0 END, {n - 1}) AS INTEGER) AS chunk_{c}" for c, n in zip(XYZ, (4, 3, 2), strict=True))
add("grid_chunks", "points_li", f"SELECT cloud_id, idx, {GRID} FROM p JOIN b USING (cloud_id)", BOUNDS)
add("tile_chunks", "points_li", "SELECT cloud_id, idx, " + each("CAST(floor((CAST(% AS DOUBLE) - CAST(min_% AS DOUBLE)) / 7.5::DOUBLE) AS INTEGER) AS chunk_%") + " FROM p JOIN b USING (cloud_id)", BOUNDS)
ROI = " ".join("WHEN " + " AND ".join(f"CAST({c} AS DOUBLE) BETWEEN {b[j]}::DOUBLE AND {b[j + 3]}::DOUBLE" for j, c in enumerate(XYZ)) + f" THEN {i}" for i, b in enumerate(BOXES))
add("roi_chunks", "points_li", f"SELECT cloud_id, idx, CASE {ROI} ELSE -1 END AS chunk FROM p")
COV = ", ".join(f"round(covar_pop({a}, {b}), 8) AS c{a}{b}" for a, b in (("x", "x"), ("x", "y"), ("x", "z"), ("y", "y"), ("y", "z"), ("z", "z")))
add("knn_covariance", "points_emb", f"SELECT cloud_id, idx, {COV} FROM near GROUP BY ALL", f"near AS (SELECT p.cloud_id, p.idx, {each('CAST(r.% AS DOUBLE) AS %')} FROM p JOIN p r ON p.cloud_id = r.cloud_id QUALIFY row_number() OVER (PARTITION BY p.cloud_id, p.idx ORDER BY {d2('p', 'r')}, r.idx) <= 8)")
NORMAL = "nl AS (SELECT cloud_id, idx, " + ", ".join(f"CASE WHEN len > 0 THEN n{c} / len ELSE n{c} END AS n{c}" for c in XYZ) + " FROM (SELECT *, sqrt(nx * nx + ny * ny + nz * nz) AS len FROM (SELECT cloud_id, idx, " + ", ".join(f"CAST({c} AS DOUBLE) - 127.5::DOUBLE AS n{n}" for n, c in zip(XYZ, RGB, strict=True)) + " FROM p)))"
PLANE = "pl AS (SELECT f.cloud_id, f.idx, abs(" + " + ".join(f"(CAST(t.{c} AS DOUBLE) - CAST(p.{c} AS DOUBLE)) * n{c}" for c in XYZ) + ") AS dist FROM f JOIN t ON f.cloud_id = t.cloud_id AND f.idx = t.idx JOIN p ON f.cloud_id = p.cloud_id AND f.ref_idx = p.idx JOIN nl ON nl.cloud_id = f.cloud_id AND nl.idx = f.ref_idx)"
add("d2_given_normals", "points_emb", f"SELECT cloud_id, {shown('d2_rmse', 'd2_median', 'd2_p95')} FROM e JOIN r USING (cloud_id)", *PAIR, FORWARD, NORMAL, PLANE, *distances("pl", "d2"))
add("flatten_points", "points_emb", f"SELECT cloud_id, flatten(list([{', '.join(XYZ)}] ORDER BY idx)) AS pos, flatten(list([{', '.join(RGB)}] ORDER BY idx)) AS color FROM p GROUP BY cloud_id")
add("unflatten_points", "points_emb", "SELECT cloud_id, row_number() OVER (PARTITION BY cloud_id ORDER BY idx) - 1 AS idx, x, y, z, r, g, b FROM p")
add("rgb_pack", "points_ev", "SELECT cloud_id, idx, (CAST(r AS BIGINT) << 16) | (g << 8) | b AS packed, r, g, b FROM p")
_names = ", ".join(f"('{'+'.join(chain(p))}', '{chain(p)[0]}')" for p in CHAINS.values())
add("magic_sniff", "points_emb", f"SELECT cloud_id, chain, format FROM (SELECT DISTINCT cloud_id FROM p), (VALUES {_names}) v(chain, format)")
PLY_HEAD = len("\n".join([*HEADER[0].replace("ascii", "binary_little_endian").split("\n")[:2], "element vertex "])) + len(HEADER[1])
_sizes = [("ply", f"{PLY_HEAD} + length(CAST(n AS VARCHAR)) + 15 * n"), ("gsp16", "16 + 16 * n"), ("qnt_p11c8", "40 + (n * 57 + 7) // 8"), ("qnt_p16c8", "40 + 9 * n"), ("sogp_p16", "46 + 9 * n")]
add("payload_sizes", "points_ev", " UNION ALL ".join(f"SELECT '{c}' AS codec, cloud_id, n AS n_points, {e} AS bytes, round(8.0::DOUBLE * ({e}) / greatest(n, 1), 6) AS bpp FROM c" for c, e in _sizes), "c AS (SELECT cloud_id, count(*) AS n FROM p GROUP BY cloud_id)")
_lines = "printf('%.3f %.3f %.3f %d %d %d', CAST(x AS DOUBLE), CAST(y AS DOUBLE), CAST(z AS DOUBLE), r, g, b) || chr(10)"
_head = HEADER[0].replace("\n", "' || chr(10) || '")
_tail = HEADER[1].replace("\n", "' || chr(10) || '")
add("ply_ascii_payload", "points_ev", f"SELECT cloud_id, '{_head}element vertex ' || count(*) || '{_tail}' || string_agg({_lines}, '' ORDER BY idx) AS text FROM p GROUP BY cloud_id")


def hex_text(text: str) -> str:
    return f"hex(encode('{text}'))".replace("\n", "' || chr(10) || '")


def le32(v: str) -> str:
    """Little-endian hex of an unsigned 32-bit number."""
    return " || ".join(f"printf('%02X', ({v} >> {s}) & 255)" for s in (0, 8, 16, 24))


def float_bits(v: str) -> str:
    """The bits of a 32-bit float as a number."""
    return f"(CAST(CAST(CAST({v} AS FLOAT) AS BIT) AS INTEGER)::BIGINT & 4294967295)"


def le16(v: str) -> str:
    return " || ".join(f"printf('%02X', ({v} >> {s}) & 255)" for s in (0, 8))


_binary = HEADER[0].replace("ascii", "binary_little_endian")
_row = " || ".join([*(le32(float_bits(c)) for c in XYZ), *(f"printf('%02X', {c})" for c in RGB)])
add("ply_binary_payload", "points_emb", f"SELECT cloud_id, {hex_text(_binary)} || hex(encode('element vertex ' || count(*))) || {hex_text(HEADER[1])} || string_agg({_row}, '' ORDER BY idx) AS payload FROM p GROUP BY cloud_id")
_qrow = " || ".join([*(le16(f"q{c}") for c in XYZ), *(f"printf('%02X', q{c})" for c in RGB)])
_qhead = " || ".join([f"'{b'QNT'.hex().upper()}021048' || '04'", le32("any_value(n)"), *(le32(float_bits(f"any_value({m}_{c})")) for m in ("min", "max") for c in XYZ), *(f"printf('%02X', any_value({m}_{c}))" for m in ("min", "max") for c in RGB)])
add("qnt_payload", "points_emb", f"SELECT cloud_id, {_qhead} || string_agg({_qrow}, '' ORDER BY idx) AS payload FROM q GROUP BY cloud_id", BOUNDS, codes(16, 8))
_asked = ", ".join(f"('{s}', '{n}')" for s, n in SPELLINGS.items())
ORACLES["format_names"] = f"WITH known(spelling, format) AS (VALUES {_asked}), asked AS (SELECT upper(spelling) AS asked FROM known UNION ALL VALUES ('Gsplat16'), ('none') UNION ALL SELECT n_name FROM nation) SELECT asked, format FROM asked LEFT JOIN known ON lower(asked) = spelling"


_SHOWN = each("CAST(% AS INTEGER) AS %", RGB)


def _kept(name: str, source: str, view: str = "p", place: str = "idx", *ctes: str, xyz: str = "x, y, z") -> None:
    """Rows of a codec's points: place, positions and colours."""
    splat = ", CAST(a AS INTEGER) AS a" if source == "splats_emb" else ""
    add(f"decode_roundtrip_{name}", source, f"SELECT cloud_id, {place} AS idx, {xyz}, {_SHOWN}{splat} FROM {view}", *ctes)


#: Splats are numbered by vec_id, and decoded ones from 0 on.
_RANK = "row_number() OVER (PARTITION BY cloud_id ORDER BY idx) - 1"
_HALVES = ", ".join(f"{HALF(c)} AS {c}" for c in XYZ)
for _n in ("bitcode", "ply", "ply_ascii", "ply_big_endian", "gzip", "zstd", "lz4"):
    _kept(_n, "points_ev")
for _n in ("splats_bitcode", "splats_ply"):
    _kept(_n, "splats_emb", "p", _RANK)
for _n in ("quantize", "snappy"):
    _kept(_n, "points_ev", "t", "idx", BOUNDS, codes(12, 8), test_cloud(12, 8))
_kept("gsp16", "points_ev", xyz=_HALVES)
_kept("splats_gsp16", "splats_emb", "p", _RANK, xyz=_HALVES)


def _plane_code(c: str) -> str:
    """A 16-bit code of the byte planes: times the span's inverse, and then times the largest code."""
    span, one = f"CAST(max_{c} - min_{c} AS FLOAT)", "CAST(1 AS FLOAT)"
    share = f"CAST(CAST({c} - min_{c} AS FLOAT) * CAST({one} / {span} AS FLOAT) AS FLOAT)"
    whole = f"floor(CAST(CAST({share} * CAST(65535 AS FLOAT) AS FLOAT) + CAST(0.5 AS FLOAT) AS FLOAT))"
    return f"CASE WHEN {span} > CAST(1.1920928955078125e-07 AS FLOAT) THEN greatest(0, least(65535, CAST({whole} AS BIGINT))) ELSE 0 END AS q{c}"


_PLANES = f"q AS (SELECT p.*, b.* EXCLUDE (cloud_id), {', '.join(map(_plane_code, XYZ))}, r AS qr, g AS qg, b AS qb FROM p JOIN b USING (cloud_id))".replace("b AS qb", "p.b AS qb")
_MORTON = f"z AS (SELECT q.cloud_id, q.idx, t.x, t.y, t.z, q.r, q.g, q.b, {MORTON} AS morton FROM q JOIN t USING (cloud_id, idx))"
_kept("sogp", "points_ev", "z", "row_number() OVER (PARTITION BY cloud_id ORDER BY morton, idx) - 1", BOUNDS, _PLANES, test_cloud(16, 8), _MORTON)
_ENTRIES = ENTRIES.replace(f"entry < {CAP}", "entry < 16")
_colours = ", ".join(f"CASE WHEN (b.n * 40 + 7) // 8 + 2 + 48 + 256 < (b.n * 60 + 7) // 8 THEN e.p{c} ELSE s.{c} END AS {c}" for c in RGB)
_PAINTED = f"w AS (SELECT s.cloud_id, s.idx, s.x, s.y, s.z, {_colours} FROM t s JOIN b USING (cloud_id) JOIN p ON p.cloud_id = s.cloud_id AND p.idx = s.idx JOIN all_bins a ON p.cloud_id = a.cloud_id AND {OWN_BIN} = a.bin JOIN e ON e.cloud_id = a.cloud_id AND e.entry = a.entry)"
_kept("quantize_palette", "points_ev", "w", "idx", BOUNDS, codes(12, 8), test_cloud(12, 8), HIST, _ENTRIES, *PALETTE, _PAINTED)

_v = "CASE WHEN idx % 7 = 0 THEN 0 ELSE CAST(scale_x AS DOUBLE) - 0.5::DOUBLE END"
add("splat_from_shares", "splats_emb", f"SELECT cloud_id, idx, {BYTE(_v)} AS byte, r, g, b, a FROM p")
ORACLES["array_chunks"] = "SELECT vec_id, CAST(len(embedding) // 4 AS INTEGER) AS n, place AS at, embedding[4 * place + 1] AS head, embedding[4 * place + 4] AS tail FROM (SELECT vec_id, embedding, unnest(range(len(embedding) // 4)) AS place FROM embeddings)"
_props = ", ".join(f"({i}, '{n}', '{t}')" for i, (n, t) in enumerate([("x", "f4"), ("y", "f4"), ("z", "f4"), ("red", "u1"), ("green", "u1"), ("blue", "u1")]))
add("ply_header", "points_ev", f"SELECT cloud_id, 'vertex' AS element, count(*) AS size, ordinal, property, type FROM p, (VALUES {_props}) v(ordinal, property, type) GROUP BY ALL")
add("decode_lateral", "points_emb", "SELECT cloud_id, row_number() OVER (PARTITION BY cloud_id ORDER BY idx) - 1 AS idx, x, y, z, r, g, b FROM p")
_labels = ", ".join(f"('{n}', '{'+'.join(chain(p)).lower()}', {len(chain(p)) > 1}, {chain(p)[-1] in ('PLY', 'Bitcode', 'GSP16')})" for n, p in CHAINS.items())
ORACLES["codec_labels"] = f"SELECT * FROM (VALUES {_labels}) v(label, shown, wrapper, splats)"
