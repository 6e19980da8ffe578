"""Registered queries of the core: each operator on clouds from the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import params as P
from ..functions import colour, quant, splat
from ..operators import bounds, chunking, codes, neighbours, palette, quality, sampling
from ..sources import payloads
from ..sources.ply import header_text
from .clouds import points_emb, points_ev, points_li, splats_emb, table
from .sweep import bits_per_point, summary

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}

#: Settings that queries and oracles share.
POSITION_BITS, COLOUR_BITS, CAP = 11, 5, 16
CENTRES, RADIUS, WEIGHT = [(0.1, 0.0, 0.0), (-0.1, 0.1, 0.0)], 0.15, 4.0
BOXES = [(0.0, 0.0, 0.0, 20.0, 30.0, 5.0), (10.0, 10.0, 2.0, 50.0, 60.0, 10.0)]


def query(f: Query) -> Query:
    QUERIES[f.__name__] = f
    return f


def r9(c: str | Column, digits: int = 9) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, digits)


@query
def cloud_bounds(spark, d):
    return bounds.position_bounds(points_li(spark, d))


@query
def color_bounds(spark, d):
    return bounds.colour_bounds(points_li(spark, d)).select("cloud_id", *(F.col(f"{m}_{c}").cast("int").alias(f"{m}_{c}") for m in ("min", "max") for c in "rgb"))


@query
def splat_bounds(spark, d):
    return bounds.splat_bounds(splats_emb(spark, d))


@query
def qnt_positions(spark, d):
    return codes.quantise_positions(points_li(spark, d), 12).select("cloud_id", "idx", "qx", "qy", "qz")


@query
def qnt_colors(spark, d):
    return codes.quantise_colours(points_li(spark, d), COLOUR_BITS).select("cloud_id", "idx", "qr", "qg", "qb")


@query
def qnt_roundtrip(spark, d):
    return codes.round_trip(points_li(spark, d), POSITION_BITS, COLOUR_BITS)


@query
def storage_bits(spark, d):
    n = points_ev(spark, d).groupBy("cloud_id").agg(F.countDistinct("r").cast("int").alias("n"))
    index = quant.index_bits(F.col("n"))
    return n.select("cloud_id", "n", index.cast("int").alias("index_bits"), quant.storage_bits(index, False).cast("int").alias("wide_bits"))


@query
def delta_encode(spark, d):
    q = codes.quantise_positions(points_li(spark, d), 12)
    return codes.delta_encode(q, ["qx", "qy", "qz"], 12).select("cloud_id", "idx", "delta_qx", "delta_qy", "delta_qz")


@query
def delta_roundtrip(spark, d):
    q = codes.quantise_positions(points_li(spark, d), 12)
    back = codes.delta_decode(codes.delta_encode(q, ["qx", "qy", "qz"], 12), ["qx", "qy", "qz"], 12)
    return back.select("cloud_id", "idx", *(F.col(f"sum_{c}").alias(c) for c in ("qx", "qy", "qz")))


def _pair(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    ref = points_emb(spark, d)
    return codes.round_trip(ref, POSITION_BITS, COLOUR_BITS), ref


@query
def nn_join(spark, d):
    test, ref = _pair(spark, d)
    return quality.matches(test, ref).select("cloud_id", "idx", "ref_idx", r9("dist").alias("dist"))


@query
def knn_join(spark, d):
    ref = points_emb(spark, d)
    return neighbours.nearest(ref, ref, 4).select("cloud_id", "idx", F.col("rank").cast("int").alias("rank"), "ref_idx", r9("d2").alias("d2"))


@query
def axis_ties(spark, d):
    return neighbours.axis_ties(points_li(spark, d)).withColumn("bucket", neighbours.bucket_size(F.col("max_ties")))


@query
def d1_metrics(spark, d):
    out = quality.distance_metrics(quality.matches(*_pair(spark, d)))
    return out.select("cloud_id", *(r9(c).alias(c) for c in ("d1_rmse", "d1_median", "d1_p95")))


@query
def d1_symmetric(spark, d):
    out = quality.distance_metrics(quality.positional_symmetric(*_pair(spark, d)))
    return out.select("cloud_id", *(r9(c).alias(c) for c in ("d1_rmse", "d1_median", "d1_p95")))


@query
def d1_chamfer(spark, d):
    return quality.chamfer(*_pair(spark, d)).select("cloud_id", r9("mean_distance").alias("mean_distance"), r9("hausdorff").alias("hausdorff"))


@query
def outlier_abs(spark, d):
    return quality.outliers_beyond(quality.matches(*_pair(spark, d)), 0.0002).select("cloud_id", r9("outlier_ratio").alias("outlier_ratio"))


@query
def outlier_mad3(spark, d):
    return quality.outliers_mad3(quality.positional_symmetric(*_pair(spark, d))).select("cloud_id", r9("outlier_ratio").alias("outlier_ratio"))


@query
def ycbcr(spark, d):
    y = colour.ycbcr(F.col("r"), F.col("g"), F.col("b"))
    return points_ev(spark, d).select("cloud_id", "idx", *(r9(c).alias(n) for c, n in zip(y, ("y", "cb", "cr"), strict=True)))


@query
def color_psnr(spark, d):
    out = quality.colour_metrics(*_pair(spark, d))
    return out.select("cloud_id", *(r9(f"{n}_{m}", 6).alias(f"{n}_{m}") for n in ("y", "cb", "cr") for m in ("mse", "psnr")))


@query
def sweep_quality(spark, d):
    """One sweep of the benchmark in full: quantise, match both ways, distances, outliers, colours and size."""
    test, ref = _pair(spark, d)
    pairs = quality.matches(test, ref).persist()
    distances = quality.positional_symmetric(test, ref, pairs).persist()
    counts = ref.groupBy("cloud_id").agg(F.count("*").alias("n"))
    size = F.lit(40) + F.floor((F.col("n") * (3 * POSITION_BITS + 3 * COLOUR_BITS) + 7) / 8)
    out = counts.join(quality.distance_metrics(distances), "cloud_id").join(quality.outliers_mad3(distances), "cloud_id").join(quality.colour_metrics(test, ref, pairs), "cloud_id")
    shown = [r9(c, 6).alias(c) for c in ("d1_rmse", "d1_median", "d1_p95", "outlier_ratio", "y_psnr", "cb_psnr", "cr_psnr")]
    return out.select("cloud_id", "n", r9(bits_per_point(size, F.col("n")), 6).alias("bpp"), *shown)


@query
def sweep_summary(spark, d):
    """Upper medians of derived sizes and errors by position bits."""
    ref = points_li(spark, d)
    parts = []
    for b in (8, 11, 16):
        q = codes.dequantise_positions(codes.quantise_positions(ref, b), b)
        off = sum(((F.col(f"d{c}").cast("double") - F.col(c).cast("double")) * (F.col(f"d{c}").cast("double") - F.col(c).cast("double")) for c in "xyz"), F.lit(0.0))
        part = q.groupBy("cloud_id").agg(F.count("*").alias("n"), F.sqrt(F.avg(off)).alias("rmse"))
        parts.append(part.select(F.lit(f"p{b}").alias("sweep_name"), bits_per_point(F.lit(40) + F.floor((F.col("n") * (3 * b + 24) + 7) / 8), F.col("n")).alias("bpp"), "rmse"))
    out = summary(parts[0].union(parts[1]).union(parts[2]), columns=("bpp", "rmse"))
    return out.select("sweep_name", "n", r9("bpp_median", 6).alias("bpp_median"), r9("rmse_median", 6).alias("rmse_median"))


@query
def palette_hist(spark, d):
    return palette.histogram(points_li(spark, d), CAP)


@query
def palette_topk(spark, d):
    return palette.entries(points_li(spark, d), CAP).select("cloud_id", F.col("entry").cast("int").alias("entry"), "bin", "n", "pr", "pg", "pb")


@query
def palette_assign(spark, d):
    return palette.assign(points_li(spark, d), CAP).select("cloud_id", "idx", F.col("entry").cast("int").alias("entry"))


@query
def palette_estimate(spark, d):
    return palette.estimate(points_li(spark, d), 12, 8, 256).select("cloud_id", "n", "plain", "indexed", "wins")


@query
def morton_order(spark, d):
    return codes.morton_order(points_li(spark, d)).select("cloud_id", "idx", "morton", F.col("rank").cast("long").alias("rank"))


@query
def sogp_planes(spark, d):
    return codes.planes(points_li(spark, d), 16).select("cloud_id", "idx", *(f"{p}_{c}" for p in ("lo", "hi") for c in "xyz"))


@query
def sogp_roundtrip(spark, d):
    q = codes.dequantise_positions(codes.quantise_positions(points_li(spark, d), 16), 16)
    return q.select("cloud_id", "idx", "dx", "dy", "dz")


@query
def splat_ply_fields(spark, d):
    s = splats_emb(spark, d)
    return s.select(
        "cloud_id", "idx", *(r9(splat.to_dc(F.col(c))).alias(f"f_dc_{i}") for i, c in enumerate("rgb")), r9(splat.to_logit(F.col("a"))).alias("opacity"),
        *(r9(splat.log_scale(F.col(f"scale_{c}"))).alias(f"log_{c}") for c in "xyz"), *(r9(splat.finite_or(F.col(f"rot_{c}"), 1.0 if c == "w" else 0.0)).alias(f"q{c}") for c in "wxyz"),
    )


@query
def splat_ply_roundtrip(spark, d):
    s = splats_emb(spark, d)
    return s.select(
        "cloud_id", "idx", *(splat.from_dc(splat.to_dc(F.col(c))).cast("int").alias(c) for c in "rgb"), splat.from_logit(splat.to_logit(F.col("a"))).cast("int").alias("a"),
        *(r9(F.exp(splat.log_scale(F.col(f"scale_{c}"))), 6).alias(f"scale_{c}") for c in "xyz"),
    )


@query
def gsp_scale_codes(spark, d):
    s = splats_emb(spark, d)
    code = {c: splat.scale_code(F.col(f"scale_{c}")) for c in "xyz"}
    return s.select("cloud_id", "idx", *(v.cast("int").alias(f"s{c}") for c, v in code.items()), *(r9(splat.scale_value(v), 6).alias(f"v{c}") for c, v in code.items()))


@query
def gsp_rotation_codes(spark, d):
    s = splats_emb(spark, d)
    u, v, angle = splat.rotation_codes(*(F.col(f"rot_{c}") for c in "wxyz"))
    coded = s.select("cloud_id", "idx", u.alias("u"), v.alias("v"), angle.alias("angle"))
    back = splat.rotation_values(F.col("u"), F.col("v"), F.col("angle"))
    return coded.select("cloud_id", "idx", "u", "v", "angle", *(r9(c, 6).alias(f"q{n}") for c, n in zip(back, "wxyz", strict=True)))


@query
def splat_normalised(spark, d):
    s = splats_emb(spark, d)
    q = splat.normalised(*(F.col(f"rot_{c}") for c in "wxyz"))
    shares = [(F.col(c).cast("double") / F.lit(255.0)).alias(f"share_{c}") for c in "rgba"]
    return s.select("cloud_id", "idx", *(r9(c).alias(f"q{n}") for c, n in zip(q, "wxyz", strict=True)), *(r9(c).alias(f"share_{n}") for c, n in zip(shares, "rgba", strict=True)))


@query
def splat_from_shares(spark, d):
    """Colour shares of splats back to bytes, out-of-range and non-finite ones included."""
    s = splats_emb(spark, d)
    v = F.col("scale_x").cast("double") - F.lit(0.5)
    v = F.when(F.col("idx") % 7 == 0, F.lit(float("nan"))).otherwise(v)
    return s.select("cloud_id", "idx", splat.unit_to_u8(v).cast("int").alias("byte"), *(splat.unit_to_u8(F.col(c).cast("double") / F.lit(255.0)).cast("int").alias(c) for c in "rgba"))


@query
def array_chunks(spark, d):
    """Flat arrays as rows of four."""
    e = table(spark, d, "embeddings").select("vec_id", payloads.chunks("embedding", 4).alias("parts"))
    return e.select("vec_id", F.size("parts").alias("n"), F.posexplode("parts").alias("at", "part")).select("vec_id", "n", F.col("at").cast("long").alias("at"), F.element_at("part", 1).alias("head"), F.element_at("part", -1).alias("tail"))


@query
def ply_header(spark, d):
    coded = payloads.encode(points_ev(spark, d), P.Ply("Ascii", ascii_float_mode=3))
    return payloads.ply_headers(coded).select("cloud_id", "element", "size", "ordinal", "property", "type")


@query
def decode_lateral(spark, d):
    """The table function in SQL."""
    payloads.register(spark)
    payloads.encode(points_emb(spark, d), P.Bitcode()).createOrReplaceTempView("coded_clouds")
    return spark.sql("SELECT cloud_id, p.idx, p.x, p.y, p.z, p.r, p.g, p.b FROM coded_clouds, LATERAL decode_payload(payload) p")


@query
def codec_labels(spark, d):
    rows = [(name, P.chain(p), P.is_wrapper(p), P.holds(p, "splats")) for name, p in CHAINS.items()]
    known = spark.createDataFrame(rows, "label string, chain array<string>, wrapper boolean, splats boolean")
    return known.select("label", F.lower(F.array_join("chain", "+")).alias("shown"), "wrapper", "splats")


@query
def gsp_words(spark, d):
    """The four words of every 16-byte record."""
    s = splats_emb(spark, d)
    u, v, angle = splat.rotation_codes(*(F.col(f"rot_{c}") for c in "wxyz"))
    w = splat.words(*(F.col(c) for c in "rgba"), *(splat.half_bits(F.col(c)) for c in "xyz"), u, v, angle, *(splat.scale_code(F.col(f"scale_{c}")) for c in "xyz"))
    return s.select("cloud_id", "idx", *(x.alias(f"w{i}") for i, x in enumerate(w)))


@query
def sample_rate(spark, d):
    return sampling.by_rate(points_li(spark, d), 0.1).select("cloud_id", "idx")


@query
def sample_count(spark, d):
    return sampling.by_count(points_li(spark, d), 100).select("cloud_id", "idx")


@query
def sample_biased(spark, d):
    return sampling.by_interest(points_emb(spark, d), 20, CENTRES, RADIUS, WEIGHT).select("cloud_id", "idx")


@query
def partition_pct(spark, d):
    return sampling.by_percentages(points_li(spark, d), [50, 30, 20]).select("cloud_id", "idx", F.col("bucket").cast("int").alias("bucket"))


@query
def partition_pick(spark, d):
    return sampling.partition(points_li(spark, d), [50, 30, 20], 5).select("cloud_id", "idx")


@query
def grid_chunks(spark, d):
    return chunking.grid(points_li(spark, d), 4, 3, 2).select("cloud_id", "idx", "chunk_x", "chunk_y", "chunk_z")


@query
def tile_chunks(spark, d):
    return chunking.tiles(points_li(spark, d), 7.5).select("cloud_id", "idx", "chunk_x", "chunk_y", "chunk_z")


@query
def roi_chunks(spark, d):
    return chunking.regions(points_li(spark, d), BOXES).select("cloud_id", "idx", "chunk")


@query
def knn_covariance(spark, d):
    out = quality.covariances(points_emb(spark, d), 8)
    return out.select("cloud_id", "idx", *(r9(f"c{a}", 8).alias(f"c{a}") for a in ("xx", "xy", "xz", "yy", "yz", "zz")))


@query
def d2_given_normals(spark, d):
    test, ref = _pair(spark, d)
    normals = quality.unit_normals(ref.select("cloud_id", "idx", *((F.col(c).cast("double") - F.lit(127.5)).alias(n) for c, n in zip("rgb", ("nx", "ny", "nz"), strict=True))))
    out = quality.distance_metrics(quality.point_to_plane(test, ref, normals), "d2")
    return out.select("cloud_id", *(r9(c).alias(c) for c in ("d2_rmse", "d2_median", "d2_p95")))


@query
def d2_pca(spark, d):
    test, ref = _pair(spark, d)
    out = quality.distance_metrics(quality.point_to_plane(test, ref, quality.pca_normals(ref)), "d2")
    return out.select("cloud_id", *(r9(c, 6).alias(c) for c in ("d2_rmse", "d2_median", "d2_p95")))


@query
def flatten_points(spark, d):
    return payloads.flatten(points_emb(spark, d)).select("cloud_id", "pos", F.transform("color", lambda c: c.cast("int")).alias("color"))


@query
def unflatten_points(spark, d):
    return payloads.unflatten(payloads.flatten(points_emb(spark, d))).select("cloud_id", "idx", "x", "y", "z", *(F.col(c).cast("int").alias(c) for c in "rgb"))


@query
def rgb_pack(spark, d):
    packed = points_ev(spark, d).withColumn("packed", colour.pack_rgb(F.col("r"), F.col("g"), F.col("b")))
    back = colour.unpack_rgb(F.col("packed"))
    return packed.select("cloud_id", "idx", "packed", *(c.alias(n) for c, n in zip(back, "rgb", strict=True)))


CHAINS = {
    "zstd+ply": P.Zstd(P.Ply(), 3), "ply": P.Ply(), "gzip+bitcode": P.Gzip(), "snappy+gzip+quantize": P.Snappy(P.Gzip(P.Quantize())),
    "lz4+sogp": P.Lz4(P.Sogp(compression="None")), "quantize": P.Quantize(), "gsp16": P.Gsplat16(), "sogp": P.Sogp(compression="None"), "bitcode": P.Bitcode(),
}


@query
def magic_sniff(spark, d):
    points = points_emb(spark, d)
    parts = [payloads.encode(points, p).select("cloud_id", F.array_join("codec_chain", "+").alias("chain"), payloads.format_of(F.col("payload")).alias("format")) for p in CHAINS.values()]
    out = parts[0]
    for part in parts[1:]:
        out = out.union(part)
    return out


@query
def payload_sizes(spark, d):
    """Sizes of the layouts whose size follows from the number of points."""
    points = points_ev(spark, d)
    wanted = {"ply": P.Ply(), "gsp16": P.Gsplat16(wide_positions=True), "qnt_p11c8": P.Quantize(11, 8), "qnt_p16c8": P.Quantize(16, 8), "sogp_p16": P.Sogp(compression="None")}
    out = None
    for name, p in wanted.items():
        part = payloads.encode(points, p).select(F.lit(name).alias("codec"), "cloud_id", "n_points", "bytes", r9(bits_per_point(F.col("bytes"), F.col("n_points")), 6).alias("bpp"))
        out = part if out is None else out.union(part)
    return out


@query
def ply_ascii_payload(spark, d):
    points = points_ev(spark, d)
    return payloads.encode(points, P.Ply("Ascii", ascii_float_mode=3)).select("cloud_id", F.decode("payload", "UTF-8").alias("text"))


@query
def ply_binary_payload(spark, d):
    return payloads.encode(points_emb(spark, d), P.Ply()).select("cloud_id", F.hex("payload").alias("payload"))


@query
def qnt_payload(spark, d):
    return payloads.encode(points_emb(spark, d), P.Quantize(16, 8, pack_positions=False)).select("cloud_id", F.hex("payload").alias("payload"))


@query
def format_names(spark, d):
    """Any spelling to the shown name, over the spellings and the nations' names."""
    known = F.create_map(*(F.lit(x) for pair in P.SPELLINGS.items() for x in pair))
    asked = spark.createDataFrame([(s.upper(),) for s in P.SPELLINGS] + [("Gsplat16",), ("none",)], "asked string").union(table(spark, d, "nation").select("n_name"))
    return asked.select("asked", F.get(F.array(known[F.lower("asked")]), F.lit(0)).alias("format"))


def _round_trips(name: str, params: P.Params, target: str = "points") -> None:
    def run(spark, d):
        source = splats_emb(spark, d) if target == "splats" else points_ev(spark, d)
        back = payloads.decode(payloads.encode(source, params), target)
        return back.select("cloud_id", "idx", "x", "y", "z", *(F.col(c).cast("int").alias(c) for c in ("rgba" if target == "splats" else "rgb")))

    QUERIES[f"decode_roundtrip_{name}"] = run


for _name, _params in [
    ("bitcode", P.Bitcode()), ("ply", P.Ply()), ("ply_ascii", P.Ply("Ascii")), ("ply_big_endian", P.Ply("BinaryBigEndian")), ("quantize", P.Quantize(delta_positions=True)), ("quantize_palette", P.Quantize(max_palette_colors=16)),
    ("sogp", P.Sogp()), ("gsp16", P.Gsplat16(wide_positions=True)), ("gzip", P.Gzip()), ("zstd", P.Zstd(P.Ply(), 3)), ("lz4", P.Lz4()), ("snappy", P.Snappy(P.Gzip(P.Quantize()))),
]:
    _round_trips(_name, _params)
for _name, _params in [("splats_bitcode", P.Bitcode()), ("splats_ply", P.Ply()), ("splats_gsp16", P.Gsplat16())]:
    _round_trips(_name, _params, "splats")

#: Reference text of a header, which the oracle spells in SQL.
HEADER = header_text("Ascii", [("x", "float"), ("y", "float"), ("z", "float"), ("red", "uchar"), ("green", "uchar"), ("blue", "uchar")], 0).split("element vertex 0")
