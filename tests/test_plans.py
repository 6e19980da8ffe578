"""Core queries against DuckDB, and operators on small clouds."""

import sys
from pathlib import Path

import duckdb
import numpy as np
import pytest

from cloudloom import params as P
from cloudloom.operators import chunking, neighbours, palette, quality, sampling
from cloudloom.plans import oracles, queries, sweep, tool
from cloudloom.sources import datasource, files, payloads
from cloudloom.sources.quantised import palette_of

sys.path.insert(0, str(Path(__file__).parents[1]))
SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events embeddings".split()
LIGHT = [n for n in queries.QUERIES if n in oracles.ORACLES]


def shown(v):
    if isinstance(v, float):
        return "nan" if v != v else round(v, 9)
    return tuple(map(shown, v)) if isinstance(v, (list, tuple)) else v


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


@pytest.mark.parametrize("name", LIGHT)
def test_oracle(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    rel = duck.sql(oracles.ORACLES[name])
    names, rows = list(rel.columns), rel.fetchall()
    assert sorted(names) == sorted(df.columns)
    order = sorted(names)
    left = sorted((tuple(shown(r[c]) for c in order) for r in df.collect()), key=str)
    right = sorted((tuple(shown(r[names.index(c)]) for c in order) for r in rows), key=str)
    assert left == right


@pytest.fixture(scope="module")
def far(tmp_path_factory):
    """Events of users whose numbers no half float holds."""
    out = tmp_path_factory.mktemp("far")
    duckdb.sql(f"COPY (SELECT * REPLACE (user_id + [0, 65500, 90000, 3000000][1 + event_id % 4] AS user_id) FROM '{SF}/events.parquet') TO '{out}/events.parquet' (FORMAT parquet)")
    return str(out)


@pytest.mark.parametrize("name", ["decode_roundtrip_gsp16", "payload_sizes"])
def test_oracle_of_far_positions(spark, far, name):
    df = queries.QUERIES[name](spark, far)
    with duckdb.connect() as con:
        con.execute(f"CREATE VIEW events AS SELECT * FROM '{far}/events.parquet'")
        right = con.sql(f"SELECT {', '.join(df.columns)} FROM ({oracles.ORACLES[name]})").fetchall()
    assert sorted(map(tuple, df.collect())) == sorted(right)


@pytest.fixture(scope="module")
def clouds(spark):
    rng = np.random.default_rng(1)
    rows = []
    for name, n in (("a", 300), ("b", 40), ("dup", 50)):
        xyz = rng.normal(size=(n, 3)) if name != "dup" else np.repeat([[1.0, 2.0, 3.0]], n, 0)
        if name == "a":
            xyz[0] = [900, 900, 900]  # an outlier far from all cells
        for i, (p, c) in enumerate(zip(xyz, rng.integers(0, 256, (n, 3)), strict=True)):
            rows.append((name, i, *map(float, p), *map(int, c)))
    return spark.createDataFrame(rows, "cloud_id string, idx long, x float, y float, z float, r smallint, g smallint, b smallint").cache()


@pytest.mark.parametrize("k", [1, 5])
def test_neighbours_are_exact(clouds, k):
    pdf = clouds.toPandas()
    got = neighbours.nearest(clouds, clouds, k).toPandas().sort_values(["cloud_id", "idx", "rank"])
    for name, rows in pdf.groupby("cloud_id"):
        x = rows.sort_values("idx")[["x", "y", "z"]].to_numpy(np.float64)
        d = ((x[:, None] - x[None]) ** 2).sum(-1)
        want = np.argsort(d, axis=1, kind="stable")[:, :k]
        mine = got[got.cloud_id == name]["ref_idx"].to_numpy().reshape(len(x), -1)
        assert (mine == want).all()


def test_neighbours_edge_cases(spark, clouds):
    other = clouds.where("cloud_id = 'b'").limit(3)
    assert neighbours.nearest(clouds.where("cloud_id = 'a'"), other).count() == 0
    found = neighbours.nearest(clouds.where("cloud_id = 'b'"), other, 5)
    assert found.count() == 40 * 3
    bad = spark.createDataFrame([("b", 999, float("nan"), 0.0, 0.0)], "cloud_id string, idx long, x float, y float, z float")
    assert neighbours.nearest(bad, other).count() == 0


def test_palette_agrees_with_bytes(clouds):
    for name in ("a", "b"):
        rows = clouds.where(f"cloud_id = '{name}'").toPandas().sort_values("idx")
        _, _, index = palette_of(rows[["r", "g", "b"]].to_numpy().astype(np.uint8), 8)
        mine = palette.assign(clouds.where(f"cloud_id = '{name}'"), 8).toPandas().sort_values("idx")["entry"]
        assert mine.tolist() == index.tolist()


def test_normals_of_a_plane(spark):
    rng = np.random.default_rng(2)
    rows = [("p", i, float(x), float(y), 0.5) for i, (x, y) in enumerate(rng.random((60, 2)))]
    plane = spark.createDataFrame(rows, "cloud_id string, idx long, x float, y float, z float")
    n = quality.pca_normals(plane, 8).toPandas()
    assert np.allclose(n.nz.abs(), 1, atol=1e-6)
    up = plane.selectExpr("cloud_id", "idx", "x", "y", "cast(z + 0.25 as float) as z")
    off = quality.point_to_plane(up, plane, quality.pca_normals(plane, 8)).toPandas()
    assert np.allclose(off.dist, 0.25, atol=1e-6)


def test_sampling(clouds):
    n = {r["cloud_id"]: r["count"] for r in clouds.groupBy("cloud_id").count().collect()}
    kept = {r["cloud_id"]: r["count"] for r in sampling.by_rate(clouds, 1e-9).groupBy("cloud_id").count().collect()}
    assert kept == dict.fromkeys(n, 1) and sampling.by_rate(clouds, 0.0).count() == 0 and sampling.by_rate(clouds, 1.0).count() == sum(n.values())
    assert {r["cloud_id"]: r["count"] for r in sampling.by_count(clouds, 45).groupBy("cloud_id").count().collect()} == {k: min(v, 45) for k, v in n.items()}
    shares = sampling.by_percentages(clouds, [10, 0, 90])
    assert shares.count() == sum(n.values()) and shares.where("bucket = 1").count() == 0
    with pytest.raises(ValueError):
        sampling.by_percentages(clouds, [50, 60])
    near = sampling.by_interest(clouds, 30, [(0.0, 0.0, 0.0)], 1.0, 1e6).where("cloud_id = 'a'").toPandas()
    assert ((near[["x", "y", "z"]] ** 2).sum(axis=1) <= 1.0001).mean() > 0.9


def test_chunks(clouds):
    cut = tool.choose_chunks(clouds, grid=(2, 2, 2))
    assert cut.count() == clouds.count() and cut.select("cloud_id").distinct().count() > 3
    assert chunking.regions(clouds, [(-1, -1, -1, 1, 1, 1)], keep_rest=False).where("abs(x) > 1").count() == 0
    for bad in ([(0, 0, 0, -1, 1, 1)], [(0, 0, 0)]):
        with pytest.raises(ValueError):
            chunking.regions(clouds, bad)
    with pytest.raises(ValueError):
        chunking.tiles(clouds, 0)
    with pytest.raises(ValueError):
        tool.choose_chunks(clouds, grid=(1, 1, 1), tile=1.0)


def test_flatten_checks(spark, clouds):
    back = payloads.unflatten(payloads.flatten(clouds))
    assert back.exceptAll(clouds.select(back.columns)).count() == 0 and back.count() == clouds.count()
    bad = spark.createDataFrame([("a", [1.0, 2.0], [1, 2])], "cloud_id string, pos array<float>, color array<smallint>")
    with pytest.raises(Exception, match="triples"):
        payloads.unflatten(bad).collect()


def test_files_and_tool(spark, clouds, tmp_path):
    source, target = str(tmp_path / "in"), str(tmp_path / "out")
    files.write_payloads(payloads.encode(clouds, P.Ply()), source)
    with pytest.raises(Exception, match="FileExists"):
        files.write_payloads(payloads.encode(clouds, P.Ply()), source)
    spark.dataSource.register(datasource.PointCloudSource)
    assert spark.read.format("pointcloud").option("path", source).load().count() == clouds.count()
    tool.transcode(spark, source, target, P.Zstd(P.Quantize()), count=20)
    read = files.read_payloads(spark, target, None)
    assert read.count() == 3 and payloads.decode(read).count() == 60
    names = sorted(p.name for p in (tmp_path / "out").iterdir() if p.suffix != ".crc")
    assert names == ["a.zstd+quantize", "b.zstd+quantize", "dup.zstd+quantize"]


CONFIG = """
[datasets]
roots = ["x"]
[datasets.resample]
strategy = "count"
count = 40
[[sweeps]]
name = "exact"
params = { Bitcode = {} }
[[sweeps]]
params = { Gzip = { inner = { Quantize = { position_bits = 11, color_bits = 5 } } } }
[[sweeps]]
name = "absent"
params = { Draco = { method = "KdTree" } }
[metrics]
k_normals = 8
"""


def test_sweep(spark, clouds, tmp_path):
    config = sweep.read_config(CONFIG)
    out = sweep.run(clouds, config).cache()
    rows = {(r.sweep_name, r.dataset_id): r for r in out.collect()}
    assert len(rows) == 9
    exact = rows["exact", "a"]
    assert exact.d1_rmse == 0 and exact.y_psnr == float("inf") and exact.num_points_ref == 40 and exact.error is None
    lossy = rows["gzip+quantize", "a"]
    assert lossy.d1_rmse > 0 and 0 < lossy.y_psnr < 100 and lossy.n_ang_mean_deg is None
    assert "Draco" in rows["absent", "a"].error
    sweep.summary(out.where("error is null")).collect()
    files.write_outcomes(out, str(tmp_path / "rows.csv"))
    files.write_outcomes(out, str(tmp_path / "rows.jsonl"))
    head = spark.read.csv(str(tmp_path / "rows.csv"), header=True)
    assert head.columns == files.OUTCOME and head.count() == 9
    for bad in ("[datasets]\nroots = []\nx = 1\n[[sweeps]]\nparams = 'Ply'\n[metrics]\ny = 1", "z = 1"):
        with pytest.raises((ValueError, KeyError)):
            sweep.read_config(bad)


def test_command_line(spark, clouds, tmp_path):
    from cloudloom.__main__ import main

    files.write_payloads(payloads.encode(clouds, P.Ply()), str(tmp_path / "in"))
    main(["transcode", str(tmp_path / "in"), str(tmp_path / "out"), "--codec", "gzip", "--percentages", "50,50"])
    assert len([p for p in (tmp_path / "out").iterdir() if p.name.endswith(".gzip+bitcode")]) == 6
    (tmp_path / "c.toml").write_text(CONFIG.replace('roots = ["x"]', f'roots = ["{tmp_path / "in"}"]'))
    main(["bench", str(tmp_path / "c.toml"), "--out", str(tmp_path / "o.csv")])
    assert (tmp_path / "o.csv.txt").read_text().count("sweep_name") == 2


def test_palette_compat():
    rgb = np.random.default_rng(4).integers(0, 256, (500, 3)).astype(np.uint8)
    for compat in (False, True):
        entries, _, index = palette_of(rgb, 12, compat)
        assert len(entries) == 12 and index.min() >= 0 and index.max() < 12


def test_streamed_frames(spark, clouds, tmp_path):
    from cloudloom.streaming import frames

    files.write_payloads(payloads.encode(clouds, P.Ply()), str(tmp_path / "in"))
    points = frames.read_points(spark, str(tmp_path / "in"))
    q = points.writeStream.format("memory").queryName("streamed").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert spark.table("streamed").count() == clouds.count()


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).count() == 10
    assert set(e.oracle_sql()) <= set(e.queries())


def test_cells_and_groups_agree(spark):
    """The two ways of finding neighbours: by cells of a grid, and by all pairs of a small cloud."""
    from cloudloom.operators import neighbours

    cloud = spark.range(400).selectExpr("'a' as cloud_id", "id as idx", "cast(hash(id) % 97 / 10 as float) as x", "cast(hash(id, 1) % 13 as float) as y", "cast(0.5 as float) as z")
    for k in (1, 3):
        rows = [sorted(tuple(r) for r in way(cloud.where("idx % 20 = 0"), cloud, k).select("idx", "rank", "ref_idx", "d2").collect()) for way in (neighbours._by_cells, neighbours._in_groups)]
        assert rows[0] == rows[1] and len(rows[0]) == 20 * k
