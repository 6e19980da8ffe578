"""Files of payloads: finding and reading them, and writing results."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Extensions that hold clouds.
EXTENSIONS = ("ply", "pcd", "tmf", "dra", "gzp")


def read_payloads(spark: SparkSession, path: str, extensions: tuple[str, ...] | None = EXTENSIONS, recursive: bool = False) -> DataFrame:
    """(cloud_id, path, payload, bytes) of the files below a path, or of one file; extensions None takes any. Without such files it fails."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower())
    if extensions:
        reader = reader.option("pathGlobFilter", "*.{" + ",".join(extensions) + "}")
    name = F.regexp_replace(F.element_at(F.split("path", "/"), -1), r"\.[^.]*$", "")
    found = reader.load(path)
    if found.select("path").isEmpty():
        raise FileNotFoundError(f"no files with payloads in {path}")
    return found.select(name.alias("cloud_id"), "path", F.col("content").alias("payload"), F.col("length").alias("bytes"))


def write_payloads(payloads: DataFrame, path: str, overwrite: bool = False) -> None:
    """One file per payload, ``<cloud_id>.<outer>+<inner>``, below a path that every task can write to; existing ones are refused unless told."""
    uri = path if "://" in path else f"file://{path}"
    name = F.concat("cloud_id", F.lit("."), F.array_join(F.transform("codec_chain", F.lower), "+"))
    named = payloads.select(name.alias("name"), "payload")
    if not overwrite:
        # looked at once, before any task writes: a task that runs again finds its own files
        import pyarrow.fs as fs

        store, root = fs.FileSystem.from_uri(uri)
        there = {f.base_name for f in store.get_file_info(fs.FileSelector(root, allow_not_found=True))}
        for r in named.select("name").toLocalIterator() if there else ():
            if r.name in there:
                raise FileExistsError(f"FileExistsError: {path}/{r.name}")

    def write(rows) -> None:
        import uuid

        import pyarrow.fs as fs

        store, root = fs.FileSystem.from_uri(uri)
        store.create_dir(root, recursive=True)
        for r in rows:
            # written aside under a name of this attempt's own, and moved: any number of attempts leave one whole file
            part = f"{root}/.{r.name}.{uuid.uuid4().hex}.part"
            with store.open_output_stream(part) as out:
                out.write(bytes(r.payload))
            store.move(part, f"{root}/{r.name}")

    named.foreachPartition(write)


#: The columns of a benchmark result, in order; the second list has six decimals.
OUTCOME = "dataset_id dataset_path sweep_name params_json num_points_ref num_points_dec bytes bpp encode_ns decode_ns encode_ms decode_ms d1_rmse d1_median d1_p95 d2_rmse d2_median d2_p95 n_ang_mean_deg n_ang_p95_deg outlier_ratio y_psnr cb_psnr cr_psnr".split()
SIX = "bpp encode_ms decode_ms d1_rmse d1_median d1_p95 d2_rmse d2_median d2_p95 n_ang_mean_deg n_ang_p95_deg outlier_ratio y_psnr cb_psnr cr_psnr".split()


def write_outcomes(outcomes: DataFrame, path: str) -> None:
    """JSON lines where the path ends in .jsonl, else CSV with six decimals."""
    rows = outcomes.select(*OUTCOME)
    if path.endswith(".jsonl"):
        rows.write.mode("overwrite").json(path)
        return
    shown = lambda c: F.when(F.col(c) == float("inf"), "inf").otherwise(F.format_string("%.6f", c))
    rows.withColumns({c: F.when(F.col(c).isNotNull(), shown(c)) for c in SIX}).write.mode("overwrite").csv(path, header=True, escape='"')
