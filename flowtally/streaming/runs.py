"""Which query's results a stream's output folder shows.

A stream that starts with a new checkpoint reads its whole source again.  Its
results belong to a new *run* of the output folder and never mix with those of
a query that wrote there before: readers see the last run that was finished,
and older runs are deleted once a newer one is.  A checkpoint remembers its run
and folder, so continuing it needs neither to be named again, and continuing
it after a newer run has taken over is refused.

Everything is kept as marker files in the two folders (any Hadoop file
system); the presence of a file is what counts, so a crash leaves no half
state.
"""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession

from flowtally.session import unique_dir

MARK = "_flowtally_run"  # in a checkpoint: its run and output folder
STARTED, DONE = "_started-", "_done-"  # in an output folder, with the run's number


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def list_names(spark: SparkSession, path: str) -> list[str]:
    """Names in a folder; none if there is no such folder."""
    fs, p = _fs(spark, path)
    return sorted(s.getPath().getName() for s in fs.listStatus(p)) if fs.exists(p) else []


def delete(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def _touch(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.create(p, True).close()


def _numbers(names: list[str], prefix: str) -> list[int]:
    return sorted(int(n[len(prefix) :]) for n in names if n.startswith(prefix))


def _read_mark(spark: SparkSession, checkpoint_dir: str) -> dict | None:
    fs, p = _fs(spark, f"{checkpoint_dir}/{MARK}")
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def _write_mark(spark: SparkSession, checkpoint_dir: str, mark: dict) -> None:
    fs, p = _fs(spark, f"{checkpoint_dir}/{MARK}.tmp")
    stream = fs.create(p, True)
    stream.write(bytearray(json.dumps(mark).encode()))
    stream.close()
    fs.rename(p, _fs(spark, f"{checkpoint_dir}/{MARK}")[1])


def open_run(spark: SparkSession, kind: str, out_dir: str | None, checkpoint_dir: str | None) -> tuple[str, str, int]:
    """``(out_dir, checkpoint_dir, run)`` of a query about to start; missing
    folders are fresh ones under ``spark.checkpoint.dir``.  A checkpoint that
    has been used continues its run."""
    mark = _read_mark(spark, checkpoint_dir) if checkpoint_dir else None
    if mark is not None:
        if out_dir and out_dir.rstrip("/") != mark["out"]:
            raise ValueError(f"checkpoint {checkpoint_dir} belongs to {mark['out']}, not to {out_dir}")
        newest = max(_numbers(list_names(spark, mark["out"]), STARTED), default=0)
        if newest > mark["run"]:
            raise ValueError(f"a newer query (run {newest}) writes to {mark['out']}; run {mark['run']} cannot go on")
        return mark["out"], checkpoint_dir, mark["run"]
    out_dir = (out_dir or unique_dir(spark, f"{kind}-out")).rstrip("/")
    checkpoint_dir = checkpoint_dir or unique_dir(spark, f"{kind}-checkpoint")
    names = list_names(spark, out_dir)
    # A folder with results but without marks was written before runs were kept.
    run = max(_numbers(names, STARTED), default=0 if names else -1) + 1
    _touch(spark, f"{out_dir}/{STARTED}{run}")
    _write_mark(spark, checkpoint_dir, {"out": out_dir, "run": run})
    return out_dir, checkpoint_dir, run


def finish_run(spark: SparkSession, out_dir: str, run: int) -> list[int]:
    """Show ``run`` from now on; the numbers of older runs, to be deleted."""
    _touch(spark, f"{out_dir}/{DONE}{run}")
    names = list_names(spark, out_dir)
    return [n for n in sorted({0, *_numbers(names, STARTED)}) if n < run]


def forget_runs(spark: SparkSession, out_dir: str, runs: list[int]) -> None:
    for n in runs:
        for prefix in (STARTED, DONE):
            delete(spark, f"{out_dir}/{prefix}{n}")


def current_run(spark: SparkSession, out_dir: str) -> int:
    """The run that readers see: the last finished one, else the first."""
    names = list_names(spark, out_dir)
    return max(_numbers(names, DONE), default=min(_numbers(names, STARTED), default=0))


def run_dir(out_dir: str, run: int) -> str:
    """Folder of one run's files, for sinks that append."""
    return f"{out_dir}/run-{run}"


def read_run(spark: SparkSession, out_dir: str, schema: str) -> DataFrame:
    """What the current run has appended (its sink's log says which files are
    whole)."""
    path = run_dir(out_dir, current_run(spark, out_dir))
    if not list_names(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)
