"""Session construction and the shared folder used for written tables.

Everything that must outlive a task (rollups written per category, stream checkpoints,
lineage cuts) goes under the folder the cluster names in ``spark.checkpoint.dir``. A
private folder is only created when that setting is absent (local runs and tests).
"""

from __future__ import annotations

import math
import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings every job relies on. UTC makes day truncation match the reference's
# UTC dates; AQE re-plans joins/aggregations from runtime sizes and splits skewed
# join partitions.
SESSION_DEFAULTS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.ansi.enabled": "true",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # A checkpoint's files go when no plan refers to it any more.
    "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def get_session(
    master: str | None = None,
    shuffle_partitions: int | None = None,
    app_name: str = "funnelworks",
    extra: dict[str, str] | None = None,
) -> SparkSession:
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_DEFAULTS, **(extra or {})}.items():
        builder = builder.config(key, value)
    if shuffle_partitions:
        builder = builder.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    spark = builder.getOrCreate()
    checkpoint_root(spark)
    return spark


def checkpoint_root(spark: SparkSession) -> str:
    """The shared checkpoint folder named by ``spark.checkpoint.dir``.

    Only a local-mode session without that setting (tests, single-machine runs) gets a
    private temporary folder; on a cluster the setting is required.
    """
    try:
        sc = spark.sparkContext
    except Exception:  # noqa: BLE001 - remote sessions have no SparkContext
        sc = None
    if sc is not None and sc.getCheckpointDir():
        return sc.getCheckpointDir()
    configured = spark.conf.get("spark.checkpoint.dir", None)
    if not configured and sc is not None:
        configured = sc.getConf().get("spark.checkpoint.dir", None)
    if not configured:
        master = spark.conf.get("spark.master", None) or (sc.master if sc is not None else "")
        if not str(master).startswith("local"):
            raise ValueError(
                "spark.checkpoint.dir is not set: point it at a folder shared by all "
                "executors (e.g. on the cluster's distributed file system)"
            )
        configured = tempfile.mkdtemp(prefix="funnelworks-ckpt-")
    if sc is None:
        return configured
    sc.setCheckpointDir(configured)
    return sc.getCheckpointDir() or configured


# Folders that ``noting_tables`` keeps track of, innermost last; none are noted outside of it.
_noted: list[list[str]] = []


def shared_path(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint root for one written table."""
    return noted(f"{checkpoint_root(spark).rstrip('/')}/tables/{name}-{uuid.uuid4().hex}")


def noted(path: str) -> str:
    """A folder that goes when the enclosing ``noting_tables`` says so."""
    if _noted:
        _noted[-1].append(path)
    return path


@contextmanager
def noting_tables() -> Iterator[list[str]]:
    """The folders that the enclosed work writes, for ``drop_tables`` once they are not read any more."""
    _noted.append([])
    paths = _noted[-1]
    try:
        yield paths
    finally:
        _noted.pop()


def drop_tables(spark: SparkSession, paths: list[str]) -> None:
    """Delete folders, those that are gone included, and empty the list."""
    while paths:
        place, files = _hadoop(spark, paths.pop())
        files.delete(place, True)


@contextmanager
def dropping_tables(spark: SparkSession) -> Iterator[None]:
    """Delete the tables that the enclosed work wrote to ``shared_path`` folders, at its end.

    For jobs that have stored their result elsewhere by then; a DataFrame that still reads
    one of those tables fails afterwards.
    """
    with noting_tables() as paths:
        try:
            yield
        finally:
            drop_tables(spark, paths)


def _hadoop(spark: SparkSession, path: str) -> tuple:
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    """Whether a path is there, in whatever store it names."""
    place, files = _hadoop(spark, path)
    return bool(files.exists(place))


def read_text(spark: SparkSession, path: str) -> str | None:
    """A small text file's content, or None if there is none, in whatever store it is."""
    place, files = _hadoop(spark, path)
    if not files.exists(place):
        return None
    stream = files.open(place)
    try:
        return bytes(stream.readAllBytes()).decode()
    finally:
        stream.close()


def replace_text(spark: SparkSession, path: str, text: str) -> None:
    """Write a small text file beside its place and rename it there, over an older one."""
    jvm = spark._jvm
    place, files = _hadoop(spark, path)
    fresh = jvm.org.apache.hadoop.fs.Path(f"{path}.{uuid.uuid4().hex}")
    stream = files.create(fresh)
    stream.write(text.encode())
    stream.close()
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(files.getUri(), spark._jsc.hadoopConfiguration())
    overwrite = getattr(jvm, "org.apache.hadoop.fs.Options$Rename").OVERWRITE
    options = spark.sparkContext._gateway.new_array(getattr(jvm, "org.apache.hadoop.fs.Options$Rename"), 1)
    options[0] = overwrite
    context.rename(fresh, place, options)


def drop_others(spark: SparkSession, folder: str, keep: set[str | None]) -> None:
    """Delete the entries of a folder that are not named in ``keep``."""
    place, files = _hadoop(spark, folder)
    for entry in files.listStatus(place):
        if entry.getPath().getName() not in keep:
            files.delete(entry.getPath(), True)


def drop_folder(spark: SparkSession, path: str) -> None:
    """Delete a folder that this library wrote."""
    place, files = _hadoop(spark, path)
    files.delete(place, True)


def list_folder(spark: SparkSession, path: str) -> list[str]:
    """Names of the entries of a folder; none if it is not there."""
    place, files = _hadoop(spark, path)
    return sorted(e.getPath().getName() for e in files.listStatus(place)) if files.exists(place) else []


def scale_settings(
    input_bytes: int,
    total_cores: int,
    partition_bytes: int = 256 << 20,
) -> dict[str, str]:
    """Settings sized to the input for a cluster run (pass them to ``get_session(extra=...)``).

    * scan splits of ``partition_bytes`` so a task's input fits executor memory;
    * initial shuffle partitions so the largest shuffle (at most the input) lands near
      ``partition_bytes`` per reducer, never fewer than two waves of the cores; AQE then
      coalesces small ones toward the advisory size and splits skewed join partitions.
    """
    wanted = math.ceil(max(input_bytes, 1) / partition_bytes)
    shuffle = max(2 * total_cores, wanted)
    size = f"{partition_bytes // (1 << 20)}m"
    return {
        "spark.sql.files.maxPartitionBytes": size,
        "spark.sql.shuffle.partitions": str(shuffle),
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": size,
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": f"{2 * partition_bytes // (1 << 20)}m",
    }


def stored_bytes(spark: SparkSession, path: str) -> int:
    """Bytes under a path in whatever store it names (a listing, no job)."""
    place, files = _hadoop(spark, path)
    return int(files.getContentSummary(place).getLength())


def fit_to_input(spark: SparkSession, path: str) -> dict[str, str]:
    """Apply ``scale_settings`` for the input at ``path``; what the user has set stays.

    All of them are runtime settings. Returns those that were applied.
    """
    sc = spark.sparkContext
    wanted = scale_settings(stored_bytes(spark, path), sc.defaultParallelism)
    given = sc.getConf()
    applied = {k: v for k, v in wanted.items() if not given.contains(k)}
    for k, v in applied.items():
        spark.conf.set(k, v)
    return applied
