"""Session construction and the few session-level settings the jobs rely on."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid
import zipfile
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import SparkSession

# Settings every job assumes. AQE re-plans joins/partition counts at runtime and
# splits skewed shuffle partitions (a single search or source may hold a third of
# all rows); UTC keeps timestamps comparable with the SQL oracle.
_RUNTIME_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.session.timeZone": "UTC",
    # Arrow batches feed the Python steps (HTML container splitter, stream state);
    # pages can be large, so keep a batch to a few hundred rows.
    "spark.sql.execution.arrow.maxRecordsPerBatch": "512",
}


def build_session(master: str | None = None, app: str = "pricelens",
                  shuffle_partitions: int | None = None) -> SparkSession:
    """Create (or reuse) a session. On a cluster pass ``master=None`` and let
    spark-submit decide; locally tests use ``local[*]`` with few partitions."""
    b = SparkSession.builder.appName(app)
    if master:
        b = b.master(master)
    for k, v in _RUNTIME_CONF.items():
        b = b.config(k, v)
    if shuffle_partitions:
        b = b.config("spark.sql.shuffle.partitions", str(shuffle_partitions))
    b = (b.config("spark.sql.execution.arrow.pyspark.enabled", "true")
          .config("spark.ui.enabled", "false")
          .config("spark.ui.showConsoleProgress", "false")
          .config("spark.driver.memory", os.environ.get("PRICELENS_DRIVER_MEM", "16g")))
    spark = b.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    prepare(spark)
    return spark


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session (the driver hands us one)
    and make the package importable by Python workers."""
    for k, v in _RUNTIME_CONF.items():
        try:
            spark.conf.set(k, v)
        except Exception:  # static or locked conf on some deployments
            pass
    ship_package(spark)
    return spark


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Zip this package once per application and ``addPyFile`` it, so executors can
    import the functions used by ``mapInPandas`` / ``applyInPandasWithState``
    (on a cluster, passing the same zip with ``--py-files`` is equivalent)."""
    try:
        sc = spark.sparkContext
        app = sc.applicationId
    except Exception:  # no driver-side context (e.g. a remote session): ship with --py-files instead
        return
    if app in _SHIPPED:
        return
    pkg = os.path.dirname(os.path.abspath(__file__))
    out = os.path.join(tempfile.mkdtemp(prefix="pricelens-pkg-"), "pricelens.zip")
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for root, _dirs, files in os.walk(pkg):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(root, f)
                    z.write(full, os.path.relpath(full, os.path.dirname(pkg)))
    sc.addPyFile(out)
    _SHIPPED.add(app)


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder used to cut lineage and to stage stream inputs.

    On a cluster ``spark.checkpoint.dir`` names a shared (distributed) folder and
    is used as is. Only a ``local[...]`` session without it (tests, benches) gets a
    private folder; elsewhere a machine-local folder would lose data, so that is an error.
    """
    sc = spark.sparkContext
    cur = sc.getCheckpointDir()
    if cur:
        return cur
    d = sc.getConf().get("spark.checkpoint.dir", None)
    if not d:
        try:
            d = spark.conf.get("spark.checkpoint.dir", None)
        except Exception:
            d = None
    if not d:
        if not sc.master.startswith("local") or sc.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        d = tempfile.mkdtemp(prefix="pricelens-ckpt-")
    sc.setCheckpointDir(d)
    return sc.getCheckpointDir() or d


_REMOVE_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


@contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """What is run inside leaves no shuffle files behind, as they would stay beside those of the next step."""
    before = spark.conf.get(_REMOVE_SHUFFLES, None)
    spark.conf.set(_REMOVE_SHUFFLES, "true")
    try:
        yield
    finally:
        if before is None:
            spark.conf.unset(_REMOVE_SHUFFLES)
        else:
            spark.conf.set(_REMOVE_SHUFFLES, before)


_SCRATCH: list[str] = []


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new place in the shared folder for a table that a job writes and reads again. It is
    removed when the driver's Python ends, or by ``drop_scratch``."""
    path = f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _SCRATCH.append(path)
    return path


@atexit.register
def drop_scratch() -> None:
    """Remove the scratch tables of this process; results not yet read from them are lost."""
    from pyarrow import fs as pafs
    while _SCRATCH:
        path = _SCRATCH.pop()
        try:
            fs, name = pafs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")
            if fs.get_file_info(name).type == pafs.FileType.Directory:
                fs.delete_dir(name)
        except Exception:  # noqa: BLE001  a store that is gone with the session: its owner clears the folder
            pass
