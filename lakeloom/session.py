"""Session settings and the shared working folder."""

from __future__ import annotations

import atexit
import contextlib
import tempfile
import uuid

from pyspark import SparkContext
from pyspark.sql import SparkSession

# Runtime SQL settings every job relies on. They are safe to set on a session someone else built.
RUNTIME = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    # Splits a skewed join even when an operator above it then needs a shuffle of its own.
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.adaptive.optimizeSkewsInRebalancePartitions.enabled": "true",
}

_local_dirs: dict[str, str] = {}
_working_dirs: set[str] = set()


def partitions_for(shuffle_bytes: int, per_task: int = 128 << 20, least: int = 200) -> int:
    """Shuffle partitions that keep a task's share of `shuffle_bytes` near `per_task`, small enough to sort in memory.
    Too many do no harm, as adaptive execution joins small ones; too few make every task spill."""
    return max(least, -(-shuffle_bytes // per_task))


def build(app: str = "lakeloom", master: str | None = None, packages: tuple[str, ...] = (),
          conf: dict[str, str] | None = None, shuffle_bytes: int | None = None) -> SparkSession:
    """A session with the settings above; `packages` adds optional connectors (JDBC drivers, Kafka, Delta), and
    `shuffle_bytes`, the size of the largest shuffle expected, sets the number of shuffle partitions."""
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    if packages:
        builder = builder.config("spark.jars.packages", ",".join(packages))
    sized = {} if shuffle_bytes is None else {"spark.sql.shuffle.partitions": str(partitions_for(shuffle_bytes))}
    for key, value in {**RUNTIME, **sized, **(conf or {})}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def tune(spark: SparkSession) -> SparkSession:
    """Apply the runtime settings to an existing session, leaving sizes (shuffle partitions, memory) alone."""
    for key, value in RUNTIME.items():
        spark.conf.set(key, value)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors can reach, as the cluster names it in `spark.checkpoint.dir`.

    Only a local session may fall back to a temporary folder; on a cluster a missing setting is an error,
    since a folder of one machine would be lost with that machine.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    context = spark.sparkContext
    if not context.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder shared by all executors")
    if context.applicationId not in _local_dirs:
        _local_dirs[context.applicationId] = tempfile.mkdtemp(prefix="lakeloom-")
    return _local_dirs[context.applicationId]


def fresh_dir(spark: SparkSession, label: str) -> str:
    """A new, unused folder below the shared folder, in one of this application that is removed when the driver ends."""
    own = f"{shared_dir(spark)}/lakeloom/{spark.sparkContext.applicationId}"
    if own not in _working_dirs:
        _working_dirs.add(own)
        atexit.register(_remove, own)
    return f"{own}/{label}-{uuid.uuid4().hex}"


def _remove(path: str) -> None:
    gateway = SparkContext._gateway
    with contextlib.suppress(Exception):  # the JVM may be gone
        folder = gateway.jvm.org.apache.hadoop.fs.Path(path)
        folder.getFileSystem(gateway.jvm.org.apache.hadoop.conf.Configuration()).delete(folder, True)
