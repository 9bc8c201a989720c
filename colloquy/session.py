"""Session helpers: a configured local session for tests / bench and the
shared staging folder taken from ``spark.checkpoint.dir``."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

# Settings that matter for every plan in the package.  AQE re-plans joins
# from runtime sizes, coalesces small shuffle partitions and splits skewed
# ones; ``forceOptimizeSkewedJoin`` lets it split a hot dialogue even when
# that costs one more exchange after the join.
DEFAULT_CONF = {
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.adaptive.forceOptimizeSkewedJoin": "true",
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
    "spark.ui.showConsoleProgress": "false",
}


def local_session(cores: int | str = 8, shuffle_partitions: int = 8, app: str = "colloquy") -> SparkSession:
    """Session for tests and the local bench (never used on a cluster,
    where the launcher owns the session)."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.driver.memory", "16g")
    )
    for k, v in DEFAULT_CONF.items():
        builder = builder.config(k, v)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    ensure_checkpoint_dir(spark)
    return spark


#: Parquet settings for results whose rows hold MBs of text: a page's size is looked at after 4 rows (by
#: default 100, which a task held and compressed at once), and texts that repeat are stored once per file up to
#: 64 MB of them (by default 1 MB, beyond which each row has its own copy).  A first page of fewer rows would
#: show no repeats, and the writer then gives up storing them once.
LONG_TEXTS = {"parquet.page.size.row.check.min": "4", "parquet.dictionary.page.size": str(64 << 20)}
#: For billions of narrow rows that repeat: below one byte a row the writer adds up its buffers after each row
#: (the size of a row rounds to 0).  It now does so every 10,000 rows, and a file's first row group ends at 4 million.
SHORT_ROWS = {"parquet.page.size.row.check.min": str(4 << 20), "parquet.block.row.count.limit": str(4 << 20)}


def writing_session(spark: SparkSession, settings: dict[str, str]) -> SparkSession:
    """A copy of the session (same context, settings and views) that writes
    Parquet with ``settings``, unless the user has set these; ``spark`` itself
    is left as it is.  A DataFrame is written by its session, so build the
    result that needs the settings from this one."""
    own = SparkSession(spark.sparkContext, spark._jsparkSession.cloneSession())
    for k, v in settings.items():
        if own.conf.get(k, None) is None:
            own.conf.set(k, v)
    return own


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """Shared folder for checkpoints and staged tables.

    On a cluster the launcher sets ``spark.checkpoint.dir`` to a folder all
    executors see; it is used as is.  Only when it is unset on a local master
    (tests, local runs) a fresh local folder is created and registered;
    elsewhere that is an error, as executors do not share such a folder."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        path = spark.sparkContext.getCheckpointDir()
    if not path:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        path = tempfile.mkdtemp(prefix="colloquy-ckpt-", dir=os.environ.get("COLLOQUY_TMP", "/tmp"))
        spark.conf.set("spark.checkpoint.dir", path)
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(path)
    return path


def staging_path(spark: SparkSession, name: str) -> str:
    """A fresh sub-folder of the shared checkpoint folder for one staged
    table (never a machine-local temp folder on a cluster)."""
    base = ensure_checkpoint_dir(spark).rstrip("/")
    path = f"{base}/stage-{name}-{uuid.uuid4().hex[:12]}"
    _STAGED.append(path)
    return path


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once as a staged table and read again: for tables that
    several joins or jobs read, and whose size is known afterwards."""
    path = staging_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


_STAGED: list[str] = []


def drop_staged(spark: SparkSession, *paths: str) -> int:
    """Delete the staged tables of this application (or those of them in
    ``paths``), once the results that read them are written; returns their
    number."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    n = 0
    for name in [p for p in _STAGED if not paths or p in paths]:
        _STAGED.remove(name)
        path = jvm.org.apache.hadoop.fs.Path(name)
        n += bool(path.getFileSystem(conf).delete(path, True))
    return n


_SHIPPED: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Make ``colloquy`` importable in the Python workers (needed by the
    operators that run Python inside tasks): the package is zipped once per
    application and added with ``addPyFile``, which distributes it to every
    executor."""
    import zipfile

    sc = spark.sparkContext
    app = sc.applicationId
    if app in _SHIPPED:
        return
    pkg_dir = os.path.dirname(os.path.abspath(__file__))
    root = os.path.dirname(pkg_dir)
    target = os.path.join(tempfile.mkdtemp(prefix="colloquy-pkg-"), "colloquy.zip")
    with zipfile.ZipFile(target, "w", zipfile.ZIP_DEFLATED) as z:
        for d, _, files in os.walk(pkg_dir):
            for f in files:
                if f.endswith(".py"):
                    full = os.path.join(d, f)
                    z.write(full, os.path.relpath(full, root))
    sc.addPyFile(target)
    _SHIPPED.add(app)
