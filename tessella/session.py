"""A session with the settings that the engine's plans rely on."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "tessella", master: str | None = None, **conf: str) -> SparkSession:
    """Get or create a session: adaptive execution, UTC, Arrow. Give ``master`` only outside a cluster; ``conf`` keys use ``__`` for dots."""
    builder = SparkSession.builder.appName(name)
    if master:
        builder = builder.master(master)
    fixed = {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true", "spark.sql.session.timeZone": "UTC", "spark.sql.execution.arrow.pyspark.enabled": "true"}
    for k, v in (fixed | {k.replace("__", "."): v for k, v in conf.items()}).items():
        builder = builder.config(k, v)
    return builder.getOrCreate()


def ship(spark: SparkSession) -> None:
    """Give executors this package, once a session: workers import it by name wherever the driver was started."""
    sc = spark.sparkContext
    if getattr(sc, "_tessella_shipped", False):
        return
    import zipfile
    from pathlib import Path

    root = Path(__file__).resolve().parent
    path = Path(sc._temp_dir, "tessella.zip")  # the application's own folder, kept as long as it runs
    with zipfile.ZipFile(path, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    sc.addPyFile(str(path))
    sc._tessella_shipped = True
