"""Intermediate results written to the shared folder, so that a lost executor costs a re-read, not a re-run."""

from __future__ import annotations

from pyspark.sql import DataFrame

from recloom.session import scratch_path


def stage(df: DataFrame, name: str, codec: str | None = None) -> DataFrame:
    """Write ``df`` once and read it back with the same schema."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path, compression=codec)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def unstage(df: DataFrame) -> None:
    """Remove what ``stage`` wrote for ``df``, once nothing reads it any more."""
    session = df.sparkSession
    for folder in {file.rpartition("/")[0] for file in df.inputFiles()}:
        path = session._jvm.org.apache.hadoop.fs.Path(folder)
        path.getFileSystem(session._jsparkSession.sessionState().newHadoopConf()).delete(path, True)
