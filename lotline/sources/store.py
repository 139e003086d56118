"""Written tables under the shared work folder: each derived input is written
once (keyed by its source and the code that derives it) and read back, which
cuts the lineage and is the recovery point if an executor is lost.

A table is a folder of complete versions and numbered files ``_current-<n>``, the
last of which names one of them.  A version is written under a name of its own and
named afterwards, so readers never see half a table, and two drivers
that build the same table at once each finish a version of which one is used.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from ..session import work_dir


def _fs(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()), p


def read_text(spark: SparkSession, path: str) -> str:
    """Contents of a small file."""
    fs, p = _fs(spark, path)
    stream = fs.open(p)
    try:
        return spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_new(spark: SparkSession, path: str, text: str) -> bool:
    """Write a small file that is not there yet; it appears whole, by a rename
    that does not overwrite.  False: there is one already."""
    folder, name = path.rsplit("/", 1)
    fs, temp = _fs(spark, f"{folder}/.next-{uuid.uuid4().hex}")
    out = fs.create(temp, False)
    out.write(bytearray(text.encode()))
    out.close()
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    plain = spark.sparkContext._gateway.new_array(getattr(jvm.org.apache.hadoop.fs, "Options$Rename"), 0)
    context = jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), conf)
    final = jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    try:
        context.rename(fs.makeQualified(temp), fs.makeQualified(final), plain)
        return True
    except Exception:
        fs.delete(temp, False)
        if fs.exists(final):
            return False
        raise


def read_pointer(spark: SparkSession, folder: str) -> str | None:
    """The version named last (None: none is complete yet).  Versions are named by
    numbered files, so a crash leaves the previous name in force."""
    names = sorted(n for n, *_ in list_files(spark, folder) if n.startswith("_current-"))
    return read_text(spark, f"{folder}/{names[-1]}") if names else None


def write_pointer(spark: SparkSession, folder: str, version: str) -> None:
    """Name a complete version in the next numbered file."""
    while True:
        names = sorted(n for n, *_ in list_files(spark, folder) if n.startswith("_current-"))
        number = int(names[-1].rsplit("-", 1)[1]) + 1 if names else 0
        if write_new(spark, f"{folder}/_current-{number:012d}", version):
            for old in names[:-1]:  # the one before stays for readers that have listed it
                delete_dir(spark, f"{folder}/{old}")
            return


def build_once(spark: SparkSession, name: str, key: str, write) -> str:
    """Folder of the complete version of a written table, written by
    ``write(folder)`` unless there is one."""
    folder = f"{work_dir(spark)}/tables/{name}/{key}"
    version = read_pointer(spark, folder)
    if version is None:
        version = uuid.uuid4().hex
        write(f"{folder}/{version}")
        # of two drivers the first to finish is kept
        if read_pointer(spark, folder) is None:
            write_pointer(spark, folder, version)
        version = read_pointer(spark, folder)
    return f"{folder}/{version}"


def materialize(spark: SparkSession, name: str, build, key: str) -> DataFrame:
    """Write ``build()`` once under the shared work folder and read it back."""
    return spark.read.parquet(build_once(spark, name, key, lambda path: build().write.parquet(path)))


def materialize_dir(spark: SparkSession, name: str, build, key: str) -> str:
    """Like ``materialize``; returns the folder of the files."""
    return build_once(spark, name, key, lambda path: build().write.parquet(path))


def materialize_partitioned(spark: SparkSession, name: str, build, key: str, by: list[str]) -> DataFrame:
    """``materialize`` with a partitioned layout (directory per value of ``by``)."""
    return spark.read.parquet(build_once(spark, name, key, lambda path: build().write.partitionBy(*by)
                                         .option("compression", "zstd").parquet(path)))


def materialize_text(spark: SparkSession, name: str, build, key: str) -> DataFrame:
    """Write a one-column (``value``) DataFrame as text once; read it back."""
    return spark.read.text(build_once(spark, name, key, lambda path: build().write.text(path)))


def materialize_csv(spark: SparkSession, name: str, build, key: str) -> str:
    """Write a CSV (header, UTF-8) once under the shared work folder; return its path."""
    return build_once(spark, name, key,
                      lambda path: build().write.option("header", True).option("encoding", "UTF-8").csv(path))


def bucket_count(spark: SparkSession) -> int:
    """Buckets of a stored table: as many as a shuffle has partitions, so items
    that were shuffled for an aggregate meet the stored buckets without another shuffle."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def bucketed_table(spark: SparkSession, name: str, build, key: str, buckets: int | None = None,
                   by: str = "vin") -> DataFrame:
    """A table written once, bucketed and sorted by ``by`` (default: VIN).

    A merge join on ``by`` then reads the stored side already hash-partitioned:
    only the incoming items are shuffled, the stored table is not."""
    n = buckets or bucket_count(spark)
    path = build_once(spark, name, f"{key}-{n}", lambda path: write_bucketed(spark, build(), path, n, by))
    return attach_bucketed(spark, path, n, by)


def _table_name(path: str) -> str:
    return "lotline_" + uuid.uuid5(uuid.NAMESPACE_URL, path).hex


def write_bucketed(spark: SparkSession, df: DataFrame, path: str, buckets: int, by: str = "vin") -> None:
    """Files of a bucketed and sorted table.  The rows are dealt to the bucket
    count first: each task then writes one bucket file instead of one for
    every bucket it happens to hold."""
    name = _table_name(path)
    df.repartition(buckets, by).write.bucketBy(buckets, by).sortBy(by).option("path", path).saveAsTable(name)


def attach_bucketed(spark: SparkSession, path: str, buckets: int, by: str = "vin") -> DataFrame:
    """Written bucketed files as a table with its bucket layout, also in a new session."""
    table = _table_name(path)
    if not spark.catalog.tableExists(table):
        schema = spark.read.parquet(path).schema
        cols = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in schema.fields)
        spark.sql(f"CREATE TABLE {table} ({cols}) USING parquet CLUSTERED BY ({by}) SORTED BY ({by}) "
                  f"INTO {buckets} BUCKETS LOCATION '{path}'")
    return spark.table(table)


def detach_bucketed(spark: SparkSession, path: str) -> None:
    """Forget the catalog entry of a bucketed table; its files stay."""
    spark.sql(f"DROP TABLE IF EXISTS {_table_name(path)}")


def list_files(spark: SparkSession, path: str) -> list[tuple[str, int, int]]:
    """(name, length, modification time) of a file or of the files of a folder."""
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return []
    return sorted((st.getPath().getName(), st.getLen(), st.getModificationTime())
                  for st in fs.listStatus(p) if not st.isDirectory())


def delete_dir(spark: SparkSession, path: str) -> None:
    fs, p = _fs(spark, path)
    fs.delete(p, True)


def list_dirs(spark: SparkSession, path: str) -> list[str]:
    """Names of the sub-folders of ``path`` (empty when it does not exist)."""
    jvm = spark._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    fs = p.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(p):
        return []
    return [st.getPath().getName() for st in fs.listStatus(p) if st.isDirectory()]
