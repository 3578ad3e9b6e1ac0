"""What the operators of this subpackage share: the shared folder and written tables."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_OWN: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir.

    Where it is unset (tests on a local master) a new folder under /tmp serves;
    on a cluster an unset value is an error, for no local folder would do.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if found:
        return found.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _OWN:
        _OWN[app] = "file://" + tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return _OWN[app]


def new_path(spark: SparkSession, label: str) -> str:
    return f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Writes df to the shared folder and reads it back, which cuts the lineage: a lost executor costs no earlier stage."""
    path = new_path(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def discard(df: DataFrame) -> None:
    """Deletes the files of a table made by ``written`` once nothing reads it any more."""
    spark = df.sparkSession
    root = shared_dir(spark).removeprefix("file://")
    hadoop = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    for parent in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
        if root in parent:
            at = hadoop(parent)
            at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


#: Rows of an Arrow batch between the JVM and Python; texts may be long, and both sides hold a batch whole.
BATCH_ROWS = 1000


def small_batches(spark: SparkSession) -> None:
    """Lowers the session's Arrow batches to BATCH_ROWS rows; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table of documents; batches of its texts are kept small."""
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def free_name(name: str, rows: DataFrame) -> str:
    """The name, with underscores until no column of rows has it."""
    while name.lower() in {c.lower() for c in rows.columns}:
        name += "_"
    return name


def numbered(rows: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """rows under names that clash with nothing, and the new name of each column."""
    names = {c: f"column_{i}" for i, c in enumerate(rows.columns)}
    return rows.toDF(*names.values()), names


def first_by_hash(rows: DataFrame, by: list[str], key: str, salt: str, n: int) -> DataFrame:
    """The first n rows of each group by a hash of their key; groups are few.

    Groups are thinned by the hash to half as many again as wanted first, so a task orders about 1.5 n rows however long a group is.
    """
    range_ = 1 << 53
    placed = rows.withColumn("_u", F.pmod(F.xxhash64(F.lit(salt), key), F.lit(range_)))
    counts = placed.groupBy(*by).agg(F.count("*").alias("_n")) if by else placed.agg(F.count("*").alias("_n"))
    joined = placed.join(F.broadcast(counts), by) if by else placed.crossJoin(F.broadcast(counts))  # a row a group; thinned where they are
    thin = joined.filter(F.col("_u") * F.col("_n").cast("double") <= 1.5 * n * range_ + 64.0 * range_)
    order = Window.partitionBy(*by).orderBy("_u", key)
    return thin.withColumn("_r", F.row_number().over(order)).filter(F.col("_r") <= n).drop("_u", "_n", "_r")


def split_hot(rows: DataFrame, keys: DataFrame, key: str) -> tuple[DataFrame, DataFrame]:
    """(rows with one of keys, rows with another); keys are a thousand at most, so no row moves."""
    few = F.broadcast(keys)
    return rows.join(few, key, "left_semi"), rows.join(few, key, "left_anti")


#: A key with over a HOT-th of what a table of classes counts is hot; there are HOT such keys at most.
HOT = 1000


def hot_joined(rows: DataFrame, classes: DataFrame, keys: list[str], size: str, how: str = "left", merged: bool = False) -> DataFrame:
    """rows with the columns of their class, a row a key, by equal keys; ``size`` is the number of rows of a class.

    Classes of over a HOT-th of all rows, HOT at most, are broadcast, so their rows stay where they are; the others meet by a shuffle.
    ``classes`` is read twice and should be a written table. Null keys find no class. ``merged``
    keeps Spark from broadcasting either side, for it takes rows of an explode for far fewer than they are.
    """
    total = classes.agg(F.coalesce(F.sum(size), F.lit(0))).first()[0]
    hot = F.broadcast(classes.filter(F.col(size) * HOT > F.lit(int(total))))
    seldom = classes.filter(F.col(size) * HOT <= F.lit(int(total)))
    return rows.join(hot, keys).unionByName(rows.join(hot.select(*keys), keys, "left_anti").join(seldom.hint("merge") if merged else seldom, keys, how))


def salted(left: DataFrame, right: DataFrame, key: str, pieces: int = 16) -> DataFrame:
    """left joined with right, a row a key, where keys with over a HOT-th of left's rows are dealt out to ``pieces`` tasks, each with a copy of their row.

    ``left`` is read twice and should be a written table. The hot keys, HOT at most, are known to the driver.
    """
    total = left.count()
    hot = [r[0] for r in left.groupBy(key).agg(F.count("*").alias("n")).filter((F.col("n") * HOT > total) & (F.col("n") > 16 * pieces)).select(key).collect()]
    if not hot:
        return left.join(right, key)
    is_hot, piece = F.col(key).isin(hot), "_piece"
    dealt = left.withColumn(piece, F.when(is_hot, F.pmod(F.xxhash64(*left.columns), F.lit(pieces))).otherwise(0).cast("int"))
    copies = right.withColumn(piece, F.explode(F.when(is_hot, F.sequence(F.lit(0), F.lit(pieces - 1))).otherwise(F.array(F.lit(0)))))
    return dealt.join(copies, [key, piece]).drop(piece)


def one_text_each(rows: DataFrame, key: str, *content: str) -> None:
    """Fails unless rows that repeat a key agree in what names their content."""
    names = [F.max(F.struct(*content)) != F.min(F.struct(*content))]
    wrong = rows.filter(F.col(key).isNotNull()).groupBy(key).agg(names[0].alias("_differ")).filter("_differ").select(key).first()
    if wrong:
        raise ValueError(f"{key} {wrong[0]} stands at different texts")


def held_out(doc_id: Column) -> Column:
    """Whether crc32(doc_id as text) mod 3 is 1; such rows are never learned from."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))
