"""Helpers shared by the operators: the shared folder, batches for Python, size-checked joins, samples to learn from."""

from __future__ import annotations

import tempfile

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

WORD = r"[^\x20\x09-\x0D]+"

#: Bytes of an Arrow batch that goes to a Python worker (one row more at most).
BATCH_BYTES = 4 << 20

#: Bytes, counted before, that a join may broadcast; beyond it both sides are shuffled.
BROADCAST_BYTES = 32 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The context's own folder below the one the session names for checkpoints.

    Where neither ``spark.checkpoint.dir`` nor the context names a folder, a temporary one
    is made if Spark runs on this machine alone, as in tests; on a cluster that is an error.
    """
    context = spark.sparkContext
    if context._jsc.sc().getCheckpointDir().isEmpty():
        folder = context.getConf().get("spark.checkpoint.dir")
        if not folder:
            if not context.master.startswith("local"):
                raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
            folder = tempfile.mkdtemp(prefix="checkpoint")
        context.setCheckpointDir(folder)
    return context._jsc.sc().getCheckpointDir().get()


def cut(df: DataFrame) -> DataFrame:
    """Cut the lineage by a reliable checkpoint in the shared folder."""
    shared_folder(df.sparkSession)
    return df.checkpoint(eager=True)


def map_batches(df: DataFrame, run, schema) -> DataFrame:
    """mapInArrow with the session's batches bounded by ``BATCH_BYTES``: long texts make batches of fewer rows."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def bounded(batches):
        yield from run(batches)
        # a worker lives on after its task: what it freed goes back to the machine
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(bounded, schema)


def gathered(df: DataFrame, rows: int, per_task: int) -> DataFrame:
    """``df`` of ``rows`` rows in tasks of about ``per_task``, 8 tasks at least, never more tasks than it has: small tables leave few files."""
    return df.coalesce(rows // per_task + 8)


def join_checked(big: DataFrame, small: DataFrame, on: str, how: str, width: Column | int = 16, limit: int = BROADCAST_BYTES) -> DataFrame:
    """Join that broadcasts ``small`` only if its rows of ``width`` bytes, counted here, have at most ``limit`` in all; else both sides are shuffled."""
    size = small.agg(F.sum(width if isinstance(width, Column) else F.lit(width))).first()[0] or 0
    return big.join(F.broadcast(small) if size <= limit else small, on, how)


def held_out(doc_id: Column) -> Column:
    """True for the rows no model may learn from: crc32 of the id as text, modulo 4, is 2. A null id counts as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def share_of(key: Column) -> Column:
    """A number from 0 to 1 drawn by hash, the same at each run."""
    return F.pmod(F.xxhash64(F.lit("sample"), key), F.lit(1 << 30)) / F.lit(float(1 << 30))


def sample_share(bound: int, count: Column, key: Column) -> Column:
    """Keeps about ``bound`` of ``count`` rows with different keys, the same at each run."""
    return share_of(key) < F.lit(float(bound)) / count


def learning_texts(rows: DataFrame, counts: dict, bound: int, piece: int, most_bytes: int) -> pa.Table:
    """A bounded sample of ``rows`` (text, label) to learn from: (text, label, n).

    Of each label about ``bound`` distinct texts are drawn by a hash of the text, which
    keeps rows of one id apart and equal rows together (``n`` is their number); a text's
    first ``piece`` characters are read, and of each label, in the order of the hash, as
    many texts as hold ``most_bytes``, the first at any rate. ``counts`` has the rows of
    each label.
    """
    least = min(counts.values(), default=1)
    place = share_of(F.col("text"))
    sizes = rows.sparkSession.createDataFrame([(k, float(bound) / v) for k, v in counts.items()], f"label {dict(rows.dtypes)['label']}, share double")
    some = rows.select("text", "label", place.alias("place")).filter(F.col("place") < float(bound) / least).join(F.broadcast(sizes), "label").filter("place < share")
    some = cut(some.groupBy("label", "place", F.substring("text", 1, piece).alias("text")).agg(F.count(F.lit(1)).alias("n")))
    # sizes of at most about bound texts a label come first, then the texts that fit
    seen = some.select("label", "place", F.octet_length("text").alias("bytes")).toArrow().to_pandas().sort_values(["label", "place"])
    total = seen.groupby("label")["bytes"].cumsum()
    fits = seen[(total <= most_bytes) | (total == seen["bytes"])]
    last = [(k, float(v)) for k, v in fits.groupby("label")["place"].max().items()]
    last = rows.sparkSession.createDataFrame([(k if isinstance(k, str) else int(k), v) for k, v in last], f"label {dict(rows.dtypes)['label']}, last double")
    return some.join(F.broadcast(last), "label").filter("place <= last").orderBy("label", "place").select("text", "label", "n").toArrow()
