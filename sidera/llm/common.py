"""What the corpus operators share: durable cuts of the lineage, hashing, slicing of Arrow batches, components."""

from __future__ import annotations

import atexit
import ctypes
import re
import shutil
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

GOLD = np.uint64(0x9E3779B97F4A7C15)
WORD = re.compile(r"\w+")
#: Characters that one step of a vectorised kernel takes at once; a longer text is a step of its own.
STEP_CHARS = 1_000_000


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as spark.checkpoint.dir names it.

    A local session that names none, such as a test, gets a folder of its own that goes when it ends; on a cluster a
    missing setting is an error, as no other folder is known to be shared.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
        named = tempfile.mkdtemp(prefix="sidera-")
        atexit.register(shutil.rmtree, named, True)
        spark.conf.set("spark.checkpoint.dir", named)
    return named.rstrip("/")


def durable(df: DataFrame) -> DataFrame:
    """df cut from its lineage by checkpoint() in the shared folder."""
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a folder of a job's own, wherever it lies."""
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def mix64(x: np.ndarray) -> np.ndarray:
    """The splitmix64 finaliser: a bijection of 64-bit integers."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class WordHashes(dict):
    """64-bit hashes of words, kept for the words seen lately."""

    LIMIT = 150_000

    def __missing__(self, word: str) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word.encode("utf-8", "surrogatepass"))
        return h


WORDS = WordHashes()


def word_hashes(words: list[str]) -> np.ndarray:
    return np.fromiter(map(WORDS.__getitem__, words), dtype=np.uint64, count=len(words))


def hashed(words_of: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
    """The hashes of all words one after another, and the offset at which each list begins (one more than lists)."""
    offsets = np.zeros(len(words_of) + 1, np.int64)
    np.cumsum([len(w) for w in words_of], out=offsets[1:])
    flat = np.empty(offsets[-1], np.uint64)
    for k, words in enumerate(words_of):
        flat[offsets[k] : offsets[k + 1]] = word_hashes(words)
    return flat, offsets


def give_back() -> None:
    """Returns freed memory to the system, as workers stay for other tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def steps(batches: Iterator[pa.RecordBatch], text: str = "text") -> Iterator[pa.RecordBatch]:
    """Slices of the batches with about STEP_CHARS bytes of the text column each, every row once and in order."""
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        part = (np.cumsum(sizes) - sizes) // STEP_CHARS
        cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
        for a, b in zip(cuts, cuts[1:]):
            yield batch.slice(a, b - a)
    give_back()


def blobs(values: list[bytes]) -> pa.Array:
    return pa.array(values, pa.binary())


def numbered(df: DataFrame) -> DataFrame:
    """df with its columns renamed __c0, __c1, ...: no name of an operator's own can clash with them."""
    return df.toDF(*(f"__c{k}" for k in range(len(df.columns))))


def components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """(id, root): each node of the undirected edges with the least id of its connected component.

    Alternates large-star and small-star steps, in which every node sends its larger or smaller neighbours
    to the least one; the number of rounds grows with the logarithm of the component. Each round is
    checkpointed. Edges with a null end and loops are ignored; repeated edges count once.
    """
    e = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    e = durable(e.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    before = None
    while True:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # A node's neighbours beside the least of them: a partial aggregate and a join, so a node with
        # very many neighbours never has them all gathered in one row.
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        low = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        own = low.select("u", F.col("m").alias("v"))
        e = durable(small.where("u <> v").unionByName(own).distinct())
        now = e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if before == now:
            break
        before = now
    return e.groupBy(F.col("u").alias("id")).agg(F.min("v").alias("root")).unionByName(e.select(F.col("v").alias("id"), F.col("v").alias("root")).distinct())
