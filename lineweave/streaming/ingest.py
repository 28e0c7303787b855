"""Continuous reviews: newly arrived files are reviewed once, changed files again."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.lines import unnest_findings
from ..plans import incremental
from ..plans.policies import Policy
from ..plans.review import ReviewOptions, review_files
from ..session import stored
from .store import ReviewStore

FILES_SCHEMA = "path string, size bigint, modified timestamp, content string"


BITS_PER_PATH = 16
BITMAP_FROM, BITMAP_BYTES = 100_000, 128 << 20  # fewer names are a small join; a larger bitmap is not broadcast


def with_texts(files: DataFrame, names: DataFrame, count: int, bitmap_from: int = BITMAP_FROM) -> DataFrame:
    """The files whose ``path`` is among the ``count`` ``names``.

    Many names are first hashed into a bitmap of ``BITS_PER_PATH`` bits a name, which is broadcast: of the other
    files about one in sixteen is left when the join shuffles texts.
    """
    if not bitmap_from <= count or count * BITS_PER_PATH // 8 > BITMAP_BYTES:
        return files.join(names, "path", "left_semi")
    cell = F.pmod(F.xxhash64("path"), F.lit(count * BITS_PER_PATH)) + 1
    bits = (names.select(cell.alias("cell")).groupBy(F.bitmap_bucket_number("cell").alias("_bucket"))
            .agg(F.bitmap_construct_agg(F.bitmap_bit_position("cell")).alias("_bits")))
    at = F.bitmap_bit_position("_cell")
    byte = F.conv(F.hex(F.substr("_bits", (F.floor(at / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("bigint")
    likely = (files.withColumn("_cell", cell).withColumn("_bucket", F.bitmap_bucket_number("_cell"))
              .join(F.broadcast(bits), "_bucket").filter(F.getbit(byte, (at % 8).cast("int")) == 1))
    return likely.select(*files.columns).join(names, "path", "left_semi")


def one_per_path(keys: DataFrame) -> DataFrame:
    """A path that a batch holds several times counts as its newest file; of equal times, that of the largest hash.

    ``keys`` are narrow; no text takes part in the aggregation.
    """
    last = F.max(F.struct("modified", "content_hash", "size")).alias("_k")
    return keys.groupBy("path").agg(last).select("path", "_k.size", "_k.modified", "_k.content_hash")


def review_batch(batch: DataFrame, batch_id: int, target: str, policy: Policy,
                 options: ReviewOptions = ReviewOptions(), run: str = "r0") -> ReviewStore:
    """Review the files of one batch that are new or changed, and append their entries to the store below ``target``.

    Each batch owns one segment and replaces it, so running a batch again after a failure leaves the same result;
    it does not see its own segment. ``run`` names the checkpoint, whose batches are numbered from 0.
    Fingerprints are taken once; the lookup moves keys of the batch, not of the store.
    """
    store = ReviewStore(batch.sparkSession, f"{target}/store")
    name = f"{run}-{batch_id:09d}"
    store.compact(without=name)
    version = incremental.ruleset_version(policy, options.rule_set, options=options)
    keys = stored(one_per_path(incremental.with_fingerprint(batch).select(*incremental.KEY_COLUMNS)), "arrived-keys")
    count = keys.count()
    if any(s.name != name for s in store.segments):
        known = store.known(keys, count, name)
        keys = stored(incremental.missed_keys(keys, known, version, keep=("content_hash",)), "changed-keys")
        count = keys.count()
    todo = batch.join(keys.select("path", "content_hash"), "path").filter(
        F.col("content_hash") == incremental.content_hash(F.col("content")))
    store.append(incremental.entries_to_store(review_files(todo, policy, options), version), name, count)
    return store


def rescan(files: DataFrame, store: ReviewStore, policy: Policy, options: ReviewOptions = ReviewOptions(),
           trust_times: bool = True) -> int:
    """Review the files of a whole scan that are new or changed, and append them; how many there were.

    Files whose size and time are those of the newest entry (of this version) are unchanged: their texts are not read. Without
    ``trust_times``, or where a time is not known, hashes of the texts have to agree as well. Paths are unique. The names of changed
    files go through a bitmap (``with_texts``), so that unchanged texts are not shuffled to find them.
    """
    store.compact()
    version = incremental.ruleset_version(policy, options.rule_set, options=options)
    columns = ["path", "size", "modified"] + ([] if trust_times else ["content_hash"])
    state = store.compared((files if trust_times else incremental.with_fingerprint(files)).select(*columns))
    known = F.col("known")
    same = ((known["ruleset_version"] == version) & (known["size"] == F.col("size"))
            & known["modified"].eqNullSafe(F.col("modified")))
    same = same & (F.col("modified").isNotNull() if trust_times else known["content_hash"] == F.col("content_hash"))
    changed = stored(state.filter(~F.coalesce(same, F.lit(False))).select("path"), "changed-files")
    count = changed.count()
    todo = incremental.with_fingerprint(with_texts(files, changed, count))
    store.append(incremental.entries_to_store(review_files(todo, policy, options), version), f"s{store.version + 1:012d}", count)
    return count


def current_entries(spark: SparkSession, target: str) -> DataFrame:
    """The newest entry of every file that has arrived."""
    return ReviewStore(spark, f"{target}/store").current()


def current_findings(spark: SparkSession, target: str) -> DataFrame:
    """Findings of the newest entries, one a row."""
    return unnest_findings(current_entries(spark, target), "findings", "path", "content_hash")


def start_reviews(spark: SparkSession, source: str, target: str, checkpoint: str, policy: Policy,
                  options: ReviewOptions = ReviewOptions(), max_files_per_batch: int | None = None) -> StreamingQuery:
    """Review every parquet file of ``source`` that has not been seen, then stop.

    Batches are stateless; what is known about earlier files is read from the store.
    """
    reader = spark.readStream.schema(FILES_SCHEMA)
    if max_files_per_batch:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_batch))

    run = hashlib.sha256(checkpoint.encode()).hexdigest()[:12]

    def process(batch: DataFrame, batch_id: int) -> None:
        review_batch(batch, batch_id, target, policy, options, run)

    return (reader.parquet(source).writeStream.foreachBatch(process)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
