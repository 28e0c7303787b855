"""Incremental rescans: a findings store keyed by path, content hash and ruleset version.

The store is a log of entries, one row per analysed file.  A rescan compares narrow keys
only (path, size, time, hash); texts are read again just for the files that changed.
"""

from __future__ import annotations

import hashlib
from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.findings_schema import FINDINGS_TYPE, RULES
from ..functions.fixed_values import PYTHON_SYMBOL_RULES, STORE_VERSION
from ..operators.rule_table import RowRule
from ..session import checkpointed
from .policies import Policy, policy_named
from .review import ReviewOptions, review_files

KEY_COLUMNS = ("path", "size", "modified", "content_hash")
STORE_COLUMNS = KEY_COLUMNS + ("ruleset_version", "findings", "content_preview")


def content_hash(content: Column, hash_bytes: int | None = None) -> Column:
    """SHA-256 of the whole text, or of its first ``hash_bytes`` bytes where a number is given."""
    data = F.encode(content, "UTF-8")
    return F.sha2(data if hash_bytes is None else F.substring(data, 1, hash_bytes), 256)


def with_fingerprint(files: DataFrame, hash_bytes: int | None = None) -> DataFrame:
    return files.withColumn("content_hash", content_hash(F.col("content"), hash_bytes))


def ruleset_version(policy: Policy | str, rule_set: str = "all", version: int = STORE_VERSION,
                    options: ReviewOptions | None = None) -> str:
    """Entries made under another policy, rule set, options, rule texts or layout are not reused."""
    policy = policy_named(policy) if isinstance(policy, str) else policy
    packs = [(pack.name, [r if isinstance(r, RowRule) else (r.rule, r.severity, r.category, r.message, r.languages) for r in pack.rules])
             for pack in (options.rule_packs if options else ())]
    analyzers = [(a.name, a.language, a.version) for a in (options.analyzers if options else ())]
    rest = replace(options, rule_packs=(), analyzers=()) if options else None
    seen = repr((policy, rule_set, rest, packs, analyzers, RULES, PYTHON_SYMBOL_RULES))
    return f"{version}:{policy.name}:{rule_set}:{hashlib.sha256(seen.encode()).hexdigest()[:16]}"


def store_schema() -> str:
    """The layout of a store, for a first scan without one."""
    return ("path string, size bigint, modified timestamp, content_hash string, ruleset_version string, "
            f"findings {FINDINGS_TYPE}, content_preview string")


def usable(store: DataFrame, version: str) -> DataFrame:
    return store.filter(F.col("ruleset_version") == version)


SAME = "k.path = s.path AND k.content_hash = s.content_hash AND k.size = s.size AND k.modified <=> s.modified"


def hits(files: DataFrame, store: DataFrame, version: str) -> DataFrame:
    """Stored entries that are still true, with their findings and preview."""
    keys, stored = files.select(*KEY_COLUMNS).alias("k"), usable(store, version).alias("s")
    return keys.join(stored, F.expr(SAME)).select(*[F.col(f"s.{c}") for c in STORE_COLUMNS])


def missed_keys(files: DataFrame, store: DataFrame, version: str, keep: tuple[str, ...] = ()) -> DataFrame:
    """``path`` (and the columns to ``keep``) of files that are new or changed; no text takes part in this join."""
    keys = files.select(*KEY_COLUMNS, *(c for c in keep if c not in KEY_COLUMNS)).alias("k")
    stored = usable(store, version).select(*KEY_COLUMNS).alias("s")
    return keys.join(stored, F.expr(SAME), "left_anti").select("path", *keep)


def misses(files: DataFrame, store: DataFrame, version: str) -> DataFrame:
    """The files to analyse, texts included.

    The names of changed files are checkpointed, so that hashing every text happens once; the
    join with the texts is the planner's to choose by the size of that list.
    """
    return files.join(checkpointed(missed_keys(files, store, version)), "path", "left_semi")


def rescan(files: DataFrame, store: DataFrame, policy: Policy, options: ReviewOptions) -> DataFrame:
    """The next store after a scan of ``files``: stored entries that are still true, fresh reviews of the rest.

    Fingerprints are taken once, into a narrow checkpoint; only changed texts are read again.
    """
    version = ruleset_version(policy, options.rule_set, options=options)
    keys = checkpointed(with_fingerprint(files).select(*KEY_COLUMNS))
    changed = missed_keys(keys, store, version)
    todo = files.join(checkpointed(changed), "path", "left_semi").join(keys.select("path", "content_hash"), "path")
    fresh = entries_to_store(review_files(todo, policy, options), version)
    return hits(keys, store, version).unionByName(fresh)


def entries_to_store(entries: DataFrame, version: str) -> DataFrame:
    """Review entries that carried their fingerprint, in store layout."""
    return entries.withColumn("ruleset_version", F.lit(version)).select(*STORE_COLUMNS)


def upsert(store: DataFrame, fresh: DataFrame, version: str) -> DataFrame:
    """The next store: fresh entries, and every other usable entry.

    Files that are gone stay.  Entries of another ruleset version are dropped.  Write the
    result to a new path; it reads the old one.
    """
    kept = usable(store, version).join(fresh.select("path"), "path", "left_anti").select(*STORE_COLUMNS)
    return fresh.select(*STORE_COLUMNS).unionByName(kept)


def latest(log: DataFrame, order: str = "batch_id", columns=STORE_COLUMNS) -> DataFrame:
    """The newest entry of each path in an append-only log of entries.

    ``columns`` narrows what is carried through the aggregation; finding out what changed
    needs only ``KEY_COLUMNS`` and the version.
    """
    newest = log.groupBy("path").agg(F.max_by(F.struct(*columns), F.col(order)).alias("_e"))
    return newest.select("_e.*")
