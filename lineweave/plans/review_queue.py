"""The bounded queue of texts for an outside review, and decoding of stored responses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import trimmed
from ..operators import findings as algebra
from ..sources.selection import budget_prefix, running_totals
from .report import diagnostic

MAX_LINE = 4294967295  # Fixed value: line numbers are unsigned 32-bit


def bounded_content(content: Column, max_chars: int) -> Column:
    """A text longer than ``max_chars`` bytes is cut to its first ``max_chars`` characters."""
    return F.when(F.octet_length(content) > max_chars, F.left(content, F.lit(max_chars))).otherwise(content)


def review_queue(entries: DataFrame, policy, budget: int | None = None) -> DataFrame:
    """All suspicious files by path: ``path, language, content, policy, place, within_budget``.

    ``within_budget`` marks the first ``budget`` of them (the policy's review budget by default);
    the rest stay in the table.  Places come from running counts per range of paths, as the file
    budget's do, so no task sees all paths.
    """
    allowed = policy.review.max_files if budget is None else budget
    queue = entries.filter("suspicious").select(
        "path", "language", bounded_content(F.col("content"), policy.review.max_content_chars).alias("content"),
        F.lit(policy.name).alias("policy"))
    # every file counts as one byte, so the byte limit never binds before the number of files
    places = budget_prefix(queue.select("path", F.lit(1).cast("long").alias("size")), allowed, allowed)
    return queue.join(places.select("path", F.col("nth").alias("place"), "within_budget"), "path")


OUTCOMES = ("done", "failed", "pending")


def by_outcome(queue: DataFrame, responses: DataFrame, budget: int, body: str = "body") -> DataFrame:
    """``path, place, outcome, used_before, attempted`` of queued files: a review that failed leaves the budget as it was.

    ``responses`` has ``path`` and the stored answer, one row for each file that was asked about. A file is
    ``done`` if its answer decodes (or is empty), ``failed`` if it does not, ``pending`` without one. Along the queue, done and pending
    files use up the budget; files are attempted while some is left. So the pending ones that are attempted are those to ask about
    next. The running total of uses is taken per range of paths (see ``running_totals``), never in one task.
    """
    text = response_text(F.col(body))
    failed = (F.coalesce(text, F.lit("")) != "") & F.try_parse_json(text).isNull()
    answered = responses.select(F.col("path").alias("_path"), F.when(failed, "failed").otherwise("done").alias("_outcome"))
    marked = queue.select("path").join(answered, F.col("path") == F.col("_path"), "left").select(
        "path", F.coalesce("_outcome", F.lit("pending")).alias("outcome"))
    placed = running_totals(marked.withColumn("used", (F.col("outcome") != "failed").cast("long")), "path", "used")
    return placed.select("path", F.col("nth").alias("place"), "outcome", "used_before", (F.col("used_before") < budget).alias("attempted"))


def accepted_responses(outcomes: DataFrame, responses: DataFrame) -> DataFrame:
    """The answers that count: those of files that were attempted. Others were asked for beyond the budget."""
    return responses.join(outcomes.filter("attempted").select("path"), "path", "left_semi")


def review_findings(responses: DataFrame, policy, body: str = "body") -> tuple[DataFrame, DataFrame]:
    """Findings of stored answers, cleaned, in the shared layout; and diagnostics of answers that do not decode or say too much.

    All findings stay; a file with more than the limit of an outside source is a diagnostic.
    """
    raw = decode_responses(responses, "path", body=body)
    clean = algebra.sanitize_external(raw, "nth", source="review")
    named = clean.withColumn("source", F.concat(F.lit("ollama:"), F.col("path")))
    many = algebra.over_limit(clean)
    message = F.concat(F.lit(f"ai provider {policy.name}: "), F.col("dropped").cast("string"), F.lit(" findings over the limit"))
    return algebra.as_external(named), decode_diagnostics(responses, policy.name, body).unionByName(
        many.select(*diagnostic("scan", "runtime", message, F.col("path"))))


def response_text(body: Column) -> Column:
    """Message text of a stored chat response, from its first brace on."""
    text = trimmed(F.get_json_object(body, "$.choices[0].message.content"))
    at = F.instr(text, "{")
    return F.when(at > 0, F.substr(text, at)).otherwise(text)


def _field(item: Column, name: str) -> Column:
    """A string field of a JSON object; NULL when absent or of another type."""
    value = F.try_variant_get(item, f"$.{name}", "variant")
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(item, f"$.{name}", "string"))


def _whole(item: Column, name: str) -> Column:
    value = F.try_variant_get(item, f"$.{name}", "variant")
    number = F.when(F.schema_of_variant(value) == "BIGINT", F.try_variant_get(item, f"$.{name}", "bigint"))
    return F.when(number.between(0, MAX_LINE), number)


def _parsed(responses: DataFrame, body: str) -> DataFrame:
    text = responses.withColumn("_text", response_text(F.col(body))).filter(F.col("_text") != "")
    return text.withColumn("_json", F.try_parse_json("_text"))


def decode_responses(responses: DataFrame, *keys: str, body: str = "body") -> DataFrame:
    """Findings in stored responses: ``keys, nth, severity, rule, message, category, line, source``."""
    items = _parsed(responses, body).select(
        *keys, F.posexplode_outer(F.try_variant_get("_json", "$.findings", "array<variant>")).alias("nth", "_item"))
    found = items.filter(F.col("_item").isNotNull())
    item = F.col("_item")
    return found.select(
        *keys, "nth",
        F.coalesce(_field(item, "severity"), F.lit("info")).alias("severity"),
        F.coalesce(_field(item, "rule"), F.lit("ai-review")).alias("rule"),
        F.coalesce(_field(item, "message"), F.lit("No review message")).alias("message"),
        _field(item, "category").alias("category"),
        _whole(item, "line").alias("line"),
        F.concat(F.lit("ollama:"), F.col("path")).alias("source"))


def decode_diagnostics(responses: DataFrame, policy_name: str, body: str = "body") -> DataFrame:
    """A diagnostic per response whose text is not JSON."""
    bad = _parsed(responses, body).filter(F.col("_json").isNull())
    message = F.lit(f"ai provider {policy_name}: decode provider findings payload")
    return bad.select(*diagnostic("scan", "runtime", message, F.col("path")))
