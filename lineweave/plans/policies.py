"""Built-in review policies, as values and as tables."""

from __future__ import annotations

from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, SparkSession

from ..functions.fixed_values import FILE_RULES, KERNEL_RULES, LINE_RULES, SEVERITY_RANKS

KIB, MIB = 1024, 1024 * 1024


# The defaults of the three classes below.
@dataclass(frozen=True)
class Limits:
    max_file_size_bytes: int = MIB
    max_file_read_bytes: int = 32 * KIB
    max_total_bytes: int = 50 * MIB
    max_files: int = 20_000


@dataclass(frozen=True)
class ReviewBudget:
    enabled: bool = False
    max_files: int = 0
    max_content_chars: int = 12_000
    mock_message: str | None = None


@dataclass(frozen=True)
class Policy:
    name: str = "quick"
    description: str = "Local-first profile"
    rules: tuple[str, ...] = ("todo-comment", "unsafe-usage", "possible-secret")
    suspicious_patterns: tuple[str, ...] = ("password", "secret", "api_key", "token=")
    prioritize: tuple[str, ...] = ("possible-secret", "unsafe-usage")
    include_hidden: bool = False
    include_globs: tuple[str, ...] = ()
    exclude_globs: tuple[str, ...] = (".git/**", "target/**", "node_modules/**")
    include_binary: bool = False
    limits: Limits = field(default_factory=Limits)
    language_planes: bool = False
    review: ReviewBudget = field(default_factory=ReviewBudget)
    include_content_preview: bool = False
    severity_threshold: str = "info"

    @property
    def is_kernel(self) -> bool:
        return self.name == "kernel-c"

    def with_limits(self, **changes) -> "Policy":
        return replace(self, limits=replace(self.limits, **changes))


# The thirteen policies, each given by what differs from the defaults.
POLICIES = (
    Policy("quick", limits=Limits(512 * KIB, 8 * KIB, 10 * MIB, 500)),
    Policy("security", "Security-sensitive review profile",
           rules=("todo-comment", "unsafe-usage", "possible-secret", "possible-secret"),
           suspicious_patterns=("password", "secret", "api_key", "token=", "token"),
           language_planes=True,
           review=ReviewBudget(True, mock_message="No security finding by AI in this file snippet")),
    Policy("architecture", "Architecture review profile",
           rules=("todo-comment", "large-file", "hard-to-read-function"),
           suspicious_patterns=("TODO", "FIXME", "XXX"), prioritize=("large-file", "todo-comment")),
    Policy("deep", "Deep local analysis profile", limits=Limits(2 * MIB, 64 * KIB, 120 * MIB, 20_000),
           review=ReviewBudget(True, 80)),
    Policy("performance", "Performance-focused review profile", limits=Limits(2 * MIB, 32 * KIB, 80 * MIB, 15_000)),
    Policy("maintainability", "Maintainability-focused review profile",
           rules=("todo-comment", "possible-secret", "hardcoded-value"), suspicious_patterns=("TODO", "FIXME"),
           prioritize=("todo-comment",), language_planes=True),
    Policy("kernel-c", "Linux kernel C review profile", limits=Limits(2 * MIB, 64 * KIB, 250 * MIB, 25_000),
           include_globs=("drivers/**", "fs/**", "include/**", "ipc/**", "kernel/**", "mm/**", "net/**"),
           exclude_globs=(".git/**", "Documentation/**", "samples/**", "tools/**"),
           rules=("unsafe-usage", "kernel-style"),
           suspicious_patterns=("BUG_ON", "goto out", "printk(", "spin_lock(", "mutex_lock(", "rcu_read_lock(",
                                "__init", "__exit"),
           prioritize=KERNEL_RULES, language_planes=True),
    Policy("ai-generated-code-review", "AI-generated code review profile", language_planes=True,
           review=ReviewBudget(True, mock_message=(
               "AI-generated code smell: check for repetitive patterns and naming quality."))),
    Policy("legacy-modernization", "Legacy modernization profile",
           rules=("todo-comment", "deprecated-api", "possible-secret"), suspicious_patterns=("TODO", "FIXME", "XXX"),
           prioritize=("deprecated-api", "possible-secret")),
    Policy("pre-merge", "Pre-merge quality gate profile", limits=Limits(512 * KIB, 16 * KIB, 40 * MIB, 5_000),
           severity_threshold="medium"),
    Policy("strict", "Strict policy profile", include_content_preview=True, severity_threshold="low",
           review=ReviewBudget(True, 120, 8 * KIB)),
    Policy("educational", "Educational profile with guidance focus",
           review=ReviewBudget(True, mock_message="Explainability guidance requested by educational profile")),
    Policy("production-readiness", "Production readiness checks", limits=Limits(2 * MIB, 16 * KIB, 80 * MIB, 15_000),
           rules=("todo-comment", "possible-secret", "unsafe-usage"),
           suspicious_patterns=("TODO", "FIXME", "api_key"), prioritize=("possible-secret",)),
)
BY_NAME = {policy.name: policy for policy in POLICIES}


def policy_named(name: str) -> Policy:
    return BY_NAME[name]


def evaluated_rules(policy: Policy, rule_set: str = "scan") -> tuple[str, ...]:
    """Rules a policy evaluates: those it lists (``scan``), every registry line rule
    (``registry``), or both (``all``)."""
    listed = tuple(dict.fromkeys(policy.rules))
    registry = tuple(text.name for text in LINE_RULES)
    if rule_set == "scan":
        return listed
    if rule_set == "registry":
        return registry
    return listed + tuple(name for name in registry if name not in listed)


def policy_table(spark: SparkSession, policies=POLICIES) -> DataFrame:
    """One row per policy; a literal list, so its size is known."""
    rows = [(p.name, p.description, list(p.rules), list(p.suspicious_patterns), list(p.prioritize),
             list(p.include_globs), list(p.exclude_globs), p.limits.max_file_size_bytes, p.limits.max_file_read_bytes,
             p.limits.max_total_bytes, p.limits.max_files, p.language_planes, p.review.enabled, p.review.max_files,
             p.review.max_content_chars, p.include_content_preview, p.severity_threshold) for p in policies]
    return spark.createDataFrame(rows, """
        policy string, description string, rules array<string>, suspicious_patterns array<string>,
        prioritize array<string>, include_globs array<string>, exclude_globs array<string>,
        max_file_size_bytes bigint, max_file_read_bytes bigint, max_total_bytes bigint, max_files bigint,
        language_planes boolean, review_enabled boolean, review_max_files bigint, review_max_content_chars bigint,
        include_content_preview boolean, severity_threshold string""")


def policy_rule_table(spark: SparkSession, policies=POLICIES, rule_set: str = "scan") -> DataFrame:
    """One row per policy and rule it evaluates, with what retention needs."""
    file_rules = {text.name for text in FILE_RULES}
    rows = []
    for p in policies:
        for rule in evaluated_rules(p, rule_set):
            if p.is_kernel and rule in ("todo-comment", "possible-secret") and rule in file_rules:
                continue
            rows.append((p.name, rule, rule in p.prioritize, SEVERITY_RANKS[p.severity_threshold], p.is_kernel))
    return spark.createDataFrame(
        rows, "policy string, rule string, prioritized boolean, threshold_rank int, kernel boolean")
