"""Checks of requests and replies of providers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tessera.functions.rules import ALLOWED_MODELS, ROLES

LIMITS = {"content": 32_000, "messages": 100, "max_tokens": 8192, "conversation_id": 128}
REQUEST = "request_id long, messages array<struct<role:string,content:string>>, model string, temperature double, max_tokens long, conversation_id string"


def violations() -> Column:
    """Names of the rules that a request (see REQUEST) breaks."""
    n = F.coalesce(F.size("messages"), F.lit(0))
    bad = lambda test: F.exists("messages", lambda m: F.coalesce(test(m), F.lit(True)))
    rules = {
        "messages": (n < 1) | (n > LIMITS["messages"]),
        "role": bad(lambda m: ~m["role"].isin(*ROLES)),
        "content": bad(lambda m: ~F.length(m["content"]).between(1, LIMITS["content"])),
        "last_message": (n > 0) & (F.get("messages", n - 1)["role"] == "assistant"),
        "model": F.col("model").isNotNull() & ~F.col("model").isin(*ALLOWED_MODELS),
        "temperature": ~F.coalesce(F.col("temperature"), F.lit(0.0)).between(0.0, 2.0),
        "max_tokens": F.col("max_tokens").isNotNull() & ~F.col("max_tokens").between(1, LIMITS["max_tokens"]),
        "conversation_id": F.length("conversation_id") > LIMITS["conversation_id"],
    }
    return F.array_compact(F.array(*(F.when(test, F.lit(name)) for name, test in rules.items())))


def request_validation(requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Good requests, and quarantined ones with their violations."""
    checked = requests.withColumn("violations", violations())
    return checked.filter(F.size("violations") == 0).drop("violations"), checked.filter(F.size("violations") > 0)


def prompt_size_check(messages: DataFrame, limit: int) -> DataFrame:
    """(conv_id, chars, rejected)."""
    return messages.groupBy("conv_id").agg(F.sum(F.length("text")).alias("chars")).withColumn("rejected", F.col("chars") > limit)


def repetition_check(text: Column, least: int = 200) -> Column:
    """Whether a text of `least` characters and words or more has few different words: at most 2, or one in a hundred."""
    words = F.split(F.regexp_replace(text, r"^\s+|\s+$", ""), r"\s+")
    n = F.size(words)
    return (F.length(text) >= least) & (n >= least) & (F.size(F.array_distinct(words)) <= F.greatest(F.lit(2), F.floor(n / 100)))


def error_taxonomy(status: Column, body: Column) -> Column:
    """struct<error, retryable> of a provider's status and body."""
    low = F.lower(F.coalesce(body, F.lit("")))
    has = lambda *words: F.greatest(*(F.contains(low, F.lit(w)) for w in words))
    bad = status.isin(400, 422)
    error = (
        F.when(status == 429, "rate_limit").when(status.isin(401, 403), "auth").when(status >= 500, "transient")
        .when(bad & has("context_length", "too many tokens", "maximum context"), "context_length").when(bad & has("content_filter", "content policy"), "content_filter").when(bad, "invalid_request").otherwise("unknown")
    )
    return F.struct(error.alias("error"), error.isin("rate_limit", "transient").alias("retryable"))


def request_fingerprint(requests: DataFrame) -> DataFrame:
    """(fingerprint, requests) of requests of temperature 0: a hash of their canonical JSON, keys in a fixed order. extra, JSON of what else can change a
    reply, is part of it where there is such a column; its keys are put in order, and none is the same as an empty object."""
    extra = F.coalesce(F.to_json(F.try_parse_json("extra")), "extra", F.lit("{}")) if "extra" in requests.columns else F.lit("{}")
    messages = F.transform("messages", lambda m: F.array(m["role"], m["content"]))
    shape = F.struct(extra.alias("extra"), "max_tokens", messages.alias("messages"), "model", F.coalesce("temperature", F.lit(0.0)).alias("temperature"))
    same = requests.filter(F.coalesce("temperature", F.lit(0.0)) == 0).select(F.sha2(F.to_json(shape, {"ignoreNullFields": "false"}), 256).alias("fingerprint"))
    return same.groupBy("fingerprint").agg(F.count("*").alias("requests"))


def active_emails(users: DataFrame) -> DataFrame:
    return users.filter("active").select("email").orderBy("email")


def group_by_domain(emails: DataFrame) -> DataFrame:
    """(domain, email): the first email (position, email) of each domain."""
    return emails.groupBy(F.get(F.split("email", "@"), 1).alias("domain")).agg(F.min_by("email", "position").alias("email"))
