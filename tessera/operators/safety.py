"""Scans and masks of untrusted text; rules are data, checks are Spark expressions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessera.functions.rules import AGENT_INJECTION, LOG_MASKS, PII, SECRET_SHAPES, SERVICE_INJECTION, UNTRUSTED_NOTE, UNTRUSTED_WARNING


def injection_findings(text: Column, rules=AGENT_INJECTION) -> Column:
    """array<struct<rule, category, matched, excerpt>>: the first match of each pattern, with 30 characters on either side."""
    found = []
    for i, (pattern, category) in enumerate(rules):
        whole = f"(?isU){pattern}"
        match, at = F.regexp_extract(text, f"(?isU)({pattern})", 1), F.regexp_instr(text, F.lit(whole))
        start = F.greatest(at - 30, F.lit(1))
        excerpt = F.replace(F.substr(text, start, at - start + F.length(match) + 30), F.lit("\n"), F.lit(" "))
        found.append(F.when(text.rlike(whole), F.struct(F.lit(i).alias("rule"), F.lit(category).alias("category"), F.substring(match, 1, 100).alias("matched"), excerpt.alias("excerpt"))))
    return F.array_compact(F.array(*found))


def injection_scan(texts: DataFrame, key: str, rules=AGENT_INJECTION) -> DataFrame:
    """(key, rule, category, matched, excerpt): a row per pattern that matches."""
    return texts.select(key, F.explode(injection_findings(F.col("text"), rules)).alias("f")).select(key, "f.*")


def categories(text: Column, rules) -> Column:
    """Sorted distinct categories of the patterns that match."""
    return F.array_sort(F.array_distinct(F.array_compact(F.array(*(F.when(text.rlike(f"(?isU){p}"), F.lit(c)) for p, c in rules)))))


def injection_categories(text: Column) -> Column:
    return categories(text, SERVICE_INJECTION)


def neutralize(text: Column, found: Column | None = None) -> Column:
    """The text in an envelope that names the categories found; a clean text as it is."""
    found = categories(text, AGENT_INJECTION) if found is None else found
    before, after = UNTRUSTED_WARNING.split("{}")
    wrapped = F.concat(F.lit(f"<untrusted_content>\n{before}"), F.array_join(found, ", "), F.lit(f"{after}\n\n"), text, F.lit("\n</untrusted_content>"))
    return F.when(F.size(found) > 0, wrapped).otherwise(text)


def wrap_untrusted(text: Column) -> Column:
    return F.concat(F.lit(f"<untrusted_input>\n{UNTRUSTED_NOTE}\n\n"), text, F.lit("\n</untrusted_input>"))


def scan_tool_outputs(outputs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """outputs (call_id, tool, ok, content) with suspicious contents of successful calls neutralized; audit rows (call_id, tool, decision, reason)."""
    found = F.when(F.col("ok") & (F.coalesce("content", F.lit("")) != ""), categories(F.col("content"), AGENT_INJECTION)).otherwise(F.array().cast("array<string>"))
    scanned = outputs.withColumn("found", found)
    safe = scanned.withColumn("content", F.when(F.size("found") > 0, neutralize(F.col("content"), F.col("found"))).otherwise(F.col("content")))
    audit = scanned.filter(F.size("found") > 0).select("call_id", "tool", F.lit("blocked").alias("decision"), F.concat(F.lit("injection in output: "), F.array_join("found", ", ")).alias("reason"))
    return safe.withColumn("blocked", F.size("found") > 0).drop("found"), audit


def luhn_valid(text: Column) -> Column:
    """Whether the digits of a text number 13 to 19 and pass the Luhn check."""
    digits = F.regexp_replace(text, r"\D", "")
    n = F.length(digits)
    each = F.transform(F.split(digits, ""), lambda d: F.coalesce(d.try_cast("int"), F.lit(0)))
    doubled = F.transform(each, lambda d, i: F.when((n - i) % 2 == 0, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d))
    return n.between(13, 19) & (F.aggregate(doubled, F.lit(0), lambda s, d: s + d) % 10 == 0)


def _java(pattern: str) -> str:
    return f"(?U){pattern}"


def _is_card(number: str) -> bool:
    digits = [int(c) for c in number if c.isdigit()]
    doubled = [d if (len(digits) - i) % 2 else sum(divmod(2 * d, 10)) for i, d in enumerate(digits)]
    return 13 <= len(digits) <= 19 and sum(doubled) % 10 == 0


@F.pandas_udf(T.StructType([T.StructField("text", T.StringType()), T.StructField("cards", T.IntegerType())]))
def _mask_cards(text: pd.Series) -> pd.DataFrame:
    """Card-like numbers that pass the Luhn check, masked: each match is judged on its own, so this can't be one expression."""
    pattern = re.compile(dict(PII)["credit_card"])
    rows = []
    for t in text:
        n = 0

        def mask(match: re.Match) -> str:
            nonlocal n
            if not _is_card(match[0]):
                return match[0]
            n += 1
            return "[CREDIT_CARD]"

        rows.append((None, 0) if t is None else (pattern.sub(mask, t), n))
    return pd.DataFrame(rows, columns=["text", "cards"])


def pii_redact(texts: DataFrame, key: str) -> DataFrame:
    """(key, text, counts map<string,int>): masked in order, kinds found counted. Only texts with a card-like number reach Python."""
    kinds = dict(PII)
    likely = F.coalesce(F.col("text").rlike(_java(kinds["credit_card"])), F.lit(False))  # masks before it only take digits away
    both = texts.select(key, "text", likely.alias("likely"))

    def mask(rows: DataFrame, kind: str) -> DataFrame:
        return rows.withColumn(kind, F.regexp_count("text", F.lit(_java(kinds[kind])))).withColumn("text", F.regexp_replace("text", _java(kinds[kind]), f"[{kind.upper()}]"))

    for kind in ("email", "ssn", "ip"):
        both = mask(both, kind)
    both = both.withColumn("m", _mask_cards(F.when(F.col("likely"), F.col("text"))))
    both = both.withColumn("text", F.when(F.col("likely"), F.col("m.text")).otherwise(F.col("text"))).withColumn("credit_card", F.col("m.cards"))
    both = mask(both, "phone")
    every = F.create_map(*(x for k in kinds for x in (F.lit(k), F.col(k))))
    return both.select(key, "text", F.map_filter(every, lambda _, n: n > 0).alias("counts"))


def log_redact(text: Column) -> Column:
    for label, pattern in LOG_MASKS:
        text = F.regexp_replace(text, _java(pattern), f"[{label}]")
    return text


def mask_key(key: Column) -> Column:
    return F.when(F.length(key) <= 6, F.lit("***")).otherwise(F.concat(F.substring(key, 1, 4), F.lit("..."), F.right(key, F.lit(2))))


def secret_scan(text: Column) -> Column:
    """Names of the secret shapes that occur."""
    return F.array_compact(F.array(*(F.when(text.rlike(p), F.lit(name)) for name, p in SECRET_SHAPES)))
