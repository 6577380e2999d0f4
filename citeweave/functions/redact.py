"""Redaction of sensitive spans as an ordered chain of JVM regular expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Rule:
    """A pattern, its replacement, and what every match contains: one of some literals, or a digit.

    A rule that declares neither is applied to every text.
    """

    label: str
    pattern: str
    replacement: str
    hints: tuple[str, ...] = ()
    digit: bool = False


# Built-in patterns in the order in which they apply.
BOUNDARY = [
    Rule("MRN", r"\bMR[#\s]*\d{6,12}\b", "[REDACTED-MRN]", ("MR",)),
    Rule("SSN", r"\b\d{3}[-\s]?\d{2}[-\s]?\d{4}\b", "[REDACTED-SSN]", digit=True),
    Rule("DOB", r"\bDOB:?\s*\d{1,2}[/-]\d{1,2}[/-]\d{2,4}\b", "[REDACTED-DOB]", ("DOB",)),
    Rule("DOB2", r"\bDOB:?\s*\d{4}[-/]\d{1,2}[-/]\d{1,2}\b", "[REDACTED-DOB]", ("DOB",)),
    Rule("EMAIL", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", "[REDACTED-EMAIL]", ("@",)),
    Rule("PHONE", r"\b(\+?1[-.\s]?)?\(?\d{3}\)?[-.\s]?\d{3}[-.\s]?\d{4}\b", "[REDACTED-PHONE]", digit=True),
    Rule("IPV4", r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "[REDACTED-IP]", digit=True),
    Rule("API_KEY", r"\b(sk|pk|api)[-_][a-zA-Z0-9_-]{20,}\b", "[REDACTED-KEY]",
         ("sk-", "sk_", "pk-", "pk_", "api-", "api_")),
    Rule("GRANT", r"\b[RUK]\d{2}[A-Z]{2}\d{6}\b", "[REDACTED-GRANT]", digit=True),
    Rule("GRANT2", r"\bGrant\s*#?\s*[A-Z0-9]+-\d{4,}\b", "[REDACTED-GRANT]", ("Grant",)),
    Rule("HOSPITAL", r"\b\w+\s+(Hospital|Medical Center|Clinic|Infirmary)\b", "[REDACTED-FACILITY]",
         ("Hospital", "Medical Center", "Clinic", "Infirmary")),
    Rule("PROJ_CODE", r"\bPROJ[-\s]?\d{4}[-\s]?\d{3}\b", "[REDACTED-PROJECT]", ("PROJ",)),
]

# Site-specific identifiers, all replaced by one plain tag.
SITE_TAG = "[REDACTED]"
SITE_PATTERNS = [
    r"CMPD-\d{4,6}",
    r"DRUG-\d{3,5}[A-Z]?",
    r"p[A-Z]{2,4}\d{2,5}",
    r"PLASMID-\d{3,5}",
    r"PROJ[-\s]?\d{4}[-\s]?\d{3,4}",
    r"IACUC-\d{4}-\d{4}",
    r"PROTOCOL-\d{3,5}",
    r"IRB-\d{4,8}",
    r"FUND-\d{4,6}",
    r"SPECIMEN-\d{5,8}",
    r"BIOBANK-\d{4,6}",
]
SITE = [Rule(f"SITE{i}", p, SITE_TAG, digit=True) for i, p in enumerate(SITE_PATTERNS)]


def custom_rules(lines: list[str]) -> list[Rule]:
    """User rules from the lines of a pattern file; blanks and comments are skipped."""
    kept = [ln.strip() for ln in lines]
    return [Rule(f"CUSTOM{i}", p, SITE_TAG) for i, p in enumerate(kept) if p and not p.startswith("#")]


def _applies(text: Column, rule: Rule) -> Column:
    if rule.hints:
        hit = F.contains(text, F.lit(rule.hints[0]))
        for h in rule.hints[1:]:
            hit = hit | F.contains(text, F.lit(h))
        return hit
    return text.rlike(r"\d") if rule.digit else F.lit(True)


def redact(df: DataFrame, text: str, rules: list[Rule], out: str, count: str, per_rule: bool = False) -> DataFrame:
    """Apply ``rules`` in order to ``text`` (already ASCII-folded).

    Adds the clean text, the number of substitutions and, on request, one count
    per rule. One projection per rule keeps the earlier text evaluated once; the
    cheap literal test spares most rows the regular expression.
    """
    keep = df.columns
    step = df.select(*keep, F.col(text).alias("_t"), F.lit(0).alias("_n"))
    done: list[str] = []
    for rule in rules:
        # Bound to a lambda variable, the text occurs once per step however plans are merged.
        nxt = F.get(F.transform(F.array("_t"), lambda t: F.when(
            _applies(t, rule), F.regexp_replace(t, rule.pattern, rule.replacement)).otherwise(t)), 0)
        step = step.select(*keep, *done, "_t", "_n", nxt.alias("_u"))
        hits = F.when(F.col("_u") != F.col("_t"), F.regexp_count("_t", F.lit(rule.pattern))).otherwise(0)
        name = f"n_{rule.label.lower()}"
        extra = [hits.alias(name)] if per_rule else []
        step = step.select(*keep, *done, *extra, F.col("_u").alias("_t"), (F.col("_n") + hits).alias("_n"))
        if per_rule:
            done.append(name)
    return step.select(*keep, *done, F.col("_t").alias(out), F.col("_n").alias(count))


def mask_spans(text: Column, spans: Column) -> Column:
    """Replace ``spans(start, end, label)`` (0-based, end exclusive) by ``[REDACTED-LABEL]``.

    Overlapping spans are one span under the label of the first. Spans are applied
    from right to left, so earlier offsets stay valid.
    """
    nothing = F.slice(spans, 1, 0)

    def merge(acc, s):
        last = F.element_at(acc, -1)
        longer = F.struct(last["start"].alias("start"), F.greatest(last["end"], s["end"]).alias("end"), last["label"].alias("label"))
        return F.when(F.size(acc) == 0, F.array(s)).when(
            s["start"] < last["end"], F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(longer))).otherwise(F.concat(acc, F.array(s)))

    ordered = F.reverse(F.aggregate(F.array_sort(spans), nothing, merge))
    return F.aggregate(
        ordered, text,
        lambda acc, s: F.concat(
            F.substring(acc, F.lit(1), s["start"]), F.lit("[REDACTED-"), F.upper(s["label"]), F.lit("]"),
            F.substring(acc, s["end"] + 1, F.length(acc))),
    )
