"""Text normalisation, splitting and identifier functions as Spark columns."""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F

# --------------------------------------------------------------------------
# Fixed values (must equal the reference for right results)
# --------------------------------------------------------------------------
# Greek letters and their names; the final sigma has no entry, and a lone mu is written "u".
GREEK = {
    "α": "alpha", "β": "beta", "γ": "gamma", "δ": "delta", "ε": "epsilon", "ζ": "zeta", "η": "eta", "θ": "theta",
    "ι": "iota", "κ": "kappa", "λ": "lambda", "μ": "u", "ν": "nu", "ξ": "xi", "ο": "omicron", "π": "pi", "ρ": "rho",
    "σ": "sigma", "τ": "tau", "υ": "upsilon", "φ": "phi", "χ": "chi", "ψ": "psi", "ω": "omega",
    "Α": "Alpha", "Β": "Beta", "Γ": "Gamma", "Δ": "Delta", "Ε": "Epsilon", "Ζ": "Zeta", "Η": "Eta", "Θ": "Theta",
    "Ι": "Iota", "Κ": "Kappa", "Λ": "Lambda", "Μ": "Mu", "Ν": "Nu", "Ξ": "Xi", "Ο": "Omicron", "Π": "Pi", "Ρ": "Rho",
    "Σ": "Sigma", "Τ": "Tau", "Υ": "Upsilon", "Φ": "Phi", "Χ": "Chi", "Ψ": "Psi", "Ω": "Omega",
}
# Mu followed by g, a microgram, is "mcg".
MU_GRAM = "mcg"
# Symbols that survive compatibility normalisation, and their plain spelling.
SYMBOLS = {
    "±": "+/-", "≥": ">=", "≤": "<=", "×": "x", "°": "deg", "′": "'",
    "∞": "infinity", "≈": "~", "≠": "!=", "≡": "==",
    "–": "-", "—": "--", "‐": "-",
    "®": "(R)", "©": "(C)",
    "→": "->", "←": "<-", "↔": "<->", "·": ".", "÷": "/",
}
# --------------------------------------------------------------------------

# White space as Python's str.split() sees it.
SPACE = r"(?U)[\s\x1c-\x1f]"
SPACE_CHARS = "".join(chr(c) for c in range(0x3001) if chr(c).isspace())
SENTENCE_BREAK = r"(?<=[.!?])\s+"
CITATION = r"@([\w-]+)"

# Function words ignored by the lexical similarity; callers may pass another list.
STOP_WORDS = (
    "a about above after again against all also am an and any are as at be because been before "
    "being below between both but by can could did do does doing down during each few for from "
    "further had has have having he her here hers him his how i if in into is it its itself just "
    "me more most my no nor not now of off on once only or other our ours out over own same she "
    "should so some such than that the their theirs them then there these they this those through "
    "to too under until up very was we were what when where which while who whom why will with "
    "would you your yours"
).split()


@lru_cache(maxsize=1)
def symbol_table() -> dict[str, str]:
    """Plain spelling of every mapped character that can remain after normalisation."""
    return {**GREEK, **SYMBOLS}


def _escape(chars) -> str:
    """Body of a character class, with neighbouring code points joined into ranges."""
    codes = sorted(ord(c) for c in chars)
    runs: list[list[int]] = []
    for code in codes:
        if runs and code == runs[-1][1] + 1:
            runs[-1][1] = code
        else:
            runs.append([code, code])
    return "".join(
        f"\\x{{{a:x}}}" if a == b else f"\\x{{{a:x}}}-\\x{{{b:x}}}" for a, b in runs
    )


@lru_cache(maxsize=1)
def _compat_rules() -> tuple[dict[str, str], dict[str, str]]:
    """Characters whose NFKC form holds something that outlives the ASCII step.

    Derived from the Unicode database: one-character results can go through
    ``translate``; longer ones are replaced one by one.
    """
    keep = set(symbol_table())
    single: dict[str, str] = {}
    multi: dict[str, str] = {}
    for code in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= code <= 0xDFFF:
            continue
        ch = chr(code)
        norm = unicodedata.normalize("NFKC", ch)
        if norm == ch:
            continue
        if any(c in keep or ord(c) < 128 or unicodedata.combining(c) for c in norm):
            (single if len(norm) == 1 else multi)[ch] = norm
    return single, multi


@lru_cache(maxsize=1)
def _composition() -> tuple[str, str, dict[str, str]]:
    """Regular expressions for what canonical composition does to a base and its marks.

    A mark composes when it is the first of its combining class after the base. The
    first pattern matches marks that are not; the second a base that merges into a
    letter outside ASCII and outside the symbol table, which is dropped as a whole;
    the table holds the few merges that give a mapped symbol. Covers the combining
    blocks used with Latin and Greek letters.
    """
    blocks = [(0x300, 0x370), (0x1AB0, 0x1B00), (0x1DC0, 0x1E00), (0x20D0, 0x2100)]
    marks = [
        chr(c) for lo, hi in blocks for c in range(lo, hi)
        if unicodedata.combining(chr(c)) and unicodedata.normalize("NFKC", chr(c)) == chr(c)
    ]
    bases = [chr(c) for c in range(0x21, 0x7F)] + sorted(symbol_table())
    every = _escape(marks)
    later, gone, symbols = [], [], {}
    for cls in sorted({unicodedata.combining(m) for m in marks}):
        members = [m for m in marks if unicodedata.combining(m) == cls]
        rules = []
        for mark in members:
            merged = {b: unicodedata.normalize("NFC", b + mark) for b in bases}
            lost = [b for b, m in merged.items() if len(m) == 1 and m not in symbol_table()]
            if lost:
                rules.append(f"[{_escape(lost)}](?=[{every}]*{_escape(mark)})")
            for base, m in merged.items():
                if m in symbol_table():
                    symbols[f"[{_escape(base)}](?=[{every}]*{_escape(mark)})"] = m
                    rules.append("")
        if rules:
            k = _escape(members)
            later.append(f"(?<=[{k}][[{every}]&&[^{k}]]{{0,40}})[{k}]")
            gone.extend(r for r in rules if r)
    return "|".join(later), "|".join(gone), symbols


def _replace_all(text: Column, table: dict[str, str]) -> Column:
    def listing(items, name: str) -> Column:
        return F.split(F.lit("\x01".join(items)), "\x01").alias(name)

    pairs = F.arrays_zip(listing(table, "k"), listing(table.values(), "v"))
    return F.aggregate(pairs, text, lambda acc, p: F.replace(acc, p["k"], p["v"]))


def ascii_fold(text: Column) -> Column:
    """Compatibility-normalise, spell out symbols, then drop whatever is not ASCII.

    Equal to NFKC + symbol table + ASCII filter, but built from JVM expressions
    only. Rows made of ASCII and plain accented letters skip the table work.
    """
    single, multi = _compat_rules()
    symbols = symbol_table()
    compat = F.when(
        text.rlike(f"[{_escape(multi)}]"), _replace_all(text, multi)
    ).otherwise(text)
    compat = F.translate(compat, "".join(single), "".join(single.values()))
    later, gone, composed = _composition()
    compat = F.regexp_replace(compat, later, "")
    for pattern, symbol in composed.items():
        compat = F.regexp_replace(compat, pattern, symbol)
    merged = F.regexp_replace(compat, gone, "")
    spelled = _replace_all(merged, {"μg": MU_GRAM, **symbols})
    # Narrow classes only: the JVM scans one- and two-range classes many times faster.
    special = (
        text.rlike(r"[^\x00-\x7f\x{c0}-\x{ff}]")
        | F.contains(text, F.lit("×")) | F.contains(text, F.lit("÷"))
    )
    return F.when(F.length(text) == F.octet_length(text), text).otherwise(
        F.regexp_replace(F.when(special, spelled).otherwise(text), r"[^\x00-\x7f]+", "")
    )


def final_scrub(text: Column) -> Column:
    """Null-safe trim plus :func:`ascii_fold`."""
    return ascii_fold(strip(F.coalesce(text, F.lit(""))))


def caption_scrub(text: Column) -> Column:
    """Drop non-ASCII characters and every question mark."""
    return F.regexp_replace(text, r"[^\x00-\x7f]|\?", "")


def strip(text: Column) -> Column:
    """Trim all white space at both ends."""
    return F.btrim(text, F.lit(SPACE_CHARS))


def drop_thinking(text: Column) -> Column:
    """Remove hidden reasoning blocks."""
    return strip(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""))


def words(text: Column) -> Column:
    """White-space tokens, case and punctuation kept."""
    return F.filter(F.split(text, SPACE + "+"), lambda w: w != "")


def squash(text: Column) -> Column:
    """Collapse white space to single blanks."""
    return F.array_join(words(text), " ")


def lexemes(text: Column, stop: list[str] | None = None) -> Column:
    """Lower-case word tokens of two or more characters, without function words."""
    tokens = F.regexp_extract_all(F.lower(text), F.lit(r"\b\w\w+\b"), F.lit(0))
    block = STOP_WORDS if stop is None else stop
    return F.filter(tokens, lambda w: ~w.isin(block)) if block else tokens


def sentences(text: Column) -> Column:
    """Trimmed, non-empty sentences in order."""
    return F.filter(
        F.transform(F.split(text, SENTENCE_BREAK), strip), lambda s: s != ""
    )


def claims(text: Column, min_words: int = 5) -> Column:
    """Sentences long enough to state something checkable."""
    return F.filter(sentences(text), lambda s: F.size(words(s)) >= min_words)


def claim_id(text: Column) -> Column:
    """First 16 hex digits of the digest of the lower-cased, space-squashed claim."""
    return F.substring(F.sha2(squash(F.lower(text)), 256), 1, 16)


def citations(text: Column) -> Column:
    """Sorted distinct citation keys."""
    return F.array_sort(F.array_distinct(F.regexp_extract_all(text, F.lit(CITATION), F.lit(1))))


def match_key(text: Column) -> Column:
    """Lower-case letters, digits and single blanks only."""
    kept = F.regexp_replace(F.lower(text), r"[^a-z0-9\s]", "")
    return F.trim(F.regexp_replace(kept, r"\s+", " "))


def jaccard(a: Column, b: Column) -> Column:
    """Share of common distinct tokens; 0 when both are empty."""
    union = F.size(F.array_union(a, b))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / union)


def lines(text: Column) -> Column:
    """Structs ``(raw, text)``: trimmed non-blank lines, as written and ASCII-folded.

    Folding never adds or removes a line break, so it runs once over the whole text.
    """
    tidy = strip(F.regexp_replace(text, f"{SPACE}*\n{SPACE}*", "\n"))
    both = F.arrays_zip(
        F.split(tidy, "\n").alias("raw"), F.split(ascii_fold(tidy), "\n").alias("text")
    )
    return F.when(tidy == "", F.slice(both, 1, 0)).otherwise(both)


def chunk_kind(text: Column) -> Column:
    """``reference`` for bracket-numbered bibliography lines, else ``text``."""
    return F.when(text.rlike(r"^\s*(-\s*)?\[\d+\]"), "reference").otherwise("text")


def prompt_line(index: Column, source: Column, text: Column) -> Column:
    """One numbered context line: ``[Chunk i | source] text``."""
    return F.concat(
        F.lit("[Chunk "), index.cast("string"), F.lit(" | "),
        F.coalesce(source, F.lit("?")), F.lit("] "), squash(text),
    )


def token_estimate(text: Column) -> Column:
    """Offline token counter: one token per word or punctuation run."""
    return F.size(F.regexp_extract_all(text, F.lit(r"\w+|[^\w\s]+"), F.lit(0)))


def combine_evidence(a: Column, b: Column) -> Column:
    """Union of two ` | `-joined evidence strings, longest piece first."""
    def pieces(c: Column) -> Column:
        return F.filter(F.transform(F.split(c, r" \| "), strip), lambda p: p != "")

    both = F.array_union(pieces(a), pieces(b))
    keyed = F.array_sort(F.transform(both, lambda p: F.struct((-F.length(p)).alias("n"), p.alias("p"))))
    joined = F.array_join(F.transform(keyed, lambda s: s["p"]), " | ")
    return (
        F.when(F.coalesce(a, F.lit("")) == "", b)
        .when(F.coalesce(b, F.lit("")) == "", a)
        .otherwise(joined)
    )


def source_numbers(src: Column) -> Column:
    """Chunk numbers named by a source tag such as ``Chunk 3,7 | paper``."""
    head = F.replace(F.element_at(F.split(src, r" \| "), 1), F.lit("Chunk "), F.lit(""))
    parsed = F.transform(F.split(head, r"[,;\s]+"), lambda p: p.try_cast("int"))
    return F.filter(parsed, lambda n: n.isNotNull())


def source_paper(src: Column) -> Column:
    """Paper named by a source tag, or the tag itself when it has no separator."""
    at = F.instr(src, " | ")
    return strip(F.when(at > 0, F.substring(src, at + 3, F.length(src))).otherwise(src))


def union_sources(a: Column, b: Column) -> Column:
    """Merge two source tags: union of chunk numbers, first known paper."""
    nums = F.array_sort(F.array_union(source_numbers(a), source_numbers(b)))
    paper = F.when(source_paper(a) != "", source_paper(a)).otherwise(source_paper(b))
    head = F.concat(F.lit("Chunk "), F.array_join(nums.cast("array<string>"), ","))
    return (
        F.when(F.coalesce(a, F.lit("")) == "", b)
        .when(F.coalesce(b, F.lit("")) == "", a)
        .when(paper != "", F.concat(head, F.lit(" | "), paper))
        .otherwise(head)
    )


def source_index(src: Column) -> Column:
    """First chunk number of a source tag, null when there is none."""
    return F.try_element_at(source_numbers(src), F.lit(1))


def short_digest(text: Column) -> Column:
    """16 hex digits of SHA-256, used for audit-safe query identifiers."""
    return F.substring(F.sha2(text, 256), 1, 16)


def doi_key(doi: Column) -> Column:
    """Lower-cased, trimmed DOI."""
    return F.lower(strip(F.coalesce(doi, F.lit(""))))


def bare_doi(doi: Column) -> Column:
    """DOI without URL or scheme prefixes and without slashes at its ends."""
    prefixes = F.array(*[F.lit(p) for p in ("https://doi.org/", "http://doi.org/", "doi:", "doi.org/")])
    out = F.aggregate(prefixes, doi_key(doi), lambda d, p: F.when(
        F.startswith(d, p), F.substring(d, F.length(p) + 1, F.length(d))).otherwise(d))
    return F.regexp_replace(out, r"^/+|/+$", "")


def find_doi(text: Column) -> Column:
    """First DOI inside a free-form identifier, null when none."""
    hit = F.regexp_extract(text, r"(10\.\d{4,}/[^\s\"']+)", 1)
    return F.when(hit != "", hit)


def _trim(text: Column) -> Column:
    return F.regexp_replace(text, r"^[ \n]+|[ \n]+$", "")


def json_object(text: Column) -> Column:
    """The first JSON object that a model's answer holds, as text; null if there is none.

    Think blocks go first. Then the whole answer is tried, each part between code
    fences (a leading "json" dropped), and what lies between the first opening and
    the last closing brace.
    """
    bare = _trim(F.regexp_replace(text, r"(?s)<think>.*?</think>", ""))
    fenced = F.transform(F.split(bare, "```", -1), lambda s: _trim(F.regexp_replace(_trim(s), r"^(?i:json)", "")))
    start = F.locate("{", bare)
    length = F.length(bare) - F.locate("}", F.reverse(bare)) + 2 - start
    braces = F.when((start > 0) & (F.locate("}", bare) > 0) & (length > 1), F.substring(bare, start, length))
    tried = F.concat(F.array(bare), F.when(F.contains(bare, F.lit("```")), fenced).otherwise(F.array().cast("array<string>")), F.array(braces))
    good = F.filter(tried, lambda s: F.startswith(s, F.lit("{")) & F.try_parse_json(s).isNotNull())
    return F.try_element_at(good, F.lit(1))
