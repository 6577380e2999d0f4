"""Text that goes into prompts and reports, and labels for people to read."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from citeweave.functions import text as T

LABEL_MIN = 4
PRINT_WORDS, PRINT_MIN = 8, 5


def plain_key(text: Column) -> Column:
    """A key that is safe in a header: neither question marks nor anything outside ASCII."""
    return F.regexp_replace(text, r"[^\x00-\x7f]|\?", "")


def node_label(node_id: Column) -> Column:
    """The name in a node id: without the paper before "::" and the type before ":".

    A name under four characters keeps the part before it.
    """
    bare = F.when(F.contains(node_id, F.lit("::")), F.regexp_replace(node_id, r"(?s)^.*?::", "")).otherwise(node_id)
    last = T.strip(F.substring_index(bare, ":", -1))
    return F.when(~F.contains(bare, F.lit(":")), bare).when(F.length(last) < LABEL_MIN, F.substring_index(bare, ":", -2)).otherwise(last)


def claim_prints(answer: Column) -> Column:
    """What tells the claims of an answer apart: their first eight words, or all of a short one."""
    def one(claim: Column) -> Column:
        low = F.lower(claim)
        w = T.words(low)
        return F.when(F.size(w) >= PRINT_MIN, F.array_join(F.slice(w, 1, PRINT_WORDS), " ")).otherwise(low)

    return F.array_distinct(F.transform(T.claims(answer), one))


def consistency(first: Column, second: Column) -> Column:
    """Share of claims that two answers have in common, four digits; 0 without claims."""
    a, b = claim_prints(first), claim_prints(second)
    return F.round(F.size(F.array_intersect(a, b)) / F.greatest(F.size(F.array_union(a, b)), F.lit(1)), 4)
