"""SQL fragments for the independent check of each query (RE2 regular expressions)."""

from __future__ import annotations

from citeweave.functions.text import STOP_WORDS, symbol_table

SPACE = (
    r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}"
    r"\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
)


def quote(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def fold(t: str) -> str:
    """Symbol spelling and ASCII filter (the supplied text is already NFKC)."""
    out = f"replace({t}, 'μg', 'mcg')"
    for k, v in symbol_table().items():
        out = f"replace({out}, {quote(k)}, {quote(v)})"
    return rf"regexp_replace({out}, '[^\x00-\x7f]', '', 'g')"


def strip(t: str) -> str:
    return f"regexp_replace({t}, '^{SPACE}+|{SPACE}+$', '', 'g')"


def words(t: str) -> str:
    return f"list_filter(regexp_split_to_array({t}, '{SPACE}+'), lambda w: w <> '')"


def squash(t: str) -> str:
    return f"array_to_string({words(t)}, ' ')"


def sentences(t: str) -> str:
    cut = rf"string_split(regexp_replace({t}, '([.!?])\s+', '\1' || chr(1), 'g'), chr(1))"
    return f"list_filter(list_transform({cut}, lambda s: {strip('s')}), lambda s: s <> '')"


def claims(t: str) -> str:
    return f"list_filter({sentences(t)}, lambda c: len({words('c')}) >= 5)"


def claim_id(t: str) -> str:
    return f"substr(sha256({squash(f'lower({t})')}), 1, 16)"


def lexemes(t: str) -> str:
    stop = ", ".join(quote(w) for w in STOP_WORDS)
    return (
        rf"list_filter(regexp_extract_all(lower({t}), '\b\w\w+\b'), "
        f"lambda w: w NOT IN ({stop}))"
    )


def citations(t: str) -> str:
    return rf"list_sort(list_distinct(regexp_extract_all({t}, '@([\w-]+)', 1)))"


def match_key(t: str) -> str:
    return (
        rf"trim(regexp_replace(regexp_replace(lower({t}), '[^a-z0-9\s]', '', 'g'), "
        rf"'\s+', ' ', 'g'))"
    )


def exploded(src: str, key: str, listing: str, pos: str = "pos", item: str = "item") -> str:
    """Rows of a list with 0-based positions."""
    return (
        f"(SELECT {key}, i AS {pos}, l[i + 1] AS {item} FROM "
        f"(SELECT {key}, l, unnest(range(len(l))) AS i FROM "
        f"(SELECT {key}, {listing} AS l FROM {src})))"
    )
