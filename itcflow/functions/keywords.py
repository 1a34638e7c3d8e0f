"""Ordered keyword rules as column expressions.

A rule list is (label, keywords) groups tested in order; a group fires when
any keyword is a substring of the lower-cased text; the first firing group
wins. Each group compiles to one regex alternation of quoted literals, so a
text is scanned once per group in the JVM; the ``CASE`` stops at the first
group that fires.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import fixed


_META = set("\\.[]{}()*+?^$|#&~-")


def _esc(ch: str) -> str:
    return "\\" + ch if ch in _META else ch


def trie_regex(words: list[str]) -> str:
    """One regex that matches where any of ``words`` starts, shaped as a
    prefix trie: at each text position the engine follows one branch per
    next character instead of trying every keyword. A keyword that is a
    prefix of others ends its branch (for an existence test the longer
    keywords add nothing)."""
    root: dict = {}
    for w in words:
        node = root
        for ch in w:
            if "" in node:
                break
            node = node.setdefault(ch, {})
        else:
            node.clear()
            node[""] = True

    def emit(node: dict) -> str:
        if "" in node:
            return ""
        alts = [_esc(ch) + emit(child) for ch, child in sorted(node.items())]
        return alts[0] if len(alts) == 1 else "(?:" + "|".join(alts) + ")"

    return emit(root)


def any_of(text: Column, words: list[str], match: str = "substring") -> Column:
    """True when any word occurs in ``text`` (already lower-cased).

    ``substring`` reproduces the application (``'mi' in 'milk'`` is a hit);
    ``word`` requires word boundaries around the keyword.
    """
    if match == "word":
        alts = "|".join(r"\Q" + w + r"\E" for w in words)
        return text.rlike(r"(?<![a-z0-9])(?:" + alts + r")(?![a-z0-9])")
    return text.rlike(trie_regex(words))


def first_group(text: Column, rules, default, match: str = "substring") -> Column:
    """Label of the first group that fires, else ``default``."""
    expr = None
    for label, words in rules:
        cond = any_of(text, words, match)
        expr = F.when(cond, F.lit(label)) if expr is None else expr.when(cond, F.lit(label))
    return expr.otherwise(default if isinstance(default, Column) else F.lit(default))


def matched_words(text: Column, label: Column, rules) -> Column:
    """The keywords of the group ``label`` that occur in ``text`` (lower-cased),
    in list order: one literal test per keyword of that group only."""
    pairs = [x for lab, words in rules for x in (F.lit(lab), F.array(*[F.lit(w) for w in words]))]
    words = F.element_at(F.create_map(*pairs), label)
    return F.coalesce(F.filter(words, lambda w: F.contains(text, w)), F.array().cast("array<string>"))


def keyword_category(desc: Column, match: str = "substring") -> Column:
    """F8 category of a description, 'Other' when no group fires."""
    return first_group(F.lower(desc), fixed.KEYWORD_RULES, "Other", match)


def detect_bank(text: Column) -> Column:
    """bank of a statement from its page text, 'GENERIC' otherwise."""
    return first_group(F.lower(text), fixed.BANK_DETECTION, fixed.GENERIC_BANK)


def bank_category(desc: Column) -> Column:
    """F16: narration category, 'other' when no group fires."""
    return first_group(F.lower(desc), fixed.BANK_CATEGORIES, "other")


def sql_contains_any(col_sql: str, words: list[str]) -> str:
    """The same test as DuckDB/ANSI SQL text (for oracles)."""
    return "(" + " OR ".join(f"contains({col_sql}, '{w.replace(chr(39), chr(39) * 2)}')" for w in words) + ")"


def sql_first_group(col_sql: str, rules, default: str) -> str:
    whens = " ".join(f"WHEN {sql_contains_any(col_sql, ws)} THEN '{lab}'" for lab, ws in rules)
    return f"CASE {whens} ELSE '{default}' END"