"""Template column builders: masking, ids, regexes, signatures."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import patterns as P
from .text import col_

# Escape class for the template escaper, valid in both Java and RE2.
ESCAPE_CLASS = "[()\\[\\]{}?*+\\-|^$\\\\.&~# \\t\\n\\r\\x0B\\f]"


def mask(c, preset: str = "basic") -> Column:
    """M2/M3: ordered regex substitution of variable tokens by placeholders."""
    rules = P.MASK_RULES_BASIC if preset == "basic" else P.MASK_RULES_FULL
    out = col_(c)
    for pat, ph in rules:
        out = F.regexp_replace(out, P.to_java(pat), ph)
    return out


def token_seq(c) -> Column:
    """M9: ``token_seq:`` + first 8 placeholders, grouped by rule order."""
    cur = col_(c)
    pieces = []
    for pat, ph in P.MASK_RULES_BASIC:
        jp = P.to_java(pat)
        pieces.append(F.array_repeat(F.lit(ph), F.size(F.regexp_extract_all(cur, F.lit(jp), 0))))
        cur = F.regexp_replace(cur, jp, ph)
    seq = F.slice(F.concat(*pieces), 1, P.TOKEN_SEQ_MAX)
    return F.concat(F.lit("token_seq:"), F.array_join(seq, ","))


def template_id(c) -> Column:
    """M5: first 8 bytes of SHA-1 of the template text, as 16 hex chars."""
    return F.substring(F.sha1(col_(c)), 1, 16)


def template_version(template, regex) -> Column:
    """First 16 hex chars of SHA-1(template + newline + regex)."""
    return F.substring(F.sha1(F.concat(col_(template), F.lit("\n"), col_(regex))), 1, 16)


def escape_template(c) -> Column:
    return F.regexp_replace(col_(c), ESCAPE_CLASS, "\\\\$0")


def _escaped(ph: str) -> str:
    return "".join("\\" + ch if ch in P.ESCAPE_CHARS else ch for ch in ph)


def template_regex(c, profile: str = "code") -> Column:
    """M6/M7: escape the template, then placeholders -> regexes.

    ``code``: the placeholder table of the current miner; other placeholders
    stay literal. ``full``: every known placeholder becomes
    ``(?:<name>|typed)`` so the regex matches both raw lines and lines whose
    values were already replaced by placeholders (redacted/masked text).
    """
    # Spaces end up unescaped, so they are not escaped.
    out = F.regexp_replace(col_(c), ESCAPE_CLASS.replace(" ", ""), "\\\\$0")
    if profile == "code":
        for ph, rx in P.TEMPLATE_REGEX_CODE:
            out = F.replace(out, F.lit(_escaped(ph)), F.lit(rx))
    else:
        table = dict(P.TEMPLATE_REGEX_CODE)
        for k, v in P.TEMPLATE_REGEX_OLD.items():
            table.setdefault(k, v)
        for ph, rx in table.items():
            alt = rx if ph == "<*>" else f"(?:{ph}|{rx})"
            out = F.replace(out, F.lit(_escaped(ph)), F.lit(alt))
    return F.replace(out, F.lit("\\="), F.lit("="))


def group_signature(c) -> Column:
    """M8: whitespace tokens typed uuid/ipv4/hex/num/w, first 20, space-joined."""
    toks = F.filter(F.split(F.trim(col_(c)), "[\\t\\n\\f\\r \\x0B]+"), lambda t: F.length(t) > 0)
    toks = F.slice(toks, 1, P.SIGNATURE_MAX_TOKENS)

    def kind(t):
        e = F.when(F.lit(False), F.lit(None))
        for name, pat in P.SIGNATURE_RULES:
            e = e.when(t.rlike(P.to_java(pat)), F.lit(name))
        return e.otherwise(F.lit("w"))

    return F.array_join(F.transform(toks, kind), " ")
