"""Pattern tables.

Patterns are written once in RE2 syntax (what the SQL oracle in DuckDB runs
verbatim) and translated mechanically to Java syntax for Spark by
``to_java``: RE2's ``\\b`` and ``\\s`` are ASCII-only, while Java's ``\\b``
is Unicode-aware and Java's ``\\s`` includes vertical tab. ``\\d`` and
``\\w`` are ASCII in both engines.
"""

from __future__ import annotations

# ---------------------------------------------------------------------------
# FIXED VALUES — must equal the behaviour being reproduced; do not edit.
# ---------------------------------------------------------------------------

# PII redaction rules in application order: (rule name, RE2 pattern).
# Each rule runs on the output of the previous one; placeholder is <name>.
REDACTION_RULES: list[tuple[str, str]] = [
    ("uuid", r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-4[0-9a-fA-F]{3}-[89abAB][0-9a-fA-F]{3}-[0-9a-fA-F]{12}\b"),
    ("ipv6", r"\b(?:[0-9a-fA-F]{1,4}:){7}[0-9a-fA-F]{1,4}\b"),
    ("ipv4", r"\b(?:(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\.){3}(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)\b"),
    ("email", r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Z|a-z]{2,}\b"),
    ("cc", r"\b(?:\d{4}[-\s]?){3}\d{4}\b"),
    ("phone", r"\b\+?[1-9]\d{1,14}\b"),
    ("url", r"https?://[^\s]+"),
]

# Extra rules of the "intended" profile (any-version UUID, punctuated phone),
# placed where the code profile has its narrower variants.
INTENDED_OVERRIDES: dict[str, str] = {
    "uuid": r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b",
    "phone": r"\+?\b[1-9]\d{0,3}(?:[-. ]\d{2,4}){1,4}\b|\b\+?[1-9]\d{1,14}\b",
}

# Masking template (ordered regex substitution): (RE2 pattern, placeholder).
MASK_RULES_BASIC: list[tuple[str, str]] = [
    (r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[1-5][0-9a-fA-F]{3}-[89abAB][0-9a-fA-F]{3}-[0-9a-fA-F]{12}\b", "<uuid>"),
    (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "<ipv4>"),
    (r"\b\d+\b", "<int>"),
]

# Extended masking set, most specific first: ts, url, email, uuid, ip, path,
# hex, float, int.
MASK_RULES_FULL: list[tuple[str, str]] = [
    (r"\b\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}:\d{2}(?:\.\d+)?(?:Z|[+-]\d{2}:?\d{2})?\b", "<ts>"),
    (r"https?://[^\s]+", "<url>"),
    (r"\b[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}\b", "<email>"),
    (r"\b[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}\b", "<uuid>"),
    (r"\b(?:\d{1,3}\.){3}\d{1,3}\b", "<ip>"),
    (r"(?:/[A-Za-z0-9._-]+){2,}", "<path>"),
    (r"\b0x[0-9a-fA-F]+\b", "<hex>"),
    (r"\b\d+\.\d+\b", "<float>"),
    (r"\b\d+\b", "<int>"),
]

# Token-type tests for the group signature; first test that *searches* true.
SIGNATURE_RULES: list[tuple[str, str]] = [
    ("uuid", r"\b[0-9a-fA-F]{8}\b-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-\b[0-9a-fA-F]{12}\b"),
    ("ipv4", r"\b(?:\d{1,3}\.){3}\d{1,3}\b"),
    ("hex", r"\b0x[0-9a-fA-F]+\b"),
    ("num", r"\b\d+\b"),
]
SIGNATURE_MAX_TOKENS = 20
TOKEN_SEQ_MAX = 8

# Template -> regex placeholder replacements applied after escaping (ordered).
TEMPLATE_REGEX_CODE: list[tuple[str, str]] = [
    ("<uuid>", r"[0-9a-fA-F\-]{36}"),
    ("<UUID>", r"[0-9a-fA-F\-]{36}"),
    ("<ipv4>", r"(?:\d{1,3}\.){3}\d{1,3}"),
    ("<IP>", r"(?:\d{1,3}\.){3}\d{1,3}"),
    ("<int>", r"\d+"),
    ("<num>", r"\d+"),
    ("<NUM>", r"\d+"),
    ("<*>", r".+?"),
]
# Placeholder map of the older regex builder (unknown placeholders -> .+?).
TEMPLATE_REGEX_OLD: dict[str, str] = {
    "<int>": r"\d+",
    "<float>": r"[+-]?(?:\d*\.\d+|\d+)",
    "<ipv4>": r"(?:\d{1,3}\.){3}\d{1,3}",
    "<uuid>": r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[1-5][0-9a-fA-F]{3}-[89abAB][0-9a-fA-F]{3}-[0-9a-fA-F]{12}",
    "<email>": r"[^@\s]+@[^@\s]+\.[^@\s]+",
    "<word>": r"[A-Za-z0-9_\-\.]+",
    "<hex>": r"[0-9a-fA-F]+",
}
# Characters escaped by the template escaper (Python 3.7+ re.escape set).
ESCAPE_CHARS = "()[]{}?*+-|^$\\.&~# \t\n\r\v\f"

# Schema classification: key = value pair detector.
LOGFMT_PAIR = r"\b\w+\s*=\s*[^\s=]+"

# Severity label spellings -> enum short name.
SEVERITY_NAMES: dict[str, str] = {
    "debug": "DEBUG", "info": "INFO", "warn": "WARN", "warning": "WARN",
    "error": "ERROR", "fatal": "FATAL",
}

# Label allow-lists.
POLICY_LABELS = ["service", "env", "severity", "k8s_namespace", "pod"]
CATALOG_LABELS = ["service", "env", "severity", "namespace"]
SEARCH_FILTER_LABELS = ["service", "env", "namespace", "severity"]
SELECTOR_LABELS = ["service", "env", "namespace"]
STREAM_LABELS = ["service", "env", "severity", "namespace", "pod"]
# Sink label defaults when absent or empty.
SINK_LABEL_DEFAULTS: dict[str, str] = {
    "service": "unknown", "env": "unknown", "pod": "unknown",
    "severity": "info", "namespace": "default",
}

# Sampler defaults.
EMA_HALF_LIFE_MIN = 10.0
MIN_SPIKE_PER_MIN = 100
SPIKE_FACTOR = 3.0
WARMUP_N = 32
LOG2_ENABLED = True
STEADY_K = {"DEBUG": 500, "INFO": 100, "WARN": 10}
STEADY_K_OTHER = 100
BUDGET_10M = 0
POLICY_VERSION = "sampler-redis-v1"
FALLBACK_POLICY_VERSION = "fallback"

# Miner defaults.
DRAIN_SIM = 0.4
DRAIN_DEPTH = 4
DRAIN_MAX_CHILDREN = 100
DRAIN_MAX_CLUSTERS = 1000
EXEMPLARS_MAX = 3
CONFIDENCE_MATCH = 0.9
CONFIDENCE_NEW = 0.5
CONFIDENCE_SHADOW = 0.3

# Search defaults.
VECTOR_DIM = 384
TOP_K_DEFAULT = 10
TOP_K_MAX = 100
RECENCY_BOOST = 0.05
MAX_TEMPLATES_IN_PLAN = 8

# Sink batching.
SINK_MAX_ENTRIES = 5000
SINK_MAX_BYTES = 1_000_000
SINK_ENTRY_OVERHEAD = 32

MAX_MESSAGE_BYTES = 1_048_576
MAX_LOG_SIZE = 1_048_576
MAX_LABELS = 100
MAX_FIELDS = 200
MAX_BATCH = 1000

# ---------------------------------------------------------------------------

_JAVA_BOUNDARY = r"(?:(?<=\w)(?!\w)|(?<!\w)(?=\w))"
_WS_CHARS = r"\t\n\f\r "


_HEX = r"[0-9a-fA-F]"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|[01]?[0-9][0-9]?)"
# Java patterns that match the same places as the translation of these, but fail at most characters on
# their first test: a boundary beside a word character is one look at the character on its other side.
JAVA: dict[str, str] = {
    **{p: p.replace(r"\b" + _HEX + "{8}", _HEX + r"{8}(?<!\w" + _HEX + "{8})", 1).replace(r"\b-", "-").replace(r"-\b", "-").replace(r"\b", r"(?!\w)")
       for p in (REDACTION_RULES[0][1], MASK_RULES_BASIC[0][0], SIGNATURE_RULES[0][1])},
    REDACTION_RULES[1][1]: rf"(?={_HEX}{{1,4}}:)(?<!\w)(?:{_HEX}{{1,4}}:){{7}}{_HEX}{{1,4}}(?!\w)",
    REDACTION_RULES[2][1]: rf"(?=[0-9])(?<!\w)(?:{_OCTET}\.){{3}}{_OCTET}(?!\w)",
    REDACTION_RULES[4][1]: r"(?=[0-9]{4})(?<!\w)(?:[0-9]{4}[-\t\n\f\r ]?){3}[0-9]{4}(?!\w)",
    # Before a plus, a boundary asks for a word character; before a digit, for none.
    REDACTION_RULES[5][1]: r"(?=[+1-9])(?:(?<=\w)\+|(?<!\w))[1-9][0-9]{1,14}(?!\w)",
    MASK_RULES_BASIC[1][0]: r"(?=[0-9])(?<!\w)(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?!\w)",
    MASK_RULES_BASIC[2][0]: r"(?=[0-9])(?<!\w)[0-9]++(?!\w)",
    SIGNATURE_RULES[2][1]: rf"(?=0x)(?<!\w)0x{_HEX}+(?!\w)",
}


def to_java(re2: str) -> str:
    """An equivalent Java pattern (ASCII classes): that of ``JAVA``, or the translation."""
    return JAVA[re2] if re2 in JAVA else translated(re2)


def translated(re2: str) -> str:
    """Translate an RE2 pattern to Java syntax."""
    out: list[str] = []
    i, in_class = 0, False
    while i < len(re2):
        c = re2[i]
        if c == "\\" and i + 1 < len(re2):
            n = re2[i + 1]
            if n == "b" and not in_class:
                out.append(_JAVA_BOUNDARY)
            elif n == "s":
                out.append(_WS_CHARS if in_class else f"[{_WS_CHARS}]")
            elif n == "v":
                out.append(r"\x0B")
            else:
                out.append(c + n)
            i += 2
            continue
        if c == "[" and not in_class:
            in_class = True
        elif c == "]" and in_class and out and out[-1] not in ("[", "[^"):
            in_class = False
        out.append(c)
        i += 1
    return "".join(out)


def sql_str(s: str) -> str:
    """Quote a Python string as a SQL string literal (standard '' escaping)."""
    return "'" + s.replace("'", "''") + "'"
