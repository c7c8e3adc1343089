"""Text as columns: lines, places, fingerprints, entropy, redaction, globs. All built-in expressions."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Severities from least to most, with rank and score.
SEVERITIES = (("info", 0, 1.0), ("low", 1, 3.0), ("medium", 2, 5.5), ("high", 3, 8.0), ("critical", 4, 9.5))
RANK = {name: rank for name, rank, _ in SEVERITIES}

#: Directories and name marks of code that isn't shipped.
DEV_ROOTS = ("scripts", "tools", "bin", ".github", ".storybook", "cypress", "playwright", "e2e", "test", "tests")
DEV_ANYWHERE = ("__tests__", "__mocks__", "__fixtures__")
DEV_MARKS = (".test.", ".spec.", ".stories.", ".cy.", ".e2e.")


def literal_map(pairs: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in pairs.items() for x in kv])


def severity_rank(severity: Column) -> Column:
    """0 (info) to 4 (critical); null or unknown counts as medium."""
    return F.coalesce(F.get(F.transform(F.array(severity), lambda s: literal_map(RANK)[s]), F.lit(0)), F.lit(RANK["medium"]))


def severity_name(rank: Column) -> Column:
    return literal_map({r: n for n, r, _ in SEVERITIES})[rank]


def explode_lines(files: DataFrame, key: str, text: str = "text", longest: int | None = None) -> DataFrame:
    """key, line (from 1), line_text: a row a line, cut at line feeds; lines over `longest` characters go."""
    lines = files.select(F.col(key), F.posexplode(F.split(F.col(text), "\n")).alias("i", "line_text"))
    lines = lines.select(key, (F.col("i") + 1).alias("line"), "line_text")
    return lines.filter(F.length("line_text") <= longest) if longest else lines


def fingerprint(rule: Column, file: Column, line: Column, snippet: Column) -> Column:
    """16 hex digits that identify a finding: of rule, place and trimmed snippet, not of message or severity."""
    return F.substring(F.sha1(F.concat_ws("|", rule, file, line.cast("string"), F.trim(snippet))), 1, 16)


def location(file: Column, line: Column) -> Column:
    return F.when(line == 0, file).otherwise(F.concat_ws(":", file, line.cast("string")))


def entropy(text: Column) -> Column:
    """Shannon entropy of the characters, in bits; 0 for empty text."""
    chars = F.filter(F.split(text, ""), lambda c: c != "")
    n = F.size(chars).cast("double")
    parts = F.transform(F.array_distinct(chars), lambda c: F.size(F.filter(chars, lambda d: d == c)) / n)
    return F.coalesce(F.aggregate(parts, F.lit(0.0), lambda acc, p: acc - p * F.log2(p)), F.lit(0.0))


#: Our own masks, in the order in which they apply.
REDACTIONS = (
    (r"(?i)(password|passwd|token|secret|api[_-]?key)(\s*[=:]\s*)[^\s]+", "$1$2[masked]"),
    (r"(AKIA|ASIA)[0-9A-Z]{16}", "[masked key]"),
    (r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}", "[masked mail]"),
    (r"[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}\.[0-9]{1,3}", "[masked address]"),
    (r"[0-9]{9,}", "[masked number]"),
)


def redacted(text: Column) -> Column:
    for pattern, mark in REDACTIONS:
        text = F.regexp_replace(text, pattern, mark)
    return text


def redacted_tokens(text: Column, least: int = 20, bits: float = 3.6) -> Column:
    """Redaction's last pass: long unbroken runs of high entropy become a mark."""
    words = F.split(text, " ")
    return F.array_join(F.transform(words, lambda w: F.when((F.length(w) >= least) & w.rlike(r"^[A-Za-z0-9+/_=.-]+$") & (entropy(w) >= bits), F.lit("[masked run]")).otherwise(w)), " ")


def glob_regex(glob: str) -> str:
    """An anchored pattern for a file glob whose * and ? cross separators, with * also tried without leading * and /."""

    def one(g: str) -> str:
        out, i = "", 0
        while i < len(g):
            c = g[i]
            if c == "[" and (j := g.find("]", i + 2)) > 0:
                body = g[i + 1 : j]
                out += "[" + ("^" + body[1:] if body[0] == "!" else body).replace("\\", "\\\\") + "]"
                i = j
            else:
                out += {"*": "[\\s\\S]*", "?": "[\\s\\S]"}.get(c) or re.escape(c)
            i += 1
        return out

    return f"^(?:{one(glob)}|{one(glob.lstrip('*/'))})$"


def dev_only(path: Column) -> Column:
    """Whether a path is tooling or tests, not shipped code: by its first directory, any directory, or a mark in it."""
    low = F.lower(F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "^/+|/+$", ""))
    parts = F.split(low, "/")
    marks = "|".join(re.escape(m) for m in DEV_MARKS)
    return F.coalesce(F.element_at(parts, 1).isin(*DEV_ROOTS) | F.arrays_overlap(parts, F.array(*[F.lit(d) for d in DEV_ANYWHERE])) | low.rlike(marks), F.lit(False))


#: What makes a path one of tests.
TEST_MARKS = ("__tests__/", "__mocks__/", "/test/", "/tests/", "fixtures/", ".test.", ".spec.", "/__fixtures__/", "e2e/", "cypress/")


def test_path(path: Column) -> Column:
    """Whether a file belongs to tests; a null path doesn't."""
    rooted = F.concat(F.lit("/"), F.regexp_replace(F.replace(path, F.lit("\\"), F.lit("/")), "^/+", ""))
    return F.coalesce(rooted.rlike("|".join(re.escape(m) for m in TEST_MARKS)), F.lit(False))


def name_tokens(name: Column) -> Column:
    """A name's words in lower case: runs of capitals before a word, words, numbers."""
    return F.transform(F.regexp_extract_all(name, F.lit(f"({NAME_WORD})"), 1), lambda w: F.lower(w))


#: What a word of a name is.
NAME_WORD = "[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+|[0-9]+"
# Words that make a name sensitive by themselves, a first and a second word that do together, other pairs, and words written as one.
SENSITIVE = ("password", "passwd", "pwd", "ssn", "cvv", "cvc", "jwt", "mnemonic", "passphrase")
SENSITIVE_FIRST = ("api", "secret", "private", "access", "refresh", "session", "auth", "bearer", "client", "signing", "encryption", "totp", "csrf", "recovery", "id", "seed")
SENSITIVE_SECOND = ("key", "token", "secret", "password", "credential", "phrase", "code")
SENSITIVE_PAIRS = ("credit card", "card number", "social security", "seed phrase", "recovery code", "session id", "id token")
SENSITIVE_FUSED = (
    "(?:api|secret|private|access|refresh|session|auth|bearer|client|signing|encryption)(?:key|token|secret)|accesstoken|refreshtoken|sessiontoken|privatekey|secretkey|apikey|clientsecret|passwordhash|creditcard|cardnumber|seedphrase"
)


def is_sensitive(name: str) -> bool:
    """sensitive_name() of a Python text."""
    words = [w.lower() for w in re.findall(NAME_WORD, name)]
    if any(w in SENSITIVE for w in words):
        return True
    if any(a in SENSITIVE_FIRST and b in SENSITIVE_SECOND or f"{a} {b}" in SENSITIVE_PAIRS for a, b in zip(words, words[1:])):
        return True
    return bool(re.search(SENSITIVE_FUSED, "".join(words)))


def sensitive_name(name: Column) -> Column:
    """Whether a name is that of something secret, by its words; a null name isn't."""
    words = name_tokens(name)
    spaced = F.concat(F.lit(" "), F.array_join(words, "  "), F.lit(" "))
    pair = "|".join([f" (?:{'|'.join(SENSITIVE_FIRST)})  (?:{'|'.join(SENSITIVE_SECOND)}) ", *[f" {p.replace(' ', '  ')} " for p in SENSITIVE_PAIRS]])
    return F.coalesce(spaced.rlike(f" (?:{'|'.join(SENSITIVE)}) |{pair}") | F.array_join(words, "").rlike(SENSITIVE_FUSED), F.lit(False))


def url_parts(url: Column) -> Column:
    """scheme, host, path, query of a URL; nulls where absent."""
    take = lambda p, i: F.nullif(F.regexp_extract(url, p, i), F.lit(""))
    return F.struct(
        take(r"^([A-Za-z][A-Za-z0-9+.-]*)://", 1).alias("scheme"), take(r"^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)", 1).alias("host"),
        take(r"^(?:[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)?([^?#]*)", 1).alias("path"), take(r"\?([^#]*)", 1).alias("query"),
    )


def dynamic_host(url: Column) -> Column:
    """Whether a URL expression's host comes from data: not relative, not literal, not a template with a literal host."""
    u = F.trim(url)
    fixed = u.rlike(r"^[\"'`]?/[^/]") | u.rlike(r"^[\"'`]?/$") | u.rlike(r"^[\"'`]?https?://[A-Za-z0-9.-]+([/:?#\"'`]|$)") | u.rlike(r"^[\"'][^\"']*[\"']$")
    return ~fixed & (u.rlike(r"\$\{") | u.rlike(r"^[A-Za-z_]") | u.rlike(r"\+"))


def host_is_dynamic(url: Column) -> Column:
    """Whether the host of a URL expression may come from data: not a relative URL, none with a literal host, no template that starts with a literal path."""
    u = F.trim(F.coalesce(url, F.lit("")))
    relative = u.rlike(r"^[`'\"]?\s*(?:/(?!/)|\./|\.\./|\?|#)")
    literal = u.rlike(r"^[`'\"]?\s*(?:https?:)?//[^/`$'\"\s{]+")
    start = F.trim(F.regexp_extract(u, r"^`((?:[^$]|\$(?!\{))*)", 1))
    return ~(relative | literal | (u.startswith("`") & (start != "") & ~F.contains(start, F.lit("://")) & ~start.startswith("//")))


def literal_private_ip(host: Column) -> Column:
    """Whether a literal IPv4 host is private, loopback, link-local, multicast, reserved or unspecified; null if not literal."""
    parts = F.split(host, r"\.")
    a, b = parts[0].cast("int"), parts[1].cast("int")
    literal = host.rlike(r"^(25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})(\.(25[0-5]|2[0-4][0-9]|1?[0-9]{1,2})){3}$")
    inside = (a == 10) | (a == 127) | (a == 0) | (a >= 224) | ((a == 172) & b.between(16, 31)) | ((a == 192) & (b == 168)) | ((a == 169) & (b == 254))
    return F.when(literal, inside)
