"""A plain scanner to hold the operator against: candidates by walking over characters, features counted one by one,
the forest's trees walked node by node. It shares no pattern and no function with the operator, only its word lists and
the trained forest's numbers."""

import math

from riskweave.llm.secrets import AGAINST, BESIDE, DICTIONARY, EXAMPLE, FOR, KINDS

LOWER = "abcdefghijklmnopqrstuvwxyz"
UPPER, DIGITS = LOWER.upper(), "0123456789"
ALNUM = LOWER + UPPER + DIGITS
BLANK = " \t\n\r\x0b\x0c\x1c\x1d\x1e\x1f\x85\xa0                　"
NAMES = ["password", "passwd", "pwd", "secret", "token"] + [f"{a}{sep}key" for a in ("api", "access", "auth", "secret", "private", "signing") for sep in ("", "_", "-")]


def run(t, i, allowed):
    j = i
    while j < len(t) and (allowed(t[j]) if callable(allowed) else t[j] in allowed):
        j += 1
    return j


def word_char(c):
    return c.isalnum() or c == "_"


def after_alnum(t, i):
    return i > 0 and t[i - 1] in ALNUM


def private_key(t, i):
    def fence(at, lead):
        if not t.startswith(lead, at):
            return None
        j = run(t, at + len(lead), UPPER + " ")
        for end in range(j, at + len(lead) - 1, -1):  # the longest name of at most 30 letters before PRIVATE KEY
            if end - at - len(lead) <= 30 and t.startswith("PRIVATE KEY-----", end):
                return end + len("PRIVATE KEY-----")
        return None

    if (j := fence(i, "-----BEGIN ")) is None:
        return None
    j = run(t, j, lambda c: c in ALNUM + "+/=" or c in BLANK)
    return i, fence(j, "-----END ") or j


def prefixed(lead, allowed, least, most=None):
    def at(t, i):
        for p in lead:
            if t.startswith(p, i) and not after_alnum(t, i):
                j = run(t, i + len(p), allowed)
                if most is None and j - i - len(p) >= least:
                    return i, j
                if most is not None and j == i + len(p) + most and not (j < len(t) and t[j] in ALNUM):
                    return i, j
        return None

    return at


def aws(t, i):
    if t[i : i + 4] in ("AKIA", "ASIA") and not after_alnum(t, i):
        j = i + 20
        if len(t) >= j and all(c in UPPER + DIGITS for c in t[i + 4 : j]) and not (j < len(t) and t[j] in ALNUM):
            return i, j
    return None


def jwt(t, i):
    if not t.startswith("eyJ", i) or after_alnum(t, i):
        return None
    part = lambda c: word_char(c) or c == "-"
    a = run(t, i + 3, part)
    if a - i - 3 < 8 or t[a : a + 1] != ".":
        return None
    b = run(t, a + 1, part)
    if b - a - 1 < 8 or t[b : b + 1] != ".":
        return None
    c = run(t, b + 1, part)
    return (i, c) if c - b - 1 >= 5 else None


def url_password(t, i):
    if t[i - 3 : i] != "://" or i < 3:
        return None
    a = run(t, i, lambda c: c not in BLANK and c not in ":/@")
    if a == i or t[a : a + 1] != ":":
        return None
    b = run(t, a + 1, lambda c: c not in BLANK and c not in "@/")
    return (a + 1, b) if b - a - 1 >= 3 and t[b : b + 1] == "@" else None


def assigned(t, i):
    for name in NAMES:
        if t[i : i + len(name)].lower() == name:
            j = i + len(name)
            j += t[j : j + 1] in ('"', "'") and j < len(t)
            gap = run(t, j, BLANK)
            if gap - j > 4 or t[gap : gap + 1] not in ("=", ":") or gap == len(t):
                continue
            j = gap + 1
            gap = run(t, j, BLANK)
            if gap - j > 4:
                continue
            j = gap
            j += t[j : j + 1] in ('"', "'") and j < len(t)
            end = run(t, j, lambda c: c not in BLANK and c not in "\"'`,;")
            if end - j >= 6:
                return j, end
    return None


def mixed(t, i):
    own = ALNUM + "+/_-"
    if i > 0 and t[i - 1] in own:
        return None
    j = run(t, i, own)
    if j - i < 20 or not any(c in DIGITS for c in t[i:j]):
        return None
    pad = run(t, j, "=")
    if pad - j in (1, 2) and not (pad < len(t) and t[pad] in ALNUM):
        return i, pad
    return (i, j) if pad == j else None


WALK = {
    "private_key": private_key, "aws_key_id": aws, "github_token": prefixed(["ghp_", "gho_", "ghu_", "ghs_", "ghr_"], ALNUM, 20), "slack_token": prefixed([f"xox{c}-" for c in "abprs"], ALNUM + "-", 10),
    "google_key": prefixed(["AIza"], ALNUM + "_-", 30), "stripe_key": prefixed(["rk_live_", "rk_test_", "sk_live_", "sk_test_"], ALNUM, 10), "jwt": jwt, "url_password": url_password, "assigned": assigned, "mixed": mixed,
}


def slow_candidates(t):
    out, i = [], 0
    while i < len(t):
        for kind, walk in WALK.items():
            if got := walk(t, i):
                out.append((kind, *got))
                i = got[1] - 1
                break
        i += 1
    return out


def words_of(s):
    out, own = [], ""
    for c in s + " ":
        if c in ALNUM + "_":
            own += c
        elif own:
            out.append(own.lower())
            own = ""
    return out


def pieces(value):
    """Words of a value: runs of letters, cut before a capital that follows a small letter or that a small letter follows."""
    out, last = [""], ""
    for i, c in enumerate(value):
        if c not in LOWER + UPPER:
            out.append("")
        elif c in UPPER and (last and last in LOWER or value[i + 1 : i + 2] and value[i + 1] in LOWER):
            out.append(c)
        else:
            out[-1] += c
        last = c
    return [p.lower() for p in out if p]


def slow_features(t, kind, a, b, made_up, in_use, pathlike, lexicon):
    v = t[a:b]
    n = len(v)
    cls = lambda c: "digit" if c.isdigit() else "upper" if c.isupper() else "lower" if c.islower() else "other"
    share = {k: sum(cls(c) == k for c in v) / n for k in ("digit", "upper", "lower", "other")}
    often = [v.count(c) / n for c in sorted(set(v))]
    changes = sum(cls(x) != cls(y) for x, y in zip(v, v[1:])) / n
    low = v.lower()
    pairs = [lexicon.follows[LOWER.index(x), LOWER.index(y)] for x, y in zip(low, low[1:]) if x in LOWER and y in LOWER]
    known = lexicon.words | DICTIONARY
    covered = sum(len(p) for p in pieces(v) if len(p) > 3 and (p in known or p.rstrip("s") in known)) / n
    hexa = all(c in DIGITS + "abcdefABCDEF" for c in v)
    shape = [len(p) for p in v.split("-")]
    uuid = shape == [8, 4, 4, 4, 12] and all(c in DIGITS + "abcdefABCDEF-" for c in v)
    near = words_of(t[max(0, a - BESIDE) : a])[-4:] + words_of(t[b : b + BESIDE])[:3]
    near = {x for w in near for x in [w, *w.split("_")]}
    url = "://" in t[max(0, a - 200) : a].rsplit(" ", 1)[-1]
    return [
        KINDS.index(kind), math.log2(n + 1), share["digit"], share["upper"], share["lower"], share["other"], -sum(p * math.log2(p) for p in often), len(often) / n, max(often), changes, sum(pairs) / len(pairs) if pairs else 0.0, covered,
        uuid, hexa, v.count("/") / n, pathlike, any(w in near for w in FOR), any(w in near for w in AGAINST), any(x in low for x in EXAMPLE), url, made_up, in_use,
    ]


def vote(forest, x):
    total = 0.0
    for at in forest.roots.tolist():
        while forest.feature[at] >= 0:
            at = forest.left[at] if x[forest.feature[at]] <= forest.threshold[at] else forest.right[at]
        total += forest.value[at]
    return total / len(forest.roots)


def path_like(v):
    """Two names with a slash after each, or a file ending of a source or document."""
    name = lambda c: word_char(c) or c in ".-"
    for i in range(len(v)):
        if i and name(v[i - 1]):
            continue
        a = run(v, i, name)
        if a > i and v[a : a + 1] == "/":
            b = run(v, a + 1, name)
            if b > a + 1 and v[b : b + 1] == "/":
                return True
    for end in "js ts py html css png jpg json md txt java go rs".split():
        at = v.find("." + end)
        while at >= 0:
            after = at + 1 + len(end)
            if after >= len(v) or not word_char(v[after]):
                return True
            at = v.find("." + end, at + 1)
    return False


def slow_scan(text, detector):
    """(kind, start, end, score) of a text without a path."""
    return [(k, a, b, vote(detector.forest, slow_features(text, k, a, b, 0, 0, path_like(text[a:b]), detector.lexicon))) for k, a, b in slow_candidates(text)]
