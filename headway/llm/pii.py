"""PII: overlapping candidate spans, a gradient-boosted choice among them, and redaction.

Generators propose spans generously: what the base rules accept stays always,
and looser forms (written-out or spaced addresses, numbers without their usual
marks or check digits, secrets after a key word, in addresses or by their
issuer's prefix) are candidates that boosted trees score by their format and the
words around them.  Every scan is linear in the text: runs of digits are found
once and joined, patterns are bounded, and an address is grown to both sides of
its "@", so long runs of junk cost no more than other text.

Without span labels, the trees learn from made-up lines (`made`): personal data
in forms that the base rules don't know, against dates, ranges, counts, versions
and words of the same shape.  A number in any groups is a telephone's if a word
says so, and nobody's after a word of counts.  The corpus adds what the base rules accept, also
rewritten into looser forms, and candidates that are surely none (`wrong`);
candidates that may be either teach nothing.  Thresholds are calibrated on rows
not learned from.
"""

from __future__ import annotations

import bisect
import hashlib
import ipaddress
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .shared import drawn, materialize, read, text_of

KINDS = ("email", "ip", "card", "phone")
#: Kinds that only the method adds.
MORE_KINDS = ("secret",)
#: Documents that may hold candidates from which the trees learn: all, or the share by a hash of the text that holds about 1.5 times so many.
TRAIN_DOCS = 20_000
#: Candidates that reach the fit at most, the least by a hash.
TRAIN_ROWS = 60_000
PRECISION = 0.98
CONTEXT = 24

LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
LOCAL_CHARS = "".join(sorted(LOCAL))
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
RUN = re.compile(r"[0-9]+")
#: Looser forms (fixed patterns): every quantifier is bounded or follows a literal, or ends the pattern, as a secret has any length.
HINT = re.compile(r" ?(?:[(\[{<] ?(?:at|ät|arroba|@) ?[)\]}>]|@) ?| at ", re.I)
DOT = r"(?: ?[(\[{<] ?(?:dot|punkt|punto|\.) ?[)\]}>] ?| dot | \. |\.)"
LOOSE_DOMAIN = re.compile(rf"[A-Za-z0-9-]{{1,63}}(?:{DOT}[A-Za-z0-9-]{{1,63}}){{1,6}}", re.I)
#: A local part whose own dots are written out, before an "at".
DOTTED_LOCAL = re.compile(r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,32}(?: dot | ?[(\[{] ?dot ?[)\]}] ?)[A-Za-z0-9._%+-]{1,32}$", re.I)
IP_JOIN = r"(?:\.| \. | ?[(\[{](?:\.|dot)[)\]}] ?| dot |-| )"
LOOSE_IP = re.compile(rf"(?<![0-9.])[0-9]{{1,3}}(?:{IP_JOIN}[0-9]{{1,3}}){{3}}(?![0-9])", re.I)
#: A loose address has four groups of three digits and three joins of seven characters at most.
IP_LENGTH = 4 * 3 + 3 * 7
IPV6 = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:|::)(?:[0-9A-Fa-f]{0,4}:){1,7}[0-9A-Fa-f]{0,4}(?![0-9A-Za-z:])")
SECRET_NAMES = ("token", "secret", "password", "passwd", "passwort", "pwd", "passphrase", "key", "credential", "auth")
SECRET_NAME = "(?:" + "|".join(SECRET_NAMES) + ")"
SECRET = re.compile(rf"{SECRET_NAME}(?:s|[_-][A-Za-z0-9_-]{{1,24}})?[\"']?\s{{0,3}}(?:=>|:=|[=:])\s{{0,3}}[\"'`]?([^\s\"'`,;<>()\[\]{{}}]{{8,}})", re.I)
SAID_SECRET = re.compile(rf"(?<![A-Za-z]){SECRET_NAME} (?:is|was|ist|to)(?: now)?:? [\"'`]?([^\s\"'`,;<>()\[\]{{}}]{{8,}})", re.I)
BEARER = re.compile(r"(?<![A-Za-z])(?:bearer|basic) ([A-Za-z0-9+/_=.~-]{12,})", re.I)
USER_INFO = re.compile(r"://[A-Za-z0-9._%-]{1,64}:([^\s/@:]{6,})@")
#: What issuers put before their keys.
ISSUERS = ("AKIA", "ASIA", "AIza", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "glpat-", "xoxa-", "xoxb-", "xoxp-", "xoxr-", "xoxs-", "sk_live_", "pk_live_", "sk_test_", "pk_test_", "sk-", "eyJ")
ISSUED = re.compile("(?<![A-Za-z0-9])(?:" + "|".join(ISSUERS) + ")[A-Za-z0-9_.-]{12,}")
#: Marks between the groups of one number.
JOINS = " ().-/_ ‑–"
#: Words before personal data of a kind (fixed values), in the corpus's languages.
WORDS = {
    "email": ("mail", "email", "e-mail", "contact", "write", "address", "inbox", "reach", "adresse", "correo", "schreib", "send"),
    "ip": ("ip", "host", "server", "addr", "address", "gateway", "client", "peer", "router", "ping", "ssh", "dns", "from", "node"),
    "card": ("card", "visa", "mastercard", "amex", "diners", "credit", "debit", "pay", "paid", "charge", "charged", "karte", "carte", "tarjeta"),
    "phone": ("tel", "telephone", "telefon", "phone", "call", "fax", "mobile", "mobil", "cell", "ring", "dial", "text", "sms", "whatsapp", "handy", "tél", "téléphone", "teléfono", "móvil", "número", "contact", "reach", "llámame", "anrufen", "voicemail", "hotline"),
    "secret": ("token", "secret", "password", "passwd", "key", "api", "bearer", "passwort", "auth", "login"),
}
#: Words before numbers that are nobody's (fixed values).
COUNTED = frozenset("order page pages invoice isbn issn serial ticket tracking code part lot version section chapter item reference ref population total sum rows row barcode patent year years series model build firmware release step steps score scores results table figure article paragraph id coordinates matrix bill seite nummer bestellung page commande pedido".split())
#: Words between what announces and what is announced (fixed values).
BETWEEN = frozenset("a an at for in is it me my no nr number on or our the to us was".split())
WORD = re.compile(r"[^\W\d_]+(?:-[^\W\d_]+)*")


def cues(before: str) -> tuple[list[str], str]:
    """The last six words before a span, in lower case, and what stands after the last."""
    found = list(WORD.finditer(before))
    return [m[0].lower() for m in found[-6:]], before[found[-1].end() :] if found else before


def cued(kind: str, before: str) -> int:
    """2 if one of the two last words before a span announces the kind, 1 if one before those does, else 0; -1 if the last two announce a count.  Words of BETWEEN don't count."""
    words = [w for w in cues(before)[0] if w not in BETWEEN]
    near = [w in WORDS[kind] for w in words]
    if any(near[-2:]):
        return 2
    if any(w in COUNTED for w in words[-2:]):
        return -1
    return int(any(near))


def mixed(value: str) -> bool:
    """Whether a value has both letters and digits, as keys do."""
    return any(c.isdigit() for c in value) and any(c.isalpha() for c in value)


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        d = ord(c) - 48
        total += d if i % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def emails(text: str) -> list[tuple[int, int]]:
    """`[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\\.[A-Za-z0-9-]+)+`, leftmost and not overlapping.  No class holds "@", so each match is one "@" with what precedes and follows it."""
    out, last, at = [], 0, text.find("@")
    while at >= 0:
        before = text[last:at]
        start = last + len(before.rstrip(LOCAL_CHARS))
        if start < at and (m := DOMAIN.match(text, at)):
            out.append((start, m.end()))
            last = m.end()
            at = text.find("@", last)
        else:
            last = at + 1
            at = text.find("@", at + 1)
    return out


def digit_runs(text: str) -> list[tuple[int, int]]:
    return [m.span() for m in RUN.finditer(text)]


def ips(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Four runs of digits joined by single dots, parts at most 255."""
    out, i = [], 0
    while i + 3 < len(runs):
        if all(runs[k + 1][0] - runs[k][1] == 1 and text[runs[k][1]] == "." for k in (i, i + 1, i + 2)):
            parts = [text[a:b].lstrip("0") for a, b in runs[i : i + 4]]
            if all(len(p) <= 3 and int(p or 0) <= 255 for p in parts):
                out.append((runs[i][0], runs[i + 3][1]))
            i += 4
        else:
            i += 1
    return out


def chains(text: str, runs: list[tuple[int, int]]) -> list[tuple[int, int, str]]:
    """`[0-9]([\\x20-]?[0-9])+` as (start, end, digits): runs joined by single spaces or hyphens, two digits at least."""
    out, i = [], 0
    while i < len(runs):
        j = i
        while j + 1 < len(runs) and runs[j + 1][0] - runs[j][1] == 1 and text[runs[j][1]] in " -":
            j += 1
        start, end = runs[i][0], runs[j][1]
        if end - start > 1:
            out.append((start, end, "".join(text[a:b] for a, b in runs[i : j + 1])))
        i = j + 1
    return out


def phones(text: str) -> list[tuple[int, int]]:
    out, at = [], text.find("+")
    while at >= 0:
        if m := PHONE.match(text, at):
            if 8 <= sum("0" <= c <= "9" for c in m[0]) <= 15:
                out.append(m.span())
            at = text.find("+", m.end())
        else:
            at = text.find("+", at + 1)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Spans of the base rules, by kind as listed, then by start."""
    out = [("email", a, b) for a, b in emails(text)] if "@" in text else []
    runs = digit_runs(text)
    if runs:
        out += [("ip", a, b) for a, b in ips(text, runs)]
        out += [("card", a, b) for a, b, d in chains(text, runs) if 16 <= len(d) <= 19 and luhn(d)]
        out += [("phone", a, b) for a, b in phones(text)] if "+" in text else []
    return out


def candidates(text: str) -> list[tuple[str, int, int]]:
    """Spans that may be personal data, overlapping as they come, base spans included."""
    out = set(base_spans(text))
    for m in HINT.finditer(text):
        if (domain := LOOSE_DOMAIN.match(text, m.end())) and not domain[0][-1].isdigit():
            before = text[max(0, m.start() - 66) : m.start()]
            start = m.start() - len(before) + len(before.rstrip(LOCAL_CHARS))
            if start < m.start():
                out.add(("email", start, domain.end()))
                if dotted := DOTTED_LOCAL.search(before):
                    out.add(("email", m.start() - len(before) + dotted.start(), domain.end()))
    runs = digit_runs(text)
    if any(y[1] - x[0] <= IP_LENGTH for x, y in zip(runs, runs[3:])):
        out |= {("ip", *m.span()) for m in LOOSE_IP.finditer(text)}
    if runs:
        for a, b, d in chains(text, runs):
            if 13 <= len(d) <= 19:
                out.add(("card", a, b))
            elif 7 <= len(d) <= 12:
                out.add(("phone", a, b))
        i = 0
        while i < len(runs):  # runs joined by up to three marks: numbers in groups
            j, digits = i, runs[i][1] - runs[i][0]
            while j + 1 < len(runs) and runs[j + 1][0] - runs[j][1] <= 3 and digits <= 19 and all(c in JOINS for c in text[runs[j][1] : runs[j + 1][0]]):
                j += 1
                digits += runs[j][1] - runs[j][0]
            if j > i:
                # All groups, or all but the first or the last, which may be another number.
                for k, n in ((i, j), (i + 1, j), (i, j - 1)):
                    digits = sum(y - x for x, y in runs[k : n + 1])
                    start = runs[k][0]
                    while k == i and start and text[start - 1] in "+(":
                        start -= 1
                    if 7 <= digits <= 15 and n > k:
                        out.add(("phone", start, runs[n][1]))
                    if 13 <= digits <= 19 and n > k:
                        out.add(("card", runs[k][0], runs[n][1]))
            i = j + 1
    if text.count(":") > 1:
        out |= {("ip", *m.span()) for m in IPV6.finditer(text) if is_ipv6(m[0])}
    # Most texts hold no word that a form begins with, which a plain search tells sooner.
    low = text.lower()
    named = any(w in low for w in SECRET_NAMES)
    forms = [SECRET] if named and ("=" in text or ":" in text) else []
    forms += [SAID_SECRET] if named and any(w in low for w in (" is", " was", " to")) else []
    forms += [BEARER] if "bearer " in low or "basic " in low else []
    forms += [USER_INFO] if "://" in text else []
    for form in forms:
        out |= {("secret", m.start(1), m.start(1) + len(m[1].rstrip(".:"))) for m in form.finditer(text) if len(m[1].rstrip(".:")) > 5}
    if any(w in text for w in ISSUERS):
        out |= {("secret", m.start(), m.start() + len(m[0].rstrip("."))) for m in ISSUED.finditer(text)}
    return sorted(out)


def is_ipv6(s: str) -> bool:
    try:
        return len(s) > 4 and bool(ipaddress.IPv6Address(s))
    except ValueError:
        return False


#: The last run of letters and digits.
LAST = re.compile(r"[^\W_]*[\W_]*$")
FEATURES = 48


def describe(text: str, kind: str, a: int, b: int) -> list[float]:
    """Format and context of a span as numbers."""
    s, before, after = text[a:b], text[max(0, a - CONTEXT) : a], text[b : b + CONTEXT]
    digits = [c for c in s if "0" <= c <= "9"]
    letters = sum(c.isalpha() for c in s)
    groups = RUN.findall(s)
    near = (before + " " + after).lower()
    parts = [int(g[:6]) for g in groups]
    sizes = [len(g) for g in groups] or [0]
    between = [x[:1] for x in RUN.split(s)[1:-1]] if len(groups) > 1 else []
    words, gap = cues(before)
    low = s.lower()
    return [
        float((*KINDS, *MORE_KINDS).index(kind)), float(len(s)), float(len(digits)), float(letters), float(len(set(s))),
        float(s.count(".")), float(s.count("-")), float(s.count(" ")), float(s.count("@")), float(kind == "email" and "@" not in s),
        float(s[:1] == "+"), float("(" in s), float(len(groups)), float(max(map(len, groups), default=0)), float(min(map(len, groups), default=0)),
        float(max(parts, default=0) <= 255), float(13 <= len(digits) <= 19 and luhn("".join(digits))),
        float(before[-1:].isalnum() or before[-1:] in "._@/"), float(after[:1].isalnum() or after[:1] in "_@/"), float(before[-1:].isspace() or not before), float(after[:1].isspace() or not after),
        float(any(w in near for w in WORDS[kind][:4])), float(s.lower().rsplit(".", 1)[-1] in ("com", "org", "net", "edu", "de", "fr", "es", "io")), float(sum(not c.isalnum() for c in s)),
        float(any(len(g) == 4 and g[:2] in ("19", "20") for g in groups)), float(sizes[0]), float(sizes[-1]), float(len(set(between))), float(s[:1] == "0" or s[:2] == "(0"),
        float(sum(n == 3 for n in sizes)), float(sum(n == 2 for n in sizes)), float(s.isdigit()), float(bool(digits) and letters > 0), float(len(digits) / max(1, len(s))),
        float(cued(kind, before)), float(len(gap)), float(any(c in ":=" for c in gap)), float(bool(words) and words[-1] in COUNTED),
        float(any(c.isdigit() for c in before[-3:]) and before[-1:] in JOINS), float(any(c.isdigit() for c in after[:3]) and after[:1] in JOINS),
        float("dot" in low or "[.]" in low or "(.)" in low), float(any(c in s for c in "([{<")), float(kind == "ip" and ":" in s), float(mixed(s)),
        float(sum(c.isupper() for c in s) / max(1, letters)), float(ISSUED.match(s) is not None),
        float(len(LAST.search(s)[0])), float(len(s.split())),
    ]


class Boosted:
    """Gradient-boosted trees for a binary outcome, by histograms of quantile bins."""

    def __init__(self, trees: list, base: float, cuts: list[np.ndarray]):
        self.trees, self.base, self.cuts = trees, base, cuts

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, x[:, k], "left") for k, c in enumerate(self.cuts)], axis=1) if len(x) else np.zeros((0, len(self.cuts)), np.int64)

    def raw(self, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(bins), self.base)
        for feature, cut, left, right, value in self.trees:
            node = np.zeros(len(bins), np.int64)
            for _ in range(DEPTH):
                go = feature[node] >= 0
                down = bins[np.arange(len(bins)), np.maximum(feature[node], 0)] > cut[node]
                node = np.where(go, np.where(down, right[node], left[node]), node)
            out += value[node]
        return out

    def __call__(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.raw(self.binned(x))))


TREES, DEPTH, RATE, BINS, LEAF = 60, 4, 0.15, 32, 8


def boost(x: np.ndarray, y: np.ndarray) -> Boosted:
    """Fit TREES trees of DEPTH levels by second-order gains of the logistic loss."""
    cuts = [np.unique(np.quantile(x[:, k], np.linspace(0, 1, BINS + 1)[1:-1])) for k in range(x.shape[1])]
    rate = min(max(y.mean(), 1e-3), 1 - 1e-3)
    model = Boosted([], float(np.log(rate / (1 - rate))), cuts)
    bins, raw = model.binned(x), np.full(len(x), model.base)
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-raw))
        g, h = p - y, np.maximum(p * (1 - p), 1e-6)
        feature, cut, left, right, value, at = [-1], [0], [0], [0], [0.0], {0: np.arange(len(x))}
        for _ in range(DEPTH):
            below = {}
            for node, rows in at.items():
                sg, sh, best = g[rows].sum(), h[rows].sum(), (1e-6, -1, 0)
                for k in range(x.shape[1]):
                    n = len(cuts[k]) + 1
                    if n == 1:
                        continue
                    b = bins[rows, k]
                    gl, hl, nl = (np.cumsum(np.bincount(b, w, minlength=n))[:-1] for w in (g[rows], h[rows], None))
                    gain = gl**2 / (hl + 1) + (sg - gl) ** 2 / (sh - hl + 1) - sg**2 / (sh + 1)
                    gain[(nl < LEAF) | (len(rows) - nl < LEAF)] = 0
                    if gain.max() > best[0]:
                        best = (float(gain.max()), k, int(gain.argmax()))
                value[node] = -RATE * sg / (sh + 1)
                if best[1] >= 0:
                    down = bins[rows, best[1]] > best[2]
                    feature[node], cut[node], left[node], right[node] = best[1], best[2], len(feature), len(feature) + 1
                    below |= {left[node]: rows[~down], right[node]: rows[down]}
                    for part in (rows[~down], rows[down]):
                        feature.append(-1), cut.append(0), left.append(0), right.append(0)
                        value.append(float(-RATE * g[part].sum() / (h[part].sum() + 1)))
            at = below
        tree = (np.array(feature), np.array(cut), np.array(left), np.array(right), np.array(value))
        model.trees.append(tree)
        raw = model.raw(bins) if len(model.trees) == 1 else raw + Boosted([tree], 0.0, cuts).raw(bins)
    return model


def rewritten(text: str, kind: str, a: int, b: int, draw: int) -> tuple[str, int, int] | None:
    """The text with a true span in a looser form of its kind, and where that stands."""
    s = text[a:b]
    if kind == "email":
        new = s.replace("@", LOOSE_AT[draw % len(LOOSE_AT)])
        if draw // 4 % 2 or new == s.replace("@", " at "):
            new = new.replace(".", (" dot ", "[dot]")[draw // 8 % 2])
    elif kind == "phone":
        new = (s.lstrip("+"), s.replace("(", "").replace(")", "").replace(" ", "-").lstrip("+"), s.replace(" ", ".").replace("(", "").replace(")", ""))[draw % 3]
    elif kind == "ip":
        new = s.replace(".", (" . ", "[.]", " dot ")[draw % 3])
    elif kind == "card":
        d = "".join(c for c in s if c.isdigit())
        new = "  ".join(d[i : i + 4] for i in range(0, len(d), 4)) if draw % 2 else ".".join(d[i : i + 4] for i in range(0, len(d), 4))
    else:
        return None
    return text[:a] + new + text[b:], a, a + len(new)


def wrong(kind: str, s: str, before: str = "") -> bool:
    """Whether a candidate that the base rules don't accept is surely none: a sentence, a bare number that no word announces, a wrong check digit, a part over 255."""
    if kind == "email":
        return " at " in s.lower() and "dot" not in s.lower()
    if kind == "card":
        return not luhn("".join(c for c in s if c.isdigit()))
    if kind == "ip":
        return ":" not in s and any(int(g[:9]) > 255 for g in RUN.findall(s))
    return (s.isdigit() and cued(kind, before) < 1) or any(len(g) == 4 and g[:2] in ("19", "20") for g in RUN.findall(s)) and cued(kind, before) < 2


#: Forms of made-up lines (fixed values): d is a digit, n one from 1 to 9, the rest stands for itself.
MADE = {
    ("phone", 1): ["ndd-ddd-dddd", "(ndd) ddd-dddd", "ndd.ddd.dddd", "ndd ddd dddd", "0ndd ddddddd", "0nd-ddddddd", "0nd/dddddddd", "0n dd dd dd dd", "0nddd dddddd", "00nd ndd ddddddd", "0ndd/ddd dd dd", "(0nd) ddddddd", "1-ndd-ddd-dddd", "ndd dddd dddd"],
    ("phone", 0): ["20dd-1d-2d", "19dd-0n-1d", "1d.0n.20dd", "2d.1d.19dd", "0n/1d/20dd", "20dd-20dd", "19dd-20dd", "19dd-19dd", "n ddd ddd ddd", "nd ddd ddd", "ndd ddd ddd", "nd.d nd.d nd.d nd.d", "n.dd n.dd n.dd", "978-d-dd-dddddd-d", "ndddddddd", "ndddddddddd", "20dd1d2d-1ddddd", "ndd-ndd ndd-ndd", "nd-nd nd-nd nd-nd", "nddd nddd", "20dd 20dd 20dd", "nd.ddd.ddd", "20dd-1d-2d 1d", "ndddd-dddd", "n-ddd-ddddd-d"],
    ("ip", 0): ["3dd.4dd.5dd.6dd", "n.n.n.n0dd", "n-n-n-n", "nd nd nd nd", "n n n n", "19d-20d-19d-20d", "ndd/ndd/ndd/ndd", "n.d.n.d", "n . n . n . n", "nd . n . n . nd", "n-nd-n-nd"],
}
BEFORE = ("the list of", "we saw", "it was in", "from", "after", "see", "about", "und dann", "le", "in", "")
AFTER = ("and then more", "in total", "was there", ", as before", ". Then it went on", "were found", "", "on the table")
LOOSE_AT = (" (at) ", "(at)", " [at] ", "[at]", " at ", " @ ", "{at}", " {at} ", "<at>", "[@]", " AT ")
LOOSE_DOT = (".", " dot ", " [dot] ", "[dot]", " (dot) ", "{dot}", " . ", "(.)", " DOT ")
#: What stands between a word that announces and what it announces.
ANNOUNCES = (" ", ": ", " no. ", " on ", " is ", " me on ", " number ", " at ", " number is ")
PLAIN_WORDS = ("home", "understanding", "river", "important", "yesterday", "committee", "garden", "forgotten", "between", "matter", "people", "noon", "wonderful", "unbelievable", "question")


COUNTS = tuple(sorted(COUNTED))


def with_check_digit(digits: str) -> str:
    return digits + next(c for c in "0123456789" if luhn(digits + c))


def made(seed: int = 11, times: int = 24) -> list[tuple[str, str, int, int, int]]:
    """(line, kind, start, end, y) by fixed forms and a seed: personal data and what has its shape."""
    rng = np.random.default_rng(seed)
    pick = lambda xs: xs[int(rng.integers(len(xs)))]
    fill = lambda form: "".join(str(rng.integers(10)) if c == "d" else str(rng.integers(1, 10)) if c == "n" else c for c in form)
    out = []

    def add(kind: str, value: str, y: int, near: bool | None) -> None:
        """near: a word of the kind announces it (true), no word does, or a word of counts (None)."""
        before = pick(COUNTS) + pick((" ", ": ", " no. ")) if near is None else pick(BEFORE) + " "
        if near:
            before = pick(("", "", "the ", "my ", "you can ", "please ")) + pick(WORDS[kind]) + pick(ANNOUNCES)
        line = before + value + pick((" ", "", ".", ", ")) + pick(AFTER)
        out.append((line, kind, len(before), len(before) + len(value), y))
        groups = [m.span() for m in RUN.finditer(value)]
        if kind == "phone" and y and len(groups) > 2:  # a number without its first or last group isn't whole
            for x, z in ((groups[1][0], groups[-1][1]), (0, groups[-2][1])):
                if sum(b - a for a, b in groups if a >= x and b <= z) > 6:
                    out.append((line, kind, len(before) + x, len(before) + z, 0))

    def grouped(n: int) -> str:
        """n digits in groups of two to four by one mark, or bare."""
        sizes = []
        while sum(sizes) < n - 4:
            sizes.append(int(rng.integers(2, 5)))
        sizes, mark = [*sizes, n - sum(sizes)], pick((" ", " ", "-", ".", "/"))
        return fill("d" * n if rng.random() < 0.3 else mark.join("d" * k for k in sizes if k))

    for (kind, y), forms in MADE.items():
        for form in forms:
            for k in range(times):
                # Bare digits and plain groups are a telephone's if a word says so, dates and counts in thousands are not.
                near = (None, False, True)[k % 3] if y == 0 else k % 3 > 0
                add(kind, fill(form), y, False if near and not y and not any(c in form for c in "019") and kind == "phone" else near)
    for _ in range(12 * times):
        value = grouped(int(rng.integers(7, 13)))
        add("phone", pick(("", "", "0", "(0)")) + value, 1, True)
        add("phone", grouped(int(rng.integers(7, 13))), 0, None)
        if value.isdigit():
            add("phone", value, 0, False)
        parts = [str(rng.integers(256)) for _ in range(4)]
        if max(map(int, parts)) > 9:
            mark = pick((".", " . ", "-", "[.]", "(.)", " dot ", "[dot]"))
            add("ip", mark.join(parts), 1, True if mark == "-" else rng.random() < 0.7)
            add("ip", pick((" . ", "-", " ")).join(parts), 0, None)
        v6 = [f"{rng.integers(1 << 16):x}" for _ in range(8)]
        add("ip", ":".join(v6) if rng.random() < 0.4 else ":".join(v6[: int(rng.integers(2, 5))]) + "::" + ":".join(v6[4 : int(rng.integers(5, 8))]), 1, rng.random() < 0.6)
        add("ip", "".join(pick("abcdef") for _ in range(3)) + "::" + "".join(pick("abcdef") for _ in range(3)), 0, False)
        # cards: 13 to 19 digits with and without their check digit, in groups and bare
        n = int(rng.integers(13, 20))
        good = with_check_digit(pick("3456") + "".join(str(rng.integers(10)) for _ in range(n - 2)))
        bad = good[:-1] + str((int(good[-1]) + int(rng.integers(1, 10))) % 10)
        group = pick((" ", "-", "  ", ".", "/", "_", " / ", " - "))
        form = lambda d: group.join(d[i : i + 4] for i in range(0, len(d), 4)) if len(d) == 16 else f"{d[:4]}{group[0]}{d[4:10]}{group[0]}{d[10:]}"
        add("card", form(good), 1, rng.random() < 0.7)
        add("card", form(bad), 0, rng.random() < 0.5)
        add("card", good, 1, True)
        add("card", good, 0, pick((None, False)))
        add("card", bad, 0, rng.random() < 0.5)
        add("card", fill("978-d-dd-dddddd-d"), 0, pick((None, False)))
        # addresses
        at, dot = (pick(LOOSE_AT), pick(LOOSE_DOT)) if rng.random() < 0.7 else (" at ", " dot ")
        user = pick(("jane", "max.mueller", "info", "a.b", "user", "contact", "k_lee", "svc-desk", f"jane{dot}doe")) + (str(rng.integers(100)) if rng.random() < 0.3 else "")
        host = pick(("mail", "example", "firma", "lake-house", "shop.example", "uni"))
        tld = "".join(pick("abcdefghijklmnopqrstuvwxyz") for _ in range(int(rng.integers(2, 7)))) if rng.random() < 0.4 else pick(("com", "org", "net", "de", "fr", "es", "io", "edu"))
        value = user + at + host.replace(".", dot) + dot + tld
        if at.strip().lower() != "at" or dot.strip() != ".":
            add("email", value.upper() if rng.random() < 0.15 else value, 1, rng.random() < 0.5)
        else:
            add("email", f"{user.replace(dot, '.')} at {host}.{tld}", 1, True)
        add("email", f"{pick(PLAIN_WORDS)} at {pick(PLAIN_WORDS)}{pick(('.', ' . ', '. '))}{pick(PLAIN_WORDS).capitalize()}", 0, False)
        if rng.random() < 0.3:
            add("email", f"{pick(PLAIN_WORDS)} at {pick(PLAIN_WORDS)} dot {pick(PLAIN_WORDS)}", 0, False)
        add("email", f"{pick(PLAIN_WORDS)} at {pick(PLAIN_WORDS)}.{rng.integers(100)}", 0, False)
        # secrets
        alphabet = pick(("0123456789abcdef", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "abcdefghijklmnopqrstuvwxyz0123456789_-", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"))
        value = "".join(pick(alphabet) for _ in range(int(rng.integers(10, 60))))
        name = pick(("", "", "client_", "db-", "X-Auth-")) + pick(WORDS["secret"]) + pick(("=", ": ", " = ", '="', '": "', " is ", " "))
        for value, y in ((value, int(mixed(value))), (pick(PLAIN_WORDS) + pick(("", "-", "_", "!")) + str(rng.integers(10, 999)) + pick(PLAIN_WORDS), 1), (pick(PLAIN_WORDS).capitalize() + pick("!#$%&*-_") + str(rng.integers(10, 9999)), 1),
                         ("-".join(pick(PLAIN_WORDS) for _ in range(int(rng.integers(2, 5)))), 0), (pick(PLAIN_WORDS) + pick((".", "", "_", "...")) + pick(PLAIN_WORDS), 0), (pick(PLAIN_WORDS), 0), ("-" * int(rng.integers(8, 30)), 0)):
            out.append((name + value + pick(("", " ", '"')) + pick(AFTER), "secret", len(name), len(name) + len(value), y))
        issued = pick(("AKIA", "ghp_", "glpat-", "xoxb-", "sk_live_", "eyJ")) + "".join(pick(alphabet) for _ in range(24))
        before = pick(BEFORE) + " "
        out.append((before + issued + " " + pick(AFTER), "secret", len(before), len(before) + len(issued), 1))
    return out


def made_rows() -> np.ndarray:
    """(held, y, features) of the made-up lines, a fifth of them held back."""
    held = np.random.default_rng(3).random(1 << 16) < 0.2
    return np.array([[float(held[k]), float(y), *describe(text, kind, a, b)] for k, (text, kind, a, b, y) in enumerate(made())])


def training_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(held, y, features) of candidates: 1 for spans of the base rules and their looser forms, 0 for what those rules reject.

    A secret is true if its value mixes letters and digits.  Candidates that
    overlap a base span without being one teach nothing.
    """
    for batch in batches:
        out = []
        for text in batch.column(0).to_pylist():
            mark = hashlib.sha256(text.encode()).digest()
            held, draw = float(mark[0] % 5 == 0), mark[1]
            base = base_spans(text)
            known = set(base)
            for kind, a, b in candidates(text):
                true = (kind, a, b) in known
                if kind == "secret":
                    true = mixed(text[a:b])
                elif not true and (any(x < b and y > a for _, x, y in base) or not wrong(kind, text[a:b], text[max(0, a - CONTEXT) : a])):
                    continue
                out.append([held, float(true), *describe(text, kind, a, b)])
                low = max(0, a - CONTEXT - 2)
                near, x, y = text[low : b + CONTEXT + 2], a - low, b - low
                if true and (new := rewritten(near, kind, x, y, draw)):
                    out.append([held, 1.0, *describe(new[0], kind, new[1], new[2])])
                if true and kind == "card":  # the same digits with a wrong check digit
                    out.append([held, 0.0, *describe(near[: y - 1] + str((int(near[y - 1]) + 3) % 10) + near[y:], kind, x, y)])
        cols = np.array(out, float).reshape(-1, FEATURES + 2).T
        yield pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(c)) for c in cols], names=NAMES)


NAMES = [f"c{k}" for k in range(FEATURES + 2)]


class Cover:
    """Disjoint intervals in order; overlapping ones that it begins with are merged."""

    def __init__(self, spans):
        self.starts, self.ends = [], []
        for a, b in sorted(spans):
            if self.ends and a < self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a), self.ends.append(b)

    def add(self, a: int, b: int) -> bool:
        """Whether [a, b) overlapped nothing; it is part of the cover then."""
        at = bisect.bisect_right(self.starts, a)
        if (at and self.ends[at - 1] > a) or (at < len(self.starts) and self.starts[at] < b):
            return False
        self.starts.insert(at, a), self.ends.insert(at, b)
        return True


class Model:
    """Boosted trees and the least probability with which a candidate of each kind is taken; without trees only base spans are found."""

    def __init__(self, trees: Boosted | None, least: dict[str, float]):
        self.trees, self.least = trees, least

    def spans(self, text: str) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
        """(base spans, all spans): base ones and, best first and of about equal ones the longest, accepted candidates that overlap none taken before."""
        base = base_spans(text)
        known, taken = set(base), list(base)
        if self.trees is not None and (more := [c for c in candidates(text) if c not in known]):
            p = self.trees(np.array([describe(text, *c) for c in more]))
            long = np.array([b - a for _, a, b in more])
            good = [i for i in np.lexsort((-long, -p.round(1))).tolist() if p[i] >= self.least[more[i][0]]]
            cover = Cover((a, b) for _, a, b in base)
            taken += [more[i] for i in good if cover.add(*more[i][1:])]
        order = (*KINDS, *MORE_KINDS).index
        return base, sorted(taken, key=lambda s: (order(s[0]), s[1], s[2]))


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS, train_rows: int = TRAIN_ROWS) -> Model:
    """Learn to choose candidates on about train_docs different documents that may hold any, drawn by a hash of the text, and train_rows candidates at most.

    Made-up lines stand beside them, whatever the corpus holds.
    """
    may = docs.select(text_of().alias("text")).filter(F.col("text").rlike(r"@|\+[0-9]|[0-9]{3}|[(\[{<]at[)\]}>]")).withColumn("draw", F.xxhash64("text"))
    sample = may.filter(drawn(F.col("draw"), may.select("draw").distinct().count(), train_docs)).dropDuplicates(["draw"]).select("text")
    rows = materialize(sample.mapInArrow(training_rows, ", ".join(f"{c} double" for c in NAMES)), "pii-rows")
    rows = rows.withColumn("draw", F.xxhash64(*NAMES)).orderBy("draw", *NAMES).limit(train_rows).toPandas()[NAMES].to_numpy()
    rows = np.concatenate([made_rows(), rows.reshape(-1, FEATURES + 2)])
    held, y, x = rows[:, 0] == 1, rows[:, 1], rows[:, 2:]
    trees = boost(x[~held], y[~held])
    p, least = trees(x[held]), {}
    for k, kind in enumerate((*KINDS, *MORE_KINDS)):
        of = np.flatnonzero(x[held][:, 0] == k)
        order = of[np.argsort(-p[of], kind="stable")]
        right = np.cumsum(y[held][order]) / np.arange(1, len(order) + 1)
        good = np.flatnonzero(right >= PRECISION)
        # Just above the first held-out candidate with which the precision falls for good; never under one half.
        if not len(good) or len(order) < 20:
            least[kind] = 0.9
        else:
            least[kind] = max(0.5, float(p[order[good[-1] + 1]]) + 1e-9) if good[-1] + 1 < len(order) else 0.5
    return Model(trees, least)


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span replaced by its kind in brackets; overlapping spans count as one, named by the first."""
    out, last = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= last:
            out += [text[last:a], f"[{kind.upper()}]"]
        last = max(last, b)
    return "".join(out) + text[last:]


FOUND = "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string, redacted string"


def find(docs: DataFrame, model: Model, id_col: str = "doc_id", text_out: bool = True) -> DataFrame:
    """(id, counts and digest of the base spans, all spans, the redacted text) for every row.

    Null text counts as empty and stays empty; a text without spans is its own
    redacted text.  Rows come back as they stand, repeated ones and null ids too;
    extra columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(1).to_pylist():
                base, spans = model.spans(text)
                kinds = [k for k, _, _ in base]
                out.append((*[kinds.count(k) for k in KINDS], hashlib.sha256(joined(base).encode()).hexdigest(), joined(spans), redacted(text, spans) if text_out else None))
            cols = list(zip(*out)) if out else [()] * 7
            kinds = [pa.int64()] * 4 + [pa.string()] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), *[pa.array(c, k) for c, k in zip(cols, kinds)]], names=[id_col, *[f.split()[0] for f in FOUND.split(", ")]])

    chosen = docs.select(id_col, text_of().alias("text"))
    schema = T.StructType([chosen.schema[id_col], *T.StructType.fromDDL(FOUND).fields])
    return chosen.mapInArrow(run, schema)


def redact(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with text_col redacted and every other column as it is; null stays null."""
    place = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            new = [None if t is None else redacted(t, model.spans(t)[1]) for t in batch.column(place).to_pylist()]
            cols = list(batch.columns)
            cols[place] = pa.array(new, cols[place].type)
            yield pa.RecordBatch.from_arrays(cols, names=batch.schema.names)

    return docs.mapInArrow(run, docs.schema)


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    return find(docs, fit(docs), text_out=False).drop("redacted")
