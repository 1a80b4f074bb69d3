"""Operator 1: personal data by candidate generation and gradient boosting."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomgraph.llm.boosting import BoostedTrees
from loomgraph.llm.common import small_batches, table

BASE = ["email", "ip", "card", "phone"]
#: Kinds that only the classifier adds: keys and passwords; account and identity numbers; other ways to reach somebody.
ADDED = ["secret", "account", "contact"]
#: Generated spans the trees are fitted on, and the precision thresholds are calibrated to.
TRAIN_SPANS = 12000
PRECISION = 0.99
#: Share of the held-out values behind key names that must be found, and the highest threshold for them.
KEYED_RECALL, MOST_KEYED = 0.9995, 0.2
_ROWS = 256

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_ZONE = re.compile(r"[+0-9][+0-9 ().\-]*")
_CHAIN = re.compile(r"[0-9]+(?:\.[0-9]+)*")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGITS = re.compile(r"[0-9]")

Span = tuple[str, int, int, float]


def luhn(digits: str) -> bool:
    """The check digit rule of card numbers."""
    total = 0
    for i, d in enumerate(reversed(digits)):
        n = int(d) * (1 + i % 2)
        total += n - 9 if n > 9 else n
    return total % 10 == 0


def _emails(text: str) -> Iterator[tuple[int, int]]:
    """The e-mail pattern's matches, found from each @ outwards, in linear time."""
    end, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCAL:
            start -= 1
        domain = _DOMAIN.match(text, at + 1) if start < at else None
        if domain:
            yield start, domain.end()
            end = domain.end()
        at = text.find("@", max(end, at + 1))


def _ips(zone: str) -> Iterator[tuple[int, int]]:
    """Four dotted numbers, leftmost and without overlap; those above 255 are dropped."""
    for chain in _CHAIN.finditer(zone):
        parts, at = chain.group().split("."), chain.start()
        for k in range(0, len(parts) - 3, 4):
            four = parts[k : k + 4]
            n = sum(map(len, four)) + 3
            if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in four):
                yield at, at + n
            at += n + 1


def base_spans(text: str, zones: list[re.Match]) -> list[Span]:
    """Spans of the four fixed patterns, by kind, then start."""
    found: dict[str, list[Span]] = {k: [] for k in BASE}
    for a, b in _emails(text):
        found["email"].append(("email", a, b, 1.0))
    for m in zones:
        zone, at = m.group(), m.start()
        if len(zone) < 7:
            continue
        for a, b in _ips(zone):
            found["ip"].append(("ip", at + a, at + b, 1.0))
        for c in _CARD.finditer(zone):
            if 13 <= len(c.group()) <= 40 and 13 <= len(d := re.sub("[ -]", "", c.group())) <= 19 and luhn(d):
                found["card"].append(("card", at + c.start(), at + c.end(), 1.0))
        for p in _PHONE.finditer(zone):
            if 9 <= len(_DIGITS.findall(p.group())) <= 15:
                found["phone"].append(("phone", at + p.start(), at + p.end(), 1.0))
    return [s for k in BASE for s in found[k]]


# Candidate generators: generous, overlapping, without validation and without a longest length.
_KEYED = re.compile(
    r"(?i)(?<![A-Za-z0-9])(?:password|passwd|passphrase|passcode|pwd|secret|token|credentials?|bearer|pin|(?:api|access|private|auth|session)[_ -]?(?:key|token|id))"
    r"(?:[_-][A-Za-z]{1,12})?[\"']?(?:\s{0,3}(?:=>|:=|==?|:)\s{0,3}|\s{1,3}(?:is|was)\s{1,3}|(?<=bearer)\s{1,3})"
    r"(?:\"(?P<double>[^\"\n]+)\"|'(?P<single>[^'\n]+)'|(?P<bare>\S{3,}))"
)
_KEY_STEMS = ("pass", "pwd", "secret", "token", "key", "credential", "bearer", "pin", "id")
_BLOCK, _BLOCK_END = re.compile(r"-----BEGIN [A-Z ]*PRIVATE KEY-----"), re.compile(r"-----END [A-Z ]*PRIVATE KEY-----")
_SPELT = re.compile(
    r"(?i)(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]+\s{0,3}(?:[\[({<]\s?at\s?[\])}>]|\sat\s)\s{0,3}[A-Za-z0-9-]+(?:\s{0,3}(?:[\[({<]\s?(?:dot|\.)\s?[\])}>]|\sdot\s|\.)\s{0,3}[A-Za-z0-9-]+)+"
)
_SPELT_HINT = re.compile(r"[\[({<]\s?(?:at|dot|\.)\s?[\])}>]|\sdot\s")
_GROUPED = re.compile(r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?(?![A-Za-z0-9])")
#: What makes a word more than plain prose: digits, inner capitals, joints or great length.
_ODD = re.compile(r"[0-9]|[a-z][A-Z]|[A-Z]{2}[a-z]|[_+/=-]|\S{24,}")
_WORD = re.compile(r"\S*")
_RUN = re.compile(r"[A-Za-z0-9_+/.~-]{12,}=*")
_OPEN, _CLOSE = "\"'([{<`", ".,;:!?)\"']}>`"
#: A run of digits, blanks and dashes beyond this length is a list, not one number.
_LONG_ZONE = 60
#: Numbers as they are usually grouped, else a word with its own dashes and dots.
_PIECE = re.compile(
    r"(?:\(|(?<![0-9]))[0-9]{3}\)[ .-]?[0-9]{3}[ .-][0-9]{4}(?![0-9])|(?<![0-9])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9]{3}([ .-])[0-9]{3}\1[0-9]{4}|00[0-9]{2} [0-9]{3} [0-9]{7}"
    r"|0[0-9]{3} [0-9]{3} [0-9]{4}|[0-9]{4}([ -])[0-9]{4}\2[0-9]{4}\2[0-9]{4})(?![0-9])|\+[0-9]{1,3}(?:[ .-]?\(?[0-9]{1,4}\)?){2,6}(?![0-9])|[0-9][0-9.()-]*"
)
#: Words around a span that tell what it may be; fixed values.
_CUES = [
    ("call", "phone", "tel", "mobile", "fax", "contact", "whatsapp", "reach", "text", "dial"),
    ("password", "passwd", "pwd", "secret", "token", "key", "credential", "login", "bearer"),
    ("account", "iban", "ssn", "passport", "security", "tax", "id", "social", "bank"),
    ("version", "page", "chapter", "figure", "license", "section", "room", "release", "commit", "hash"),
    ("order", "invoice", "ref", "isbn", "item", "serial", "price", "total", "pages"),
]
#: Values that stand for no value; fixed values.
_NO_VALUE = frozenset("none null nil true false required optional enter empty yes no string hidden missing invalid incorrect wrong reset expired changed valid the a an see your".split())
_GENERATORS = {"zone": 0, "token": 1, "keyed": 2, "spelt": 3, "block": 4}

#: (generator, kind if accepted, start, end, start of the value inside, its end)
Candidate = tuple[str, str, int, int, int, int]


def _numbers(zone: str) -> Iterator[tuple[int, int]]:
    """A zone as one number unless it is a long list, and its number-shaped pieces; words of few digits in between join."""
    if len(zone.rstrip(" ().-+")) <= _LONG_ZONE:
        yield 0, len(zone)
    short: list[tuple[int, int, int]] = []  # words of under 7 digits since the last piece
    for m in _PIECE.finditer(zone):
        digits = len(_DIGITS.findall(m.group()))
        if digits >= 7:
            yield m.span()
            short = []
            continue
        short.append((m.start(), m.end(), digits))
        if sum(n for *_, n in short) >= 7:
            yield short[0][0], m.end()
            short = []


def _tokens(text: str) -> Iterator[Candidate]:
    """Words with digits, inner capitals or joints, without their quotes, and the runs of key characters inside."""
    end = 0
    for m in _ODD.finditer(text):
        a = m.start()
        if a < end:
            continue
        while a > end and not text[a - 1].isspace():
            a -= 1
        end = _WORD.match(text, m.start()).end()
        if end - a < 8:
            continue
        word = text[a:end].lstrip(_OPEN)
        a, word = end - len(word), word.rstrip(_CLOSE)
        if len(word) >= 8 and any(c.isalpha() for c in word):
            yield "token", "secret", a, a + len(word), a, a + len(word)
            for r in _RUN.finditer(word):
                if len(r.group()) < len(word):
                    yield "token", "secret", a + r.start(), a + r.end(), a + r.start(), a + r.end()


def candidates(text: str, zones: list[re.Match]) -> list[Candidate]:
    """The spans that all generators propose."""
    out: list[Candidate] = []
    for m in zones:
        if len(m.group()) < 7:
            continue
        for x, y in dict.fromkeys(_numbers(m.group())):
            trimmed = m.group()[x:y].rstrip(" ().-+")
            if len(_DIGITS.findall(trimmed)) >= 7:
                kind = "account" if re.fullmatch(r"[0-9]{3}-[0-9]{2}-[0-9]{4}|[0-9 -]{16,}", trimmed) else "contact"
                a = m.start() + x
                out.append(("zone", kind, a, a + len(trimmed), a, a + len(trimmed)))
    out += _tokens(text)
    out += [("token", "account", *m.span(), *m.span()) for m in _GROUPED.finditer(text)]
    low = text.lower()
    if any(sign in low for sign in "=:>") or " is " in low or " was " in low or "bearer" in low:
        keyed = any(stem in low for stem in _KEY_STEMS)
    else:
        keyed = False
    if keyed:
        for m in _KEYED.finditer(text):
            a, b = next(m.span(g) for g in ("double", "single", "bare") if m.group(g) is not None)
            bare = m.group("bare") is not None
            end = b if bare else m.end()
            if bare and text[b - 1] in ".,;" and b - a > 3:
                b, end = b - 1, end - 1
            out.append(("keyed", "secret", m.start(), end, a, b))
    if "-----BEGIN" in text:
        at = 0
        while (m := _BLOCK.search(text, at)) and (e := _BLOCK_END.search(text, m.end())):
            out.append(("block", "secret", m.start(), e.end(), m.end(), e.start()))
            at = e.end()
    if any(sign in low for sign in ("at]", "at)", "at}", "at>", "dot")) and _SPELT_HINT.search(low):
        out += [("spelt", "contact", *m.span(), *m.span()) for m in _SPELT.finditer(text)]
    return out


def _mod97(s: str) -> bool:
    s = re.sub(r"[^A-Za-z0-9]", "", s).upper()
    return 14 < len(s) <= 34 and s.isascii() and int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97 == 1


_DATE = re.compile(r"(?:19|20)[0-9]{2}[-./ ][01]?[0-9][-./ ][0-3]?[0-9]|[0-3]?[0-9][-./ ][01]?[0-9][-./ ](?:19|20)[0-9]{2}")
_LINK = re.compile(r"(?:https?:|www\.|/|\w+\.(?:com|org|net)/)")
_UUID = re.compile(r"[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}")
_PREFIXED = re.compile(r"[A-Za-z]{2,6}[_-][A-Za-z0-9_-]{12,}|eyJ[A-Za-z0-9_-]{12,}|AIza[A-Za-z0-9_-]{12,}|A[KS]IA[A-Z0-9]{12,}")
#: Counts are told apart up to this size, so that longer spans are judged alike.
_MOST = 64


def features(text: str, candidate: Candidate) -> list[float]:
    """Format of the value and context on both sides, as numbers."""
    generator, _, start, end, a, b = candidate
    s = text[a:b]
    n = len(s) or 1
    digits, upper, lower = len(_DIGITS.findall(s)), sum(map(str.isupper, s)), sum(map(str.islower, s))
    groups = [len(g) for g in re.findall(r"[0-9]+", s)] or [0]
    words = [len(g) for g in re.findall(r"[^\W\d_]+", s)] or [0]
    letters = [c for c in s.lower() if c.isalpha()]
    joints = len(re.findall(r"[a-z][A-Z0-9]|[A-Z][0-9]|[0-9][A-Za-z]", s))
    counts = np.fromiter(Counter(s).values(), float) / n
    vowels = sum(c in "aeiou" for c in letters)
    alternating = sum((x in "aeiou") != (y in "aeiou") for x, y in zip(letters, letters[1:]))
    before = re.findall(r"[a-z]+", text[max(0, start - 40) : start].lower())[-3:]
    after = re.findall(r"[a-z]+", text[end : end + 40].lower())[:3]
    joint = text[start:a].rstrip("\"' ")
    plain = re.sub(r"[^0-9]", "", s) if n <= 40 else ""
    inside = s.lower() if n <= 40 else ""
    no_value, quoted = inside.strip(".,;:!?") in _NO_VALUE, a > 0 and text[a - 1] in "\"'"
    set_by_sign = generator == "keyed" and not no_value and (joint.endswith("=") or quoted)
    most = lambda v: float(min(v, _MOST))
    return [
        most(n), most(digits), most(upper), most(lower), most(n - digits - upper - lower),
        digits / n, upper / n, lower / n,
        most(len(groups)), most(max(groups)), most(min(groups)), most(groups[-1]),
        most(len(words)), most(max(words)),
        float(-(counts * np.log2(counts)).sum()), len(counts) / n, joints / n,
        vowels / (len(letters) or 1), alternating / max(1, len(letters) - 1),
        most(s.count("-")), most(s.count(".")), most(s.count(" ")), most(s.count("/")), most(s.count(":")), most(s.count("_")),
        float("(" in s), float(s[:1] == "+"), float("=" in s), float("@" in s),
        float(13 <= len(plain) <= 19 and luhn(plain)), float(_mod97(s)),
        float(bool(_DATE.match(s))), float(bool(_LINK.match(s))), float(bool(_UUID.fullmatch(s))), float(bool(_PREFIXED.match(s))),
        float(bool(re.fullmatch(r"[0-9a-fA-F]+", s))), float(bool(re.search(r"\.[a-z]{2,5}$", s))),
        *(float(any(w in cue for w in before)) for cue in _CUES),
        *(float(any(w in cue for w in after)) for cue in _CUES),
        float(no_value), float(inside.isalpha()), float(set_by_sign), float(generator == "keyed" and not no_value and not s.isalpha()),
        float("_" in joint or "-" in joint), float(joint.endswith("=")), float(joint.endswith((":", ">"))), float(quoted),
        float(text[start - 1 : start] in ("=", ":", "?", "&") if start else 0), float(text[end : end + 1] == "("),
        *(float(generator == g) for g in _GENERATORS),
    ]


def _generated(rng: np.random.Generator, rows: int) -> Iterator[tuple[str, int, int, bool]]:
    """Made-up sentences with one span each: (text, start, end, whether it is private)."""
    d = lambda n: "".join(map(str, rng.integers(0, 10, n)))
    pick = lambda *x: x[int(rng.integers(len(x)))]
    chars = lambda pool, n: "".join(pool[i] for i in rng.integers(0, len(pool), n))
    low, up, num = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    word = lambda: chars("eeeaaaiiooutnshrdlcm" + low, int(rng.integers(2, 9)))
    size = lambda least: int(least * float(np.exp(rng.exponential(0.8))))
    key = lambda: pick("password", "passwd", "pwd", "secret", "token", "api_key", "access_key", "auth-token", "PASSWORD", "Token", "client_secret", "db_password")

    def value() -> str:
        return pick(
            chars(low + num + up + "!#$%", size(6)), chars(low + num + up + 4 * "!#$%&*+/-_@?", size(6)), f"{word()}@{word()}.{pick('com', 'org')}{pick('!', '#', '')}{d(2)}", chars(low, size(5)), chars(low + num, size(5)), chars("abcdef" + num, size(12)), chars(num, size(4)),
            word() + d(int(rng.integers(1, 5))), word().capitalize() + word() + d(2) + pick("", "!", "?", "x"), chars(low + up + num + "+/", size(16)) + pick("", "=", "=="),
        )

    def iban() -> str:
        body = d(18)
        check = 98 - int(body + "131400") % 97  # DE is 13 14
        s = f"DE{check:02d}{body}"
        return s if rng.random() < 0.5 else " ".join(s[i : i + 4] for i in range(0, len(s), 4))

    def free() -> str:
        return pick("ghp_", "sk-", "xoxb-", "glpat-", "pk_live_", "AIza", "eyJ") + chars(pick(low + up, low + up + num, low + up + num + "_"), size(20))

    private = [
        lambda: (pick("call", "phone", "tel", "mobile", "", "reach me on"), pick(f"({d(3)}) {d(3)}-{d(4)}", f"{d(3)}-{d(3)}-{d(4)}", f"{d(3)}.{d(3)}.{d(4)}", f"00{d(2)} {d(3)} {d(7)}", f"0{d(3)} {d(3)} {d(4)}")),
        lambda: (pick("ssn", "security", "id", "tax", ""), f"{d(3)}-{d(2)}-{d(4)}"),
        lambda: (pick("iban", "account", ""), iban()),
        lambda: ("", f"{key()}{pick('=', ' = ', ': ', ':', ' := ')}{value()}"),
        lambda: ("", f"{key()}{pick('=', ' = ', ': ')}{pick(chr(34), chr(39))}{value()}"),
        lambda: ("", f'{key()}": "{value()}'),
        lambda: ("", f"{key()}{pick('=', ' = ', ': ', ':')}{chars(pick(low + num, num, low + num + up) + int(rng.integers(1, 40)) * '!#$%&*+/-_@?', int(rng.integers(4, 13)))}"),
        lambda: ("", f"{key()}{pick('=', ' = ', ': ')}{pick(chr(34), chr(39))}{chars(pick(low + num, num, low + num + up, '') + int(rng.integers(1, 40)) * '!#$%&*+/-_@?', int(rng.integers(4, 13)))}"),
        lambda: ("", f"{key()}={chars(pick(low, low + num + up), int(rng.integers(4, 12)))}"),
        lambda: ("", f"{key()}{pick('=', ' = ')}{chars(low + num + up, int(rng.integers(4, 8)))}"),
        lambda: ("", f"{pick('api_key', 'access_key', 'client_secret', 'db_password', 'auth-token')}{pick(': ', '=', ':')}{chars(pick(low, low + num + up), int(rng.integers(4, 16)))}"),
        lambda: (pick("my", "the", "your"), f"{pick('password', 'pwd', 'pin', 'passcode')} {pick('is', 'was')} {pick(word() + d(2), chars(low + num + up, size(6)), d(4), word().capitalize() + d(3))}{pick('', '!')}"),
        lambda: (pick("key", "", "", "token", "bearer"), pick("AKIA", "ASIA") + chars(up + num, 16)),
        lambda: (pick("token", "", "", "key"), free()),
        lambda: (f"https://{word()}.com/{word()}?", f"{pick('token', 'secret', 'access_token')}={chars(low + up + num, size(16))}"),
        lambda: (pick("the token", "our secret", "login key", "password was"), chars(low + up + num, size(14))),
        lambda: (pick("write", "mail", ""), f"{word()}{pick('', '.' + word())} {pick('(at)', '[at]', '{at}', 'at')} {word()} {pick('(dot)', '[dot]', 'dot')} {pick('com', 'org', 'net')}"),
        lambda: ("", f"-----BEGIN {pick('RSA ', '', 'EC ')}PRIVATE KEY-----\n{chars(low + up + num + '+/', size(4))}\n-----END {pick('RSA ', '', 'EC ')}PRIVATE KEY-----"),
    ]
    public = [
        lambda: (pick("on", "since", "", "the"), pick(f"{rng.integers(1900, 2100)}-{rng.integers(1, 13):02d}-{rng.integers(1, 29):02d}", f"{rng.integers(1, 29)}.{rng.integers(1, 13)}.{rng.integers(1900, 2100)}", f"{rng.integers(1900, 2100)}-{rng.integers(1900, 2100)}")),
        lambda: (pick("version", "release", ""), f"{d(1)}.{d(2)}.{d(int(rng.integers(1, 5)))}"),
        lambda: (pick("order", "invoice", "ref", "item", "serial", ""), d(int(rng.integers(7, 13)))),
        lambda: (pick("isbn", ""), f"978-{d(1)}-{d(4)}-{d(4)}-{d(1)}"),
        lambda: ("", " ".join(d(int(rng.integers(1, 4))) for _ in range(int(rng.integers(4, 9))))),
        lambda: (pick("total", "price", ""), f"{d(3)}.{d(3)}.{d(3)}.{d(2)}"),
        lambda: ("", f"https://{word()}.{pick('com', 'org')}/{word()}/{pick(d(4), word() + '-' + word(), word().upper())}?{word()}={pick(d(3), word())}"),
        lambda: ("", f"{word()}{d(int(rng.integers(1, 4)))}.{word()}_{word()}.{pick('pdf', 'txt', 'html', 'py')}"),
        lambda: ("", "-".join(word() for _ in range(int(rng.integers(2, 7)))) + pick("", d(1))),
        lambda: ("", "_".join(word() for _ in range(int(rng.integers(2, 5))))),
        lambda: ("", f"{word()}/{word()}/{word()}-{word()}"),
        lambda: ("", f"{word().capitalize()}{word()}{word()}{d(int(rng.integers(1, 5)))}"),
        lambda: ("", "".join(word().capitalize() for _ in range(int(rng.integers(2, 5)))) + pick("", "(", ".")),
        lambda: ("", "".join(word() for _ in range(int(rng.integers(4, 9))))),
        lambda: ("", f"{word()}.{word()}.{word()}.{word()}()"),
        lambda: (pick("commit", "hash", "", "sha"), chars("abcdef" + num, pick(32, 40, 64))),
        lambda: ("", "-".join(chars("abcdef" + num, n) for n in (8, 4, 4, 4, 12))),
        lambda: ("", f"{pick('key', 'token', 'secret', 'password', 'pin', 'Password')}{pick(': ', ' is ', ' = ', '=')}{pick(*sorted(_NO_VALUE))}"),
        lambda: ("", f"{pick('token', 'secret', 'password', 'credential')}{pick(': ', ' is ', ' was ')}{word()}"),
        lambda: ("", f"{word()} {pick('token', 'secret', 'password')} {word()} {word()}-{word()}"),
        lambda: ("", f"{d(int(rng.integers(2, 4)))}%&*{word()}###{word()}{d(2)}$$$"),
        lambda: ("", "".join(pick("!!!", "###", "$$$", "%&*", word(), d(2)) for _ in range(int(rng.integers(5, 12))))),
        lambda: ("", f"{word()}{pick('=', ':')}{word()}{pick(',', ';', '&')}{word()}{pick('=', ':')}{d(2)}"),
        lambda: ("", pick("=", "-", "*", "_") * int(rng.integers(8, 60)) + pick("", word())),
    ]
    for _ in range(rows):
        yes = bool(rng.random() < 0.5)
        cue, span = pick(*(private if yes else public))()
        lead = " ".join([word() for _ in range(int(rng.integers(0, 6)))] + [cue] * bool(cue))
        lead += pick(" ", " ", " ", ": ", " \"", " (") if lead and not cue.endswith("?") else ""
        close = {'"': '"', "(": ")"}.get(lead[-1:], "")
        if yes and (quote := re.search("[\"']", span)) and not span.endswith(quote.group()):
            span += quote.group()
        yield lead + span + close + pick("", ".", ",", " ") + " " + " ".join(word() for _ in range(int(rng.integers(0, 4)))), len(lead), len(lead) + len(span), yes


class PiiModel:
    """Boosted trees over candidates with one calibrated threshold per generator and added kind."""

    def __init__(self, spans: int = TRAIN_SPANS, precision: float = PRECISION, seed: int = 11):
        rng = np.random.default_rng(seed)
        x, y, kinds = [], [], []
        for text, start, end, private in _generated(rng, spans):
            for c in candidates(text, list(_ZONE.finditer(text))):
                x.append(features(text, c))
                y.append(private and c[2] < end and c[3] > start and min(c[3], end) - max(c[2], start) >= 0.6 * (end - start))
                kinds.append(c[:2])
        x, y = np.array(x), np.array(y, float)
        cut = 2 * len(y) // 3
        self.trees = BoostedTrees().fit(x[:cut], y[:cut])
        p = self.trees.probability(x[cut:])
        self.thresholds = {}
        for kind in set(kinds):
            mine = np.array([k == kind for k in kinds[cut:]])
            own, truth = p[mine], y[cut:][mine]
            order = np.argsort(-own)
            right = np.cumsum(truth[order]) / np.arange(1, len(own) + 1)
            good = np.flatnonzero(right >= precision)
            if kind[0] == "keyed":  # a key name announces its value: recall comes first
                self.thresholds[kind] = min(MOST_KEYED, float(np.quantile(own[truth > 0], 1 - KEYED_RECALL))) if truth.any() else MOST_KEYED
                continue
            reached = 0.5 if len(good) == len(own) else float(own[order][good[-1]]) if len(good) else 2.0
            self.thresholds[kind] = max(0.5, reached)

    def spans(self, text: str) -> list[Span]:
        return self.spans_of([text])[0]

    def spans_of(self, texts: list[str | None]) -> list[list[Span]]:
        """Of each text the base spans by kind and start, then the added ones."""
        zones = [list(_ZONE.finditer(t or "")) for t in texts]
        base = [base_spans(t, z) if t else [] for t, z in zip(texts, zones)]
        found = [candidates(t, z) if t else [] for t, z in zip(texts, zones)]
        rows = [features(t, c) for t, own in zip(texts, found) for c in own]
        p = iter(self.trees.probability(np.array(rows)).tolist() if rows else ())
        return [b + self._added(b, [(c, next(p)) for c in own]) for b, own in zip(base, found)]

    def _added(self, base: list[Span], scored: list[tuple[Candidate, float]]) -> list[Span]:
        """Accepted candidates; those that overlap become their common hull, so none is left in part.

        Inside base spans nothing is added; a secret that reaches beyond one is.
        """
        chosen = sorted((c[2], c[3], q, c[1]) for c, q in scored if q >= self.thresholds.get(c[:2], 2.0))
        taken, first = sorted((a, b) for _, a, b, _ in base), 0
        hulls: list[list] = []
        for a, b, q, kind in chosen:
            while first < len(taken) and taken[first][1] <= a:
                first += 1
            beyond = first
            while beyond < len(taken) and taken[beyond][0] < b:
                beyond += 1
            near = taken[first:beyond]
            if any(e > a for _, e in near) and (kind != "secret" or any(s <= a and b <= e for s, e in near)):
                continue
            if hulls and a < hulls[-1][1]:
                last = hulls[-1]
                last[1] = max(last[1], b)
                if q > last[2]:
                    last[2:] = [q, kind]
            else:
                hulls.append([a, b, q, kind])
        added = [(kind, a, b, q) for a, b, q, kind in hulls]
        return sorted(added, key=lambda s: (ADDED.index(s[0]), s[1]))


@lru_cache(maxsize=1)
def model() -> PiiModel:
    return PiiModel()


_SPANS = T.ArrayType(
    T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType()), T.StructField("score", T.DoubleType())])
)
_ARROW_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))


def redacted(text: str, spans: list[Span]) -> str:
    """The text with each stretch of overlapping spans replaced by its first span's kind in brackets."""
    out, end = [], 0
    for kind, a, b, _ in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= end:
            out += [text[end:a], f"[{kind.upper()}]"]
        end = max(end, b)
    return "".join([*out, text[end:]])


def find_pii(docs: DataFrame, text_col: str = "text", spans_col: str = "pii_spans", redact: bool = False) -> DataFrame:
    """Add spans_col: array of (kind, start, end, score), in code points, end exclusive.

    Base kinds (email, ip, card, phone) follow fixed patterns and have score 1; secret, account and
    contact spans are candidates whose probability reaches the calibrated threshold of their generator and kind, overlapping
    ones as their hull. Candidates and spans have no longest length. Spans are ordered by kind,
    then start. With redact the text is replaced by its redaction.

    Behind a key name (password, passwd, pwd, secret, token, api key, access key, credential and their compounds) and a sign a value is
    taken whole if quoted, else up to the first blank: of a pass phrase without quotes only the first word is. A value that follows a key
    name without a sign, "is" or "was" is found only by its own form.

    Defined cases: null text has no spans and stays null; texts of any length are read whole, in
    linear time; rows that repeat are treated alike; of equally likely overlapping candidates
    the earlier names the kind; an empty table gives an empty result; all columns stay, and spans_col
    must not name one of them.
    """
    if spans_col in docs.columns:
        raise ValueError(f"{spans_col} is a column already")
    fitted = docs.sparkSession.sparkContext.broadcast(model())  # fitted on TRAIN_SPANS spans
    schema = T.StructType([*docs.schema.fields, T.StructField(spans_col, _SPANS)])
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = fitted.value.spans_of
        for batch in batches:
            for lo in range(0, batch.num_rows, _ROWS):
                part = batch.slice(lo, _ROWS)
                texts = part.column(at).to_pylist()
                spans = find(texts)
                columns = part.columns
                if redact:
                    columns[at] = pa.array([redacted(t, s) if s else t for t, s in zip(texts, spans)], batch.schema.field(at).type)
                rows = [[{"kind": k, "start": a, "end": b, "score": float(q)} for k, a, b, q in s] for s in spans]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(rows, _ARROW_SPANS)], schema.names)

    return small_batches(docs).mapInArrow(run, schema)


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The personal data in every whole text of documents."""
    found = find_pii(table(spark, sf_dir, "documents").select("doc_id", "text")).drop("text")
    joined = lambda spans: F.array_join(
        F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ","
    )
    base = F.filter("pii_spans", lambda s: s["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("pii_spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *(count(k).alias(f"n_{k}") for k in BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("pii_spans")).alias("spans"),
        *(count(k).alias(f"n_{k}") for k in ADDED), F.size("pii_spans").cast("long").alias("n_spans"),
    )
