"""Personal data spans: exact base patterns plus boosted candidates.

Base spans follow fixed patterns and always stay.  For what they miss (numbers
that run into each other, spans in other notations, written-out addresses),
high-recall generators propose overlapping candidates; boosted trees, one model
for each kind, score them by format and context; those at or above a threshold
calibrated on held-out candidates are taken, the longest first, where they overlap
no span that is already there.  The models are trained on generated
candidates with a fixed seed, so they are the same everywhere.

Cases: null and empty texts have no spans; texts of any length are read whole, in
time that grows with their length times the logarithm of the number of spans; equal texts give equal spans; ties between
candidates go to the higher score, then the earlier one; tables may be empty and may
have other columns, which pass through.
"""

from __future__ import annotations

import bisect
import functools
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from . import boost
from .work import small_batches

KINDS = ("email", "ip", "card", "phone")
PRECISION = 0.98
_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCAL_TAIL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
_IP = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]+)(?:\.[0-9]+)(?:\.[0-9]+)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")

#: One of these, in lower case, is in every written-out address.
_AT = (" at ", "[at]", "(at)", "[at)", "(at]")
#: The candidate generators: kind, pattern, and strings of which lower-cased text must have one for a match.
_GENERATORS = tuple(
    (kind, re.compile(pattern, re.I), needs)
    for kind, pattern, needs in (
        ("email", r"(?<![\w.+-])[\w.+-]{1,64}(?: at |\s?[\[(]at[\])]\s?)[\w-]{1,63}(?:(?: dot |\s?[\[(]dot[\])]\s?|\.)[\w-]{2,63}){1,4}", _AT),
        ("email", r"(?<![\w.+%-])[\w.+%-]{1,64}\s?@\s?[\w-]{1,63}(?:\s?\.\s?[\w-]{2,63}){1,4}", ("@",)),
        ("ip", r"(?<![\d.])\d{1,3}(?:\.\d{1,3}){3}(?![\d.])", (".",)),
        ("ip", r"(?<![\d.])\d{1,3}(?:\s?[\[(]\.[\])]\s?\d{1,3}){3}(?!\d)", (".",)),
        ("ip", r"(?<![\w:])(?:[0-9a-f]{1,4}:){7}[0-9a-f]{1,4}(?![\w:])", (":",)),
        ("card", r"(?<!\d)\d{13,19}(?!\d)", ("",)),
        ("card", r"(?<!\d)\d{4}([ .\-])\d{4}\1\d{4}\1\d{4}(?!\d)", ("",)),
        ("card", r"(?<!\d)3[47]\d{2}([ .\-])\d{6}\1\d{5}(?!\d)", ("",)),
        ("phone", r"\+\d{1,3}[ .\-]?\(?\d{2,4}\)?[ .\-]?\d{3,4}[ .\-]?\d{3,4}(?!\d)", ("+",)),
        ("phone", r"(?<!\d)\(\d{3}\)\s?\d{3}[ .\-]\d{4}(?!\d)", ("(",)),
        ("phone", r"(?<![\d.\-])\d{3}([.\-])\d{3}\1\d{4}(?![\d])", ("",)),
        ("phone", r"(?<!\d)00\d{1,3}[ .\-/]\d{2,4}(?:[ .\-/]\d{2,4}){2,3}(?!\d)", ("00",)),
    )
)
#: Words before a span that speak for its kind, and words that speak against personal data.
_FOR = {
    "email": ("mail", "contact", "write", "correo", "courriel", "kontakt"),
    "ip": ("ip", "host", "server", "address", "adresse", "login"),
    "card": ("card", "visa", "credit", "karte", "carte", "tarjeta", "pay"),
    "phone": ("phone", "tel", "call", "fax", "mobil", "ruf", "whatsapp"),
}
_TOP = ("com", "de", "edu", "es", "eu", "fr", "gov", "info", "io", "it", "net", "nl", "org", "uk")
_AGAINST = ("version", "isbn", "order", "invoice", "serial", "build", "release", "chapter", "section", "id", "no.", "nr", "sku", "ref", "total", "rev", "v.")


def luhn(digits: str) -> bool:
    total = 0
    for i, c in enumerate(reversed(digits)):
        v = int(c) * (1 + i % 2)
        total += v - 9 * (v > 9)
    return total % 10 == 0


def base_spans(text: str | None) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each kind that pass its check, by kind and start."""
    text = text or ""
    out: list[tuple[str, int, int]] = []
    at, p = 0, text.find("@")
    while p >= 0:
        start = p
        while start > at and _LOCAL.match(text, start - 1):
            start -= 1
        if start < p and (m := _DOMAIN.match(text, p + 1)):
            out.append(("email", start, m.end()))
            at = m.end()
        else:
            at = max(at, p + 1)
        p = text.find("@", at)
    if not _DIGIT.search(text):
        return out
    out += [("ip", *m.span()) for m in _IP.finditer(text) if all(len(x := part.lstrip("0")) <= 3 and int(x or "0") <= 255 for part in m[0].split("."))]
    for m in _CARD.finditer(text):
        if 16 <= m.end() - m.start() and 16 <= len(digits := m[0].replace(" ", "").replace("-", "")) <= 19 and luhn(digits):
            out.append(("card", *m.span()))
    if "+" in text:
        out += [("phone", *m.span()) for m in _PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15]
    return out


def candidates(text: str) -> list[tuple[str, int, int]]:
    """What the generators propose; spans may overlap and repeat formats."""
    digits = _DIGIT.search(text) is not None
    low = text.lower()
    if not digits and "@" not in text and not any(n in low for n in _AT):
        return []
    out = []
    for kind, pattern, needs in _GENERATORS:
        if (digits or kind == "email") and any(n in low for n in needs):
            at = 0
            while m := pattern.search(text, at):
                out.append((kind, *m.span()))
                at = m.end() if kind in ("email", "phone") else m.start() + max(1, (m.end() - m.start()) // 2)
    return list(dict.fromkeys(out))


def features(text: str, kind: str, start: int, end: int) -> list[float]:
    """Format and context of a candidate."""
    s = text[start:end]
    digits = "".join(c for c in s if c.isdigit() and c.isascii())
    groups = [len(g) for g in re.findall(r"\d+", s)]
    before, left = text[max(0, start - 24) : start].lower(), text[start - 1 : start]
    right = text[end : end + 1]
    parts = re.findall(r"\d+", s) if kind == "ip" else []
    return [
        len(s), len(digits), len(groups), max(groups, default=0), min(groups, default=0), s.startswith("+"), s.count("(") + s.count("["), s.count("."), s.count("-"), s.count(" "), s.count(":"),
        float(16 <= len(digits) <= 19 or len(digits) in (13, 14, 15)) * float(bool(digits) and luhn(digits)), max((min(int(p), 9999) for p in parts), default=-1), sum(p.startswith("0") and len(p) > 1 for p in parts),
        digits[:1] in tuple("3456"), len(set(digits)), left.isalnum(), right.isalnum(), left in tuple("#$€-/.:="), right in tuple("-/%.€") and text[end + 1 : end + 2].isdigit(),
        any(w in before for w in _FOR[kind]), any(w in before for w in _AGAINST), "@" in s or "at" in s.lower(), s.lower().count("dot"), sum(c.isalpha() for c in s) / len(s), s[-4:].lower().lstrip(" .)]").isalpha(), groups[-3:] == [3, 3, 4],
        re.split(r"[^a-z]+", s.lower().rstrip(")]"))[-1] in _TOP,
    ]


def _generated(seed: int, n: int) -> list[tuple[str, str, int, int, int]]:
    """Labelled candidates in made-up contexts: kind, text, start, end, label."""
    rng = np.random.default_rng(seed)
    num = lambda k: "".join(map(str, rng.integers(0, 10, k)))
    word = lambda k=6: "".join(rng.choice(list("aeioulnrstbcdfgmp"), int(rng.integers(2, k + 1))))
    octet = lambda top=256: str(rng.integers(0, top))

    def card(first: str, size: int) -> str:
        body = first + num(size - 1 - len(first))
        return body + next(d for d in "0123456789" if luhn(body + d))

    def unluhn(size: int) -> str:
        while luhn(x := num(size)):
            pass
        return x

    four = lambda x, sep: sep.join(x[i : i + 4] for i in range(0, 16, 4))
    sep = lambda opts: str(rng.choice(list(opts)))
    make = {
        "email": ([lambda: f"{word()} at {word()} dot com", lambda: f"{word()}[at]{word()}[dot]{sep(['org', 'net', 'de'])}", lambda: f"{word()}.{word()} (at) {word()} (dot) com", lambda: f"{word()}.{num(2)}@{word()}{num(1)}.example.com", lambda: f"{word()} @ {word()}.com", lambda: f"{word()}é@{word()}.fr"], [lambda: f"{word()} at {word()}. {word()} dot {word()}{word()}", lambda: f"{word()} at the dot {word()}", lambda: f"{word()} @ {word()} . {word()}{word(4)}"]),
        "ip": ([lambda: ".".join(octet() for _ in range(4)), lambda: "[.]".join(octet() for _ in range(4)), lambda: ":".join(f"{rng.integers(0, 65536):x}" for _ in range(8))], [lambda: ".".join([octet(), octet(), octet(), str(rng.integers(256, 999))]), lambda: ".".join(str(rng.integers(300, 999)) for _ in range(4)), lambda: f"{octet(10)}.{octet(10)}.00.0{octet(10)}"]),
        "card": ([lambda: card("4", 16), lambda: card("5" + str(rng.integers(1, 6)), 16), lambda: four(card("4", 16), sep(" -.")), lambda: card("37", 15), lambda: (c := card("34", 15))[:4] + " " + c[4:10] + " " + c[10:]], [lambda: unluhn(16), lambda: unluhn(13), lambda: unluhn(19), lambda: four(unluhn(16), sep(" -.")), lambda: "0" * 4 + num(12), lambda: "1" + num(12), lambda: "2024" + num(10)]),
        "phone": ([lambda: f"+1 ({rng.integers(200, 999)}) {rng.integers(200, 999)}-{num(4)}", lambda: f"({rng.integers(200, 999)}) {rng.integers(200, 999)}-{num(4)}", lambda: f"{rng.integers(200, 999)}-{rng.integers(200, 999)}-{num(4)}", lambda: f"+{rng.integers(20, 99)} {num(3)} {num(4)} {num(4)}", lambda: f"00{rng.integers(20, 99)} {num(3)} {num(4)} {num(3)}"], [lambda: f"{num(3)}.{num(3)}.{num(4)}", lambda: f"000-000-{num(4)}", lambda: f"+0 {num(3)} {num(3)} {num(3)}", lambda: f"0000 {num(2)} {num(2)} {num(2)}"]),
    }
    out = []
    for kind, (good, bad) in make.items():
        for _ in range(n):
            label = int(rng.random() < 0.5)
            s = (pool := good if label else bad)[rng.integers(len(pool))]()
            cue = rng.random()
            lead = str(rng.choice(_FOR[kind])) + ": " if cue < (0.25 if label else 0.03) else str(rng.choice(_AGAINST)) + " " if cue > (0.99 if label else 0.6) else ""
            pre = f"{word()} {word()} {lead}"
            if not label and rng.random() < 0.3:
                pre += sep("#$-/")
            out.append((kind, f"{pre}{s}{sep([' ', '. ', ', ', ''])}{word() if rng.random() < 0.9 else ''}", len(pre), len(pre) + len(s), label))
    # addresses with a written-out at and a plain dot, and prose of the same form; its own draws leave those above as they are
    rng = np.random.default_rng(seed + 1)
    for i in range(n):
        label = int(rng.random() < 0.5)
        at = str(rng.choice([" (at) ", "(at)", " [at] ", "[at]"])) if label else " at "
        s = f"{word(9)}{at}{word(9)}.{sep(['com', 'org', 'net', 'de']) if label or rng.random() < 0.3 else word()}"
        s = s.upper() if rng.random() < 0.2 else s
        pre = str(rng.choice(["", f"{word()} ", f"{word()} {rng.choice(_FOR['email'])}: "]))
        out.insert(2 * i, ("email", f"{pre}{s}{sep([' ', '. ', ', ', ''])}{word()}", len(pre), len(pre) + len(s), label))
    return out


@functools.cache
def models(seed: int = 7, n: int = 1500) -> dict[str, tuple[boost.Boosted, float]]:
    """For each kind the trees and the threshold that held-out candidates give ``PRECISION``."""
    rows = _generated(seed, n)
    out = {}
    for kind in KINDS:
        own = [(features(t, k, a, b), y) for k, t, a, b, y in rows if k == kind]
        x, y = np.array([f for f, _ in own], float), np.array([v for _, v in own])
        cut = len(x) * 2 // 3
        trees = boost.fit(x[:cut], y[:cut], trees=30)
        out[kind] = trees, max(0.5, boost.threshold_for(trees.predict(x[cut:]), y[cut:], PRECISION))
    return out


class Taken:
    """Places that spans cover: disjoint intervals in order."""

    def __init__(self, spans: list[tuple[str, int, int]]):
        self.starts: list[int] = []
        self.ends: list[int] = []
        for _, a, b in sorted(spans, key=lambda s: s[1:]):
            if self.ends and a <= self.ends[-1]:
                self.ends[-1] = max(self.ends[-1], b)
            else:
                self.starts.append(a)
                self.ends.append(b)

    def meets(self, a: int, b: int) -> bool:
        i = bisect.bisect_right(self.ends, a)
        return i < len(self.ends) and self.starts[i] < b

    def add(self, a: int, b: int) -> None:
        """A span that meets none of those covered."""
        i = bisect.bisect_right(self.ends, a)
        self.starts.insert(i, a)
        self.ends.insert(i, b)


def find(text: str | None, trained: dict | None = None) -> tuple[list[tuple[str, int, int]], list[tuple[str, int, int]]]:
    """(base spans, all spans), each by kind and start."""
    base = base_spans(text)
    taken = Taken(base)
    found = [c for c in candidates(text or "") if not taken.meets(c[1], c[2])]
    if not found:
        return base, base
    trained = trained or models()
    scored = []
    for kind in KINDS:
        if own := [c for c in found if c[0] == kind]:
            trees, least = trained[kind]
            scored += [(a - b, -p, a, c) for p, c in zip(trees.predict(np.array([features(text, *c) for c in own], float)), own, strict=True) if p >= least for _, a, b in (c,)]
    spans = list(base)
    for *_, c in sorted(scored):
        if not taken.meets(c[1], c[2]):
            taken.add(c[1], c[2])
            spans.append(c)
    return base, sorted(spans, key=lambda s: (KINDS.index(s[0]), s[1], s[2]))


def redact(text: str | None, spans: list[tuple[str, int, int]]) -> str | None:
    """Each span replaced by its kind in angle brackets; of overlapping ones the union by the first one's kind."""
    if text is None or not spans:
        return text
    out, at = [], 0
    for kind, a, b in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= at:
            out += [text[at:a], f"<{kind.upper()}>"]
        at = max(at, b)
    return "".join([*out, text[at:]])


def joined(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b in spans)


def with_pii(df: DataFrame, text: str = "text") -> DataFrame:
    """Adds ``base`` and ``spans`` (``kind:start:end`` joined by commas, code points) and ``redacted``."""
    small_batches(df.sparkSession)
    trained = models()
    names = [c for c in df.columns if c not in ("base", "spans", "redacted")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(names.index(text)).to_pylist()
            both = [find(t, trained) for t in texts]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([joined(x) for x, _ in both], pa.string()), pa.array([joined(x) for _, x in both], pa.string()), pa.array([redact(t, s) for t, (_, s) in zip(texts, both, strict=True)], pa.string())], names=[*names, "base", "spans", "redacted"])

    schema = df.select(*names).schema.add("base", "string").add("spans", "string").add("redacted", "string")
    return df.select(*names).mapInArrow(run, schema)


