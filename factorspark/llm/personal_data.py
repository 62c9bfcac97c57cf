"""Personal data by boosted trees over candidate spans.

Four detectors give the base spans, which are always reported. Beside them generators of high
recall propose overlapping spans of the same kinds in other forms: addresses with a spelt-out
or bracketed `at`, numbers of internet hosts with broken dots, every run of digit groups that
could be a card or a telephone number, identity numbers. A candidate is described by its format
(lengths, groups, separators, check sums) and its context (neighbours, digits and cue words
around it). Gradient-boosted trees score it, a sigmoid fitted on held-back documents calibrates
the score, and each kind has its own threshold, the smallest that reaches the wanted precision
there. Of the candidates above it that touch no base span the best of each overlap is kept.

There are no labels. The trees learn from base spans rewritten into other forms in their own
context (positive), the candidates that merely overlap those, candidates of the texts as they
are that fail the checks of their kind, and numbers of other kinds, such as dates and versions,
put into the same contexts (negative). At most `max_docs` documents of at most `max_chars`
characters are learned from; every text is scanned whole.

Defined results: a null text is empty and has no span; a null id is kept; repeated rows are
reported each; extra columns are ignored (`report`) or kept (`redact`); without documents the
trees learn from invented contexts; an empty table gives no rows. Every detector takes time in
proportion to the text, whatever it holds.
"""

from __future__ import annotations

import hashlib
import random
import re
from bisect import bisect_left
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .boosting import Trees, boost, sigmoid_fit
from .common import hashed_share, uniform

BASE = ("email", "ip", "card", "phone")
ADDED = ("email_like", "ip_like", "card_like", "phone_like", "id_like")
KINDS = (*BASE, *ADDED)
MAX_DOCS = 3000
MAX_CHARS = 20_000
PRECISION = 0.98
NEAR = 40
GROUPS = 6
CHUNK = 20_000

_LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
# The base detectors. Runs are possessive and start where no character of their kind stands
# before, which gives the same matches without going over a run again and again.
_DOMAIN = re.compile(r"[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9]){11,}+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
# The generators.
_AT = re.compile(r"@|＠|[ ]?[\[({] ?(?:at|AT) ?[\])}] ?| (?:at|AT) ")
_DOT = r"(?:\.|[ ]?[\[({] ?(?:\.|dot|DOT) ?[\])}] ?| (?:dot|DOT) )"
_HOST = re.compile(rf"[A-Za-z0-9-]{{1,63}}(?:{_DOT}[A-Za-z0-9-]{{1,63}}){{1,8}}")
_BROKEN_IP = re.compile(r"(?<![0-9A-Za-z.])[0-9]{1,3}(?:(?: ?[\[({] ?(?:\.|dot) ?[\])}] ?| ?\. ?|,|_|-)[0-9]{1,3}){3}(?![0-9])")
_IP6 = re.compile(r"(?<![0-9A-Za-z:])(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}(?![0-9A-Za-z:])")
_GROUP = re.compile(r"[0-9]++")
_BETWEEN = re.compile(r"[  ().,/_-]{1,3}\Z")
_IDENTITY = re.compile(r"(?<![0-9A-Za-z])(?:[0-9]{3}-[0-9]{2}-[0-9]{4}|[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?)(?![0-9A-Za-z])")
_QUICK = re.compile(r"[0-9@＠]|[\[({ ](?:at|AT)[\])} ]")
# Words that speak for, and against, personal data around a candidate.
_FOR = re.compile(r"(?i)\b(?:phone|tel|telephone|call|mobile|cell|fax|mail|e-mail|email|contact|card|visa|iban|account|ssn|passport|ip|host|address|kontakt|telefon|tarjeta|correo|carte)\b")
_AGAINST = re.compile(r"(?i)\b(?:version|isbn|doi|date|page|pages|section|chapter|order|invoice|total|price|usd|eur|release|figure|table|vol|issue)\b")


def luhn(digits: str) -> bool:
    total = 0
    for at, char in enumerate(reversed(digits)):
        value = ord(char) - 48
        if at % 2:
            value = 2 * value - 9 if value > 4 else 2 * value
        total += value
    return total % 10 == 0


def _small(part: str) -> bool:
    """Whether a number is at most 255."""
    part = part.lstrip("0")
    return len(part) < 3 or len(part) == 3 and int(part) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of the base detectors' spans, in order."""
    found: list[tuple[int, int, int]] = []
    before = at = 0
    while (at := text.find("@", at)) >= 0:
        local = len(text[before:at]) - len(text[before:at].rstrip(_LOCAL))
        match = _DOMAIN.match(text, at + 1) if local else None
        if match:
            found.append((at - local, 0, match.end()))
        before = at = match.end() if match else at + 1
    if not text.isascii() or any(c in text for c in "0123456789"):
        for match in _IP.finditer(text):
            if all(map(_small, match[0].split("."))):
                found.append((match.start(), 1, match.end()))
        for match in _CARD.finditer(text):
            digits = match[0].replace(" ", "").replace("-", "")
            if len(digits) <= 19 and luhn(digits):
                found.append((match.start(), 2, match.end()))
        for match in _PHONE.finditer(text):
            if 9 <= sum(c.isdigit() for c in match[0]) <= 15:
                found.append((match.start(), 3, match.end()))
    return sorted(found)


def candidates(text: str) -> list[tuple[int, int, int]]:
    """(start, kind, end) of every span that the generators propose; they overlap."""
    found: set[tuple[int, int, int]] = set()
    kind = {name: len(BASE) + i for i, name in enumerate(ADDED)}
    for match in _AT.finditer(text):
        before = text[max(0, match.start() - 65): match.start()]
        local = len(before) - len(before.rstrip(_LOCAL))
        host = _HOST.match(text, match.end()) if 0 < local < 65 else None
        if host and host[0][-2:].isalpha():  # no host ends in a number
            found.add((match.start() - local, kind["email_like"], host.end()))
    for pattern, name in ((_BROKEN_IP, "ip_like"), (_IP6, "ip_like"), (_IDENTITY, "id_like")):
        found.update((m.start(), kind[name], m.end()) for m in pattern.finditer(text))
    # Groups of digits with little between them: every run of groups with the right number of digits.
    open_: list[tuple[int, int, int]] = []  # (start, digits from there on, shortest group after the first)
    last = -9
    for match in _GROUP.finditer(text):
        start, end = match.span()
        if not (0 < start - last <= 3 and _BETWEEN.match(text, last, start)):
            open_ = []
        size = end - start
        open_ = [(s, n + size, min(least, size)) for s, n, least in open_[-GROUPS + 1:] if n + size <= 19]
        open_ += [(start, size, 19)] if size <= 19 else []
        last = end
        for first, digits, least in open_:
            if least < 2:  # a card or number is not written digit by digit
                continue
            begin = first
            if text[begin - 1: begin] == "(" and ")" in text[begin:end]:
                begin -= 1
            if text[begin - 1: begin] == "+":
                begin -= 1
            if 12 <= digits <= 19 and luhn("".join(filter(str.isdigit, text[first:end]))):
                found.add((first, kind["card_like"], end))
            if 7 <= digits <= 15 and (first < start or begin < first):
                found.add((begin, kind["phone_like"], end))
    return sorted(found)


def _class(char: str) -> int:
    return 0 if not char or char.isspace() else 1 if char.isalpha() else 2 if char.isdigit() else 3


class Surroundings:
    """What lies where in a text: letters, digits, cue words and base spans."""

    def __init__(self, text: str, base: list[tuple[int, int, int]]) -> None:
        codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        small = codes | 32
        digits, letters = (codes >= 48) & (codes <= 57), ((small >= 97) & (small <= 122)) | (codes >= 192)
        self.digits, self.letters = (np.concatenate([[0], np.cumsum(x)]) for x in (digits, letters))
        self.cues = [[m.start() for m in pattern.finditer(text)] for pattern in (_FOR, _AGAINST)]
        self.text, self.base, self.starts = text, base, [b[0] for b in base]

    def share(self, counts: np.ndarray, start: int, end: int) -> float:
        """The share in the stretches just before and just behind."""
        first, last = max(0, start - NEAR), min(len(self.text), end + NEAR)
        return float(counts[last] - counts[end] + counts[start] - counts[first]) / (last - end + start - first + 1)

    def cue(self, which: int, start: int, end: int) -> bool:
        places = self.cues[which]
        return any(bisect_left(places, stop) > bisect_left(places, begin) for begin, stop in ((start - NEAR, start), (end, end + NEAR)))


def described(span: tuple[int, int, int], around: Surroundings) -> list[float]:
    """Format and context of a candidate, as numbers."""
    start, kind, end = span
    text, starts = around.text, around.starts
    shown = text[start:end]
    groups = _GROUP.findall(shown)
    digits = "".join(groups)
    sizes = [len(g) for g in groups] or [0]
    host = re.split(_DOT, re.split(_AT, shown)[-1]) if kind == len(BASE) else [""]
    year = len(groups) > 0 and len(groups[0]) == 4 and groups[0][:2] in ("19", "20") or len(sizes) > 1 and sizes[-1] == 4 and groups[-1][:2] in ("19", "20")
    check = 0.0
    if kind == len(BASE) + 4:
        packed = shown.replace(" ", "")
        check = float(packed[0].isalpha() and int("".join(str(int(c, 36)) for c in packed[4:] + packed[:4])) % 97 == 1)
    near = bisect_left(starts, end + 200) - bisect_left(starts, start - 200)
    return [float(x) for x in (
        kind, len(shown), len(digits), len(digits) / len(shown), len(groups), sizes[0], sizes[-1], max(sizes), min(sizes),
        len(set(sizes)) == 1, len(set(digits)), len(digits) > 11 and luhn(digits), int(digits[0]) if digits else -1,
        shown[0] == "+", "(" in shown, shown.count("."), shown.count("-"), shown.count(" "),
        shown.count("/") + shown.count("_") + shown.count(",") + shown.count("\u00a0"), len(groups) == 4 and all(map(_small, groups)),
        any(g[0] == "0" and len(g) > 1 for g in groups), int(digits[:3] or 0), int(groups[1][:2]) if len(groups) > 1 else -1,
        _class(text[start - 1: start] if start else ""), _class(text[end: end + 1]),
        around.digits[start] > around.digits[max(0, start - 3)], around.digits[min(len(text), end + 3)] > around.digits[end],
        around.share(around.digits, start, end), around.share(around.letters, start, end),
        around.cue(0, start, end), around.cue(1, start, end), year, check, near,
        len(host[-1]) if host[-1].isalpha() else 0, len(host), "@" in shown, any(b in shown for b in "[({"))]


def touching(spans: list[tuple[int, int, int]], starts: list[int], longest: int, start: int, end: int) -> bool:
    """Whether one of the spans, sorted by start, overlaps start to end."""
    at = bisect_left(starts, end)
    while at > 0 and starts[at - 1] > start - longest:
        at -= 1
        if spans[at][2] > start:
            return True
    return False


@dataclass(frozen=True)
class Judge:
    trees: Trees
    a: float
    b: float
    thresholds: tuple[float, ...]  # of each added kind; above 1: never

    def chances(self, rows: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.a * self.trees.margin(rows) + self.b, -40, 40)))

    def added(self, text: str, base: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """The spans added to the base ones."""
        starts, longest = [b[0] for b in base], max((b[2] - b[0] for b in base), default=0)
        proposed = [c for c in candidates(text) if not touching(base, starts, longest, c[0], c[2])]
        if not proposed:
            return []
        around = Surroundings(text, base)
        chance = np.concatenate([
            self.chances(np.array([described(c, around) for c in proposed[first: first + CHUNK]]))
            for first in range(0, len(proposed), CHUNK)])
        least = np.array([self.thresholds[c[1] - len(BASE)] for c in proposed])
        order = sorted(np.flatnonzero(chance >= least).tolist(), key=lambda i: (-chance[i], proposed[i][0] - proposed[i][2], proposed[i]))
        taken: list[tuple[int, int, int]] = []
        firsts: list[int] = []
        widest = 0
        for i in order:
            start, _, end = proposed[i]
            if not touching(taken, firsts, widest, start, end):
                at = bisect_left(firsts, start)
                firsts.insert(at, start)
                taken.insert(at, proposed[i])
                widest = max(widest, end - start)
        return taken


# Invented data for tables that hold none.
_SEEDS = (("jane.doe@mail.example.org", "k9@example.com"), ("203.0.113.7", "198.51.100.23"),
          ("4111111111111111", "5500005555555559"), ("+1 (202) 555-0143", "+49 30 5550123"),
          ("219-09-9999", "DE89370400440532013000", "GB82WEST12345698765432"))


def _identity(shown: str, rng: random.Random) -> str:
    """An invented number of the form of `shown`: three groups, or one with a right check sum."""
    if "-" in shown:
        return f"{rng.choice([n for n in range(1, 900) if n != 666]):03}-{rng.randint(1, 99):02}-{rng.randint(1, 9999):04}"
    body = "".join(c if c.isalpha() else str(rng.randint(0, 9)) for c in shown[4:])
    check = 98 - int("".join(str(int(c, 36)) for c in body + shown[:2] + "00")) % 97
    packed = f"{shown[:2]}{check:02}{body}"
    return rng.choice((packed, " ".join(packed[i: i + 4] for i in range(0, len(packed), 4))))


def _invented(kind: int, rng: random.Random) -> str | None:
    """A span of a base kind, with other words and numbers."""
    word = lambda: "".join(rng.choice("bcdfghklmnprstvw") + rng.choice("aeiou") for _ in range(rng.randint(1, 4)))
    digits = lambda n: "".join(str(rng.randint(0, 9)) for _ in range(n))
    if kind == 0:
        local = rng.choice((word(), f"{word()}.{word()}", f"{word()}_{digits(2)}", f"{word()}{digits(3)}"))
        return f"{local}@{rng.choice(('', word() + '.'))}{word()}.{rng.choice(('com', 'org', 'net', 'de', 'co.uk', 'info'))}"
    if kind == 1:
        return ".".join(str(rng.randint(0, 255)) for _ in range(4))
    if kind == 2:
        body = digits(rng.choice((14, 15, 15, 15)))
        return body + next(str(d) for d in range(10) if luhn(body + str(d)))
    return f"+{rng.choice(('1', '49', '33', '34'))} ({digits(3)}) {digits(3)}-{digits(4)}" if kind == 3 else None


def _rewritten(kind: int, shown: str, rng: random.Random) -> tuple[str, str, str, str]:
    """(name of the kind, what stands before, another form, what stands behind) of a base span.

    A number may keep its form and lose its place: right beside another number no base detector finds it."""
    if rng.random() < 0.5:  # and other data than the texts happen to hold
        shown = _invented(kind, rng) or shown
    digits = "".join(c for c in shown if c.isdigit())
    if kind == 4:
        return "id_like", "", _identity(shown, rng), ""
    if kind > 1 and rng.random() < 0.35:
        other = "".join(str(rng.randint(0, 9)) for _ in range(rng.choice((8, 13, 16, 16))))
        other = other[:-1] + str((int(other[-1]) + luhn(other)) % 10)  # no card itself
        other = rng.choice((other, other, ".".join(other[i: i + 3].lstrip("0") or "0" for i in (0, 2, 3, 5))))
        return ("card_like", "phone_like")[kind - 2], *rng.choice((("", shown, f" {other}"), (f"{other} ", shown, "")))
    name, new = _other_form(kind, shown, digits, rng)
    return name, "", new, ""


def _other_form(kind: int, shown: str, digits: str, rng: random.Random) -> tuple[str, str]:
    if kind == 0:
        at, dot = rng.choice(((" [at] ", " [dot] "), ("(at)", "(dot)"), (" at ", " dot "), (" (at) ", "."), ("[at]", "."), ("＠", "."), ("@", "[.]")))
        local, _, host = shown.rpartition("@")
        return "email_like", local + at + host.replace(".", dot)
    if kind == 1:
        return "ip_like", shown.replace(".", rng.choice(("[.]", "(.)", " . ", "[dot]")), rng.choice((3, 3, 1)))
    if kind == 2:
        step = rng.choice((4, 4, 4, 8, 20))
        joint = rng.choice((".", "/", "_", " ", " ", "-"))
        return "card_like", joint.join(digits[i: i + step] for i in range(0, len(digits), step))
    national = digits[-10:] if len(digits) > 10 else digits
    a, b, c = national[:3], national[3:6], national[6:]
    return "phone_like", rng.choice((f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"{a}.{b}.{c}", f"{a} {b} {c}", f"00{digits[:2]} {a} {b}{c}", f"({a}) {b} {c}"))


def _decoy(rng: random.Random) -> str:
    """A number, or words, of another kind in the form of a candidate."""
    n = rng.randint
    digits = lambda k: "".join(str(n(0, 9)) for _ in range(k))
    wrong = digits(15)
    wrong += str((next(d for d in range(10) if luhn(wrong + str(d))) + n(1, 9)) % 10)
    step = rng.choice((4, 4, 20))
    return rng.choice((
        f"{n(1900, 2099)}-{n(1, 12):02}-{n(1, 28):02} {n(0, 23):02}-{n(0, 59):02}", f"{n(1, 28):02}.{n(1, 12):02}.{n(1900, 2099)}",
        f"{n(1, 28):02}/{n(1, 12):02}/{n(1900, 2099)}", f"{n(1, 9)}.{n(0, 30)}.{n(0, 30)}.{n(0, 9999)}.{n(0, 9)}",
        f"{n(1, 999)},{n(0, 999):03},{n(0, 999):03}", f"{n(1, 999)}.{n(0, 999):03}.{n(0, 999):03},{n(0, 99):02}",
        f"978-{n(0, 9)}-{digits(2)}-{digits(6)}-{n(0, 9)}", rng.choice((" ", ".", "-", "/")).join(wrong[i: i + step] for i in range(0, 16, step)),
        f"{n(256, 999)} . {n(0, 999)} . {n(0, 999)} . {n(256, 999)}", f"{n(1, 99)}-{n(1, 99)}-{n(1, 99)}-{n(1, 99)}-{n(1, 99)}",
        f"{n(1, 99)}, {n(1, 99)}, {n(1, 99)}, {n(1, 999)}", f"{digits(3)} {digits(3)} {digits(3)} {digits(3)} {digits(3)}",
        " ".join(digits(n(1, 5)) for _ in range(n(4, 8))), f"{rng.choice((0, 666, n(900, 999))):03}-{n(0, 99):02}-{n(0, 9999):04}", f"{rng.choice(('AB', 'XK', 'NO'))}{n(10, 99)} {digits(4)} {digits(4)} {digits(3)}",
        "look at home. The", "met at noon.They", f"{n(1000, 9999)}/{n(10, 99)} {n(1000, 9999)}",
        f"{n(1, 9)}.{digits(14)}", f"{digits(9)}-{n(0, 9)}"))


def examples(texts: list[str], seed: int = 11, contexts: int = 4000) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, labels, fold) of labelled candidates: rewritten base spans, what overlaps them, and decoys. fold: place of the text."""
    rng = random.Random(seed)
    rows: list[list[float]] = []
    labels: list[int] = []
    folds: list[int] = []
    names = {name: len(BASE) + i for i, name in enumerate(ADDED)}

    def learn(text: str, wanted: tuple[int, int, int] | None, fold: int, within: tuple[int, int], whole: bool = False) -> None:
        around = Surroundings(text, base_spans(text))
        longest = max((b[2] - b[0] for b in around.base), default=0)
        for c in candidates(text):
            # What merely lies around keeps its own, unknown nature.
            outside = c[2] <= within[0] or c[0] >= within[1]
            if outside or (whole and c[1] == names["card_like"]) or touching(around.base, around.starts, longest, c[0], c[2]):
                continue
            rows.append(described(c, around))
            labels.append(int(c == wanted))
            folds.append(fold)

    spans = [(i, *span) for i, text in enumerate(texts) for span in base_spans(text)]
    found = [(i, kind, texts[i][start:end], texts[i], start, end) for i, start, kind, end in spans]
    texts = texts or ["Words stand here, then others. ", "12 lines and 7 more "]
    for kind, seeds in enumerate(_SEEDS):  # a kind that the texts hardly hold is learned from invented data in their contexts
        have = sum(f[1] == kind for f in found)
        for _ in range(max(0, 200 - have)):
            i = rng.randrange(len(texts))
            at = rng.randint(0, len(texts[i]))
            found.append((i, kind, rng.choice(seeds), texts[i], at, at))
    found *= 1 + contexts // (2 * max(1, len(found)))  # each in several forms
    rng.shuffle(found)
    for i, kind, shown, text, start, end in found[:contexts]:
        left, right = text[max(0, start - 300): start], text[end: end + 300]
        name, ahead, new, behind = _rewritten(kind, shown, rng)
        left = left + " " * (left[-1:].isalnum() or left[-1:] in set(_LOCAL))
        right = " " * right[:1].isalnum() + right
        at = len(left) + len(ahead)
        learn(left + ahead + new + behind + right, (at, names[name], at + len(new)), i, (len(left), at + len(new) + len(behind)))
        for _ in range(2):
            decoy = _decoy(rng)
            learn(left + decoy + right, None, i, (len(left), len(left) + len(decoy)))
    for i, text in enumerate(texts[:contexts]):
        learn(text[:2000], None, i, (0, min(2000, len(text))), whole=True)
    return np.array(rows, float).reshape(len(rows), -1), np.array(labels, float), np.array(folds)


def fit(texts: list[str], precision: float = PRECISION) -> Judge:
    rows, labels, fold = examples(texts)
    held = fold % 4 == 0
    if labels[held].sum() < 20 or labels[~held].sum() < 20:  # too few texts for a fold of their own
        held = np.arange(len(rows)) % 4 == 0
    weigh = lambda y: np.where(y > 0, len(y) / (2 * max(1, y.sum())), len(y) / (2 * max(1, (1 - y).sum())))
    trees = boost(rows[~held], labels[~held], weigh(labels[~held]))
    margin, truth, kind = trees.margin(rows[held]), labels[held], rows[held][:, 0]
    a, b = sigmoid_fit(margin, truth, np.ones(len(truth)))
    chance = 1 / (1 + np.exp(-np.clip(a * margin + b, -40, 40)))
    thresholds = []
    for number in range(len(BASE), len(KINDS)):
        mine = kind == number
        order = np.argsort(-chance[mine], kind="stable")
        hits = np.cumsum(truth[mine][order]) / np.arange(1, int(mine.sum()) + 1)
        values = chance[mine][order]
        last = np.append(values[1:] < values[:-1], True) if len(values) else np.zeros(0, bool)  # whole ties
        good = np.flatnonzero((hits >= precision) & last & (values >= 0.5))
        # Between the last score taken and the next one, so that neither sits on the border.
        thresholds.append(float((values[good[-1]] + max([0.5, *values[good[-1] + 1: good[-1] + 2]])) / 2) if len(good) else 2.0)
    return Judge(trees, a, b, tuple(thresholds))


def fitted(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", max_docs: int = MAX_DOCS, max_chars: int = MAX_CHARS) -> Judge:
    """The judge, from a bounded sample of the documents that hold a digit or an at sign."""
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(
        F.col("text").rlike("@|[0-9]{2}") & (F.length("text") <= max_chars))
    number = rows.count()
    draw = uniform(F.lit(7), F.col("id"), F.xxhash64("text"))
    some = rows.where(draw < hashed_share(number, max_docs)).withColumn("draw", draw)
    return fit([r["text"] for r in some.orderBy("draw", "text").limit(max_docs).select("text").collect()])


def spans_of(text: str | None, judge: Judge) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    """(base, all) spans of a text, both in order."""
    if not text or not _QUICK.search(text):
        return [], []
    base = base_spans(text)
    return base, sorted(base + judge.added(text, base))


def _written(spans: list[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[kind]}:{start}:{end}" for start, kind, end in spans)


def report(docs: DataFrame, judge: Judge, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: counts and a hash of the base spans, all spans, and how many were added."""
    source = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    kind = dict(source.dtypes)["id"]

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for text in batch.column(1):
                base, found = spans_of(text.as_py(), judge)
                counts = [sum(b[1] == number for b in base) for number in range(len(BASE))]
                rows.append((*counts, hashlib.sha256(_written(base).encode()).hexdigest(), _written(found), len(found) - len(base)))
            columns = list(zip(*rows)) if rows else [()] * 7
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in columns[:4]), *(pa.array(c, pa.string()) for c in columns[4:6]),
                 pa.array(columns[6], pa.int64())], ["id", *(f"n_{k}" for k in BASE), "base_sha256", "spans", "n_added"])

    schema = f"id {kind}, {', '.join(f'n_{k} long' for k in BASE)}, base_sha256 string, spans string, n_added long"
    return source.mapInArrow(scanned, schema).withColumnRenamed("id", id_col)


def redacted(text: str, spans: list[tuple[int, int, int]]) -> str:
    """The text with each stretch of overlapping spans replaced by the kind of its first one."""
    out, at = [], 0
    for start, kind, end in spans:
        if start >= at:
            out += (text[at:start], f"[{KINDS[kind].removesuffix('_like').upper()}]")
        at = max(at, end)
    return "".join((*out, text[at:]))


def redact(docs: DataFrame, judge: Judge, text_col: str = "text") -> DataFrame:
    """All documents with their personal data replaced by its kind; other columns and null texts stay."""
    at, schema = docs.columns.index(text_col), docs.schema

    def cleaned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = [None if (t := text.as_py()) is None else redacted(t, spans_of(t, judge)[1]) for text in batch.column(at)]
            columns = list(batch.columns)
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return docs.mapInArrow(cleaned, schema)
