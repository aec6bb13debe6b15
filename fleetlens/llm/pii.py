"""Personal data: base patterns, and a semi-Markov conditional random field for what they miss.

The base patterns read greedily, so neighbouring entities (a phone number followed by a card number) can run into one
match that fails its check. The field looks at such stretches of tokens again: every segment that could be an entity is scored by
features of the whole span for every type it may have, and dynamic programming picks the best joint segmentation and typing.
A number has at most ``DIGITS`` digits and ``LONGEST`` tokens, which no entity of these kinds exceeds; an address with spelt-out signs
has no bound. Base spans are fixed: no segment may touch one. Weights are fitted by maximum likelihood on generated labelled
stretches. All steps are linear in the text.
"""

from __future__ import annotations

import functools
import random
import re
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

KINDS = ("email", "ip", "card", "phone")
#: Nineteen digits, each with one sign before it and one more around the number.
DIGITS, LONGEST = 19, 40
LOCAL = re.compile(r"[A-Za-z0-9._%+-]+\Z")
DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
IP = re.compile(r"(?<![0-9])[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
#: Runs that hold numbers with their separators.
RUN = re.compile(r"[0-9 ().+-]+")
#: A spelt-out sign in brackets, and what follows one: labels with dots, spelt or not.
AT = re.compile(r" ?[\[({] ?at ?[\])}] ?")
DOT = r" ?[\[({] ?dot ?[\])}] ?"
LABELS = re.compile(rf"[A-Za-z0-9-]+(?:(?: ?\. ?|{DOT})[A-Za-z0-9-]+)+")
SPELT = re.compile(rf"[A-Za-z0-9._%+-]+(?:{DOT}[A-Za-z0-9._%+-]+)*{AT.pattern}{LABELS.pattern}")
BEFORE_DOT = re.compile(rf"{DOT}\Z")
TOKEN = re.compile(rf"{AT.pattern}|{DOT}|[0-9]+|[A-Za-z]+|.", re.S)


class Span(NamedTuple):
    kind: str
    start: int
    end: int


def luhn(digits: str) -> bool:
    values = [int(c) for c in reversed(digits)]
    return (sum(values[0::2]) + sum(2 * v - 9 * (v > 4) for v in values[1::2])) % 10 == 0


def octets(parts: list[str]) -> bool:
    return all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in parts)


def only_digits(text: str) -> str:
    return re.sub(r"[^0-9]", "", text)


def base_spans(text: str) -> list[Span]:
    """Leftmost non-overlapping matches per kind that pass their checks, by kind and start."""
    found, end, run = [], 0, 0
    at = text.find("@")
    while at >= 0:
        # The local part is the run of its characters before the sign, but not what an earlier match took.
        start = at
        run = max(end, run)
        while start > run and (text[start - 1] in "._%+-" or (text[start - 1].isascii() and text[start - 1].isalnum())):
            start -= 1
        match = DOMAIN.match(text, at + 1) if start < at else None
        if match:
            found.append(Span("email", start, match.end()))
            end = match.end()
        run = at
        at = text.find("@", max(at + 1, end))
    found += [Span("ip", *m.span()) for m in IP.finditer(text) if octets(m[0].split("."))]
    for m in CARD.finditer(text):
        digits = only_digits(m[0])
        if 13 <= len(digits) <= 19 and luhn(digits):
            found.append(Span("card", *m.span()))
    found += [Span("phone", *m.span()) for m in PHONE.finditer(text) if 9 <= len(only_digits(m[0])) <= 15]
    return found


class Segment(NamedTuple):
    start: int
    end: int
    kind: str
    features: list[str]


def is_local(c: str) -> bool:
    return c in "._%+-" or (c.isascii() and c.isalnum())


def spelt_stretches(text: str) -> Iterator[tuple[int, int]]:
    """Addresses with a spelt-out sign: the characters before it, with spelt dots in between, and the labels after it."""
    done = 0
    for at in AT.finditer(text):
        start = at.start()
        while start > done and is_local(text[start - 1]):
            start -= 1
        if start == at.start():
            continue
        # A spelt dot has at most eight characters, so only those before the run are looked at.
        while dot := BEFORE_DOT.search(text[max(done, start - 8) : start]):
            stop = max(done, start - 8) + dot.start()
            further = stop
            while further > done and is_local(text[further - 1]):
                further -= 1
            if further == stop:
                break
            start = further
        labels = LABELS.match(text, at.end())
        if labels:
            yield start, labels.end()
            done = labels.end()


def number_stretches(text: str) -> Iterator[tuple[int, int]]:
    """Runs of digits, blanks and the signs of numbers, from a number that no letter touches on, with nine digits at least."""
    for run in RUN.finditer(text):
        start, end = run.span()
        touches = lambda c: c.isascii() and (c.isalnum() or c == "_")
        if end < len(text) and touches(text[end]):
            while end > start and text[end - 1].isdigit():
                end -= 1
        first = start
        if start and touches(text[start - 1]):
            while first < end and text[first].isdigit():
                first += 1
        digit = first
        while digit < end and not text[digit].isdigit():
            digit += 1
        low = digit
        while low > first and text[low - 1] in "+(":
            low -= 1
        if low == start and low < digit and start and touches(text[start - 1]):
            low += 1
        while end > low and text[end - 1] in " ().+-":
            end -= 1
        if sum(map(str.isdigit, text[low:end])) >= 9:
            yield low, end


def segments(tokens: list[str], before: str, after: str, fixed: list[bool]) -> list[Segment]:
    """Every candidate segment of a stretch with the features of its whole span; ``O`` covers one token.

    A card has 13 to 19 digits that pass their check, a phone number starts with a plus or a bracket and has 9 to 15 digits, an
    address has four parts of at most 255. Spelt addresses are tried from their start to each end at which one may stop.
    """
    out = []

    def add(i: int, j: int, kinds: Iterable[str]) -> None:
        features = span_features(tokens[i:j], tokens[i - 1] if i else before, tokens[j] if j < len(tokens) else after)
        out.extend(Segment(i, j, kind, [f"{kind}:{f}" for f in features]) for kind in kinds)

    for i, token in enumerate(tokens):
        out.append(Segment(i, i + 1, "O", ["O", f"O:{'d' + str(min(len(token), 8)) if token.isdigit() else token[:1] if not token.isalpha() else 'a'}"]))
        if fixed[i] or not (token.isdigit() or token in "+("):
            continue
        digits, groups, joins = "", 0, set()
        for j in range(i + 1, min(len(tokens), i + LONGEST) + 1):
            last = tokens[j - 1]
            if fixed[j - 1] or last[0].isalpha() or last[-1].isalpha() or len(digits) > DIGITS:
                break
            if not last.isdigit():
                joins.add(last)
                continue
            digits, groups = digits + last, groups + 1
            kinds = []
            if 13 <= len(digits) <= 19 and token.isdigit() and joins <= {" ", "-"} and luhn(digits):
                kinds.append("card")
            if 9 <= len(digits) <= 15 and token in "+(":
                kinds.append("phone")
            if groups == 4 and j - i == 7 and joins == {"."} and octets([t for t in tokens[i:j] if t.isdigit()]):
                kinds.append("ip")
            if kinds:
                add(i, j, kinds)
    text = "".join(tokens)
    if "at" in text:
        edge = np.concatenate(([0], np.cumsum([len(t) for t in tokens])))
        for start, end in spelt_stretches(text):
            i, stop = (int(np.searchsorted(edge, p)) for p in (start, end))
            if edge[i] != start or edge[stop] != end:
                continue
            # It may stop at any of the first labels, or at one of the last, before a sentence that goes on.
            sign = next(k for k in range(i, stop) if AT.fullmatch(tokens[k]))
            ends = [j for j in range(sign + 3, stop + 1) if tokens[j - 1].isalnum() and any(t == "." or "dot" in t for t in tokens[sign + 1 : min(j, sign + 4)])]
            for j in sorted({*ends[:8], *ends[-3:], stop}):
                if not any(fixed[i:j]):
                    add(i, j, ["email"])
    return out


def span_features(tokens: list[str], before: str, after: str) -> list[str]:
    text = "".join(tokens)
    groups = [t for t in tokens if t.isdigit()]
    digits = "".join(groups)
    letters = any(t.isalpha() for t in tokens)
    joins = "".join(sorted({t.strip()[:1] if len(t) > 1 else t for t in tokens if not t[0].isalnum()}))
    shape = "".join(f"d{min(len(t), 20)}" if t.isdigit() else "a" if t.isalpha() else t for t in tokens)
    out = ["bias", f"digits={min(len(digits), 20)}", f"groups={min(len(groups), 8)}", f"joins={joins}", f"letters={letters}"]
    if not letters:
        balanced = text.count("(") == text.count(")")
        out += [f"shape={shape}", f"first={text[0] if not text[0].isdigit() else 'd'}", f"balanced={balanced}", f"double={'  ' in text}"]
        if 13 <= len(digits) <= 19 and not set(joins) - set(" -"):
            out.append(f"card check={luhn(digits)}, groups={'one' if len(groups) == 1 else 'four' if {len(g) for g in groups[:-1]} == {4} else 'odd'}")
        if len(groups) == 4 and joins == ".":
            out.append(f"octets={octets(groups)}")
        if 9 <= len(digits) <= 15:
            out.append(f"phone length, plus={text[0] == '+'}, open={'(' in text}, balanced={balanced}, longest={min(max(map(len, groups)), 9)}")
    else:
        marks = [t for t in tokens if len(t) > 1 and not t.isalnum()]
        out += [f"spelt={bool(marks)}", f"loose dot={'. ' in text or ' .' in text}", f"labels={min(sum(t.isalnum() for t in tokens), 8)}"]
    edge = lambda c: "end" if not c else "blank" if c.isspace() else "digit" if c[0].isdigit() else "letter" if c[0].isalpha() else c[0]
    return [*out, f"before={edge(before)}", f"after={edge(after)}"]


class SemiCrf:
    def __init__(self) -> None:
        self.index: dict[str, int] = {}
        self.weights = np.zeros(0)

    def fit(self, examples: list[tuple[list[Segment], list[tuple[int, int, str]]]], steps: int = 40, penalty: float = 0.02, rate: float = 0.5) -> SemiCrf:
        """Maximum likelihood with AdaGrad; each example has all its segments and the true ones."""
        flat = [s for segs, _ in examples for s in segs]
        for s in flat:
            for f in s.features:
                self.index.setdefault(f, len(self.index))
        ids = np.array([self.index[f] for s in flat for f in s.features])
        edges = np.cumsum([0] + [len(s.features) for s in flat])
        gold = np.array([(s.start, s.end, s.kind) in set(truth) for segs, truth in examples for s in segs], float)
        self.weights, history = np.zeros(len(self.index)), np.full(len(self.index), 1e-6)
        for _ in range(steps):
            scores = np.add.reduceat(self.weights[ids], edges[:-1])
            expected, at = np.zeros(len(flat)), 0
            for segs, _ in examples:
                expected[at : at + len(segs)] = marginals(segs, scores[at : at + len(segs)])
                at += len(segs)
            gradient = np.bincount(ids, np.repeat(gold - expected, np.diff(edges)), minlength=len(self.index)) - penalty * self.weights
            history += gradient**2
            self.weights += rate * gradient / np.sqrt(history)
        return self

    def score(self, segment: Segment) -> float:
        return float(sum(self.weights[self.index[f]] for f in segment.features if f in self.index))

    def best(self, segs: list[Segment]) -> list[Segment]:
        """The segmentation of the highest total score, by bounded-length dynamic programming."""
        size = max((s.end for s in segs), default=0)
        value, back = [0.0] + [-np.inf] * size, [None] * (size + 1)
        for s in sorted(segs, key=lambda s: s.start):
            total = value[s.start] + self.score(s)
            if total > value[s.end]:
                value[s.end], back[s.end] = total, s
        out, at = [], size
        while at:
            out.append(back[at])
            at = back[at].start
        return [s for s in reversed(out) if s.kind != "O"]


def marginals(segs: list[Segment], scores: np.ndarray) -> np.ndarray:
    """Probability of each segment under the field (forward and backward sums)."""
    size = max(s.end for s in segs)
    forward, backward = np.full(size + 1, -np.inf), np.full(size + 1, -np.inf)
    forward[0] = backward[size] = 0
    order = sorted(range(len(segs)), key=lambda k: segs[k].start)
    for k in order:
        forward[segs[k].end] = np.logaddexp(forward[segs[k].end], forward[segs[k].start] + scores[k])
    for k in sorted(order, key=lambda k: -segs[k].end):
        backward[segs[k].start] = np.logaddexp(backward[segs[k].start], backward[segs[k].end] + scores[k])
    return np.exp([forward[s.start] + scores[k] + backward[s.end] - forward[size] for k, s in enumerate(segs)])


def training_stretches(count: int = 180, seed: int = 7) -> list[tuple[str, list[Span]]]:
    """Generated stretches: entities of the four kinds and look-alikes, alone or run together."""
    rng = random.Random(seed)
    number = lambda n: str(rng.randint(1, 9)) + "".join(str(rng.randint(0, 9)) for _ in range(n - 1))

    def card(valid: bool) -> str:
        stem = number(rng.choice((15, 15, 15, 14)))
        good = next(str(c) for c in range(10) if luhn(stem + str(c)))
        digits = stem + (good if valid else str((int(good) + rng.randint(1, 9)) % 10))
        style = rng.choice(("", "", " ", "-"))
        return style.join(digits[k : k + 4] for k in range(0, len(digits), 4))

    def phone() -> str:
        a, b, c, d = (number(n) for n in (1, 3, 3, 4))
        return rng.choice((f"+{a} ({b}) {c}-{d}", f"+{a} ({b}) {c}-{d}", f"+{a}-{b}-{c}-{d}", f"+{a} {b} {c} {d}", f"+4{a} {b} {c}{d}", f"({b}) {c}-{d}"))

    def name() -> str:
        return "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 6)))

    def spelt() -> str:
        at, dot = rng.choice(((" [at] ", " [dot] "), ("(at)", "(dot)"), (" (at) ", "."), ("{at}", "{dot}"), ("[at]", ".")))
        person = rng.choice((".", dot, "_")).join(name() for _ in range(rng.randint(1, 2)))
        return person + at + dot.join(name() for _ in range(rng.randint(2, 4)))

    makers = {
        "card": lambda: card(True), "phone": phone, "ip": lambda: ".".join(str(rng.randint(1, 255)) for _ in range(4)), "email": spelt,
        "O": lambda: rng.choice((card(False), number(rng.randint(1, 12)), f"{rng.randint(1980, 2030)}-{number(2)}-{number(2)}", f"{number(2)}.{number(2)}.{number(4)}",
                                 f"{number(3)}.{number(2)}", f"{number(4)}-{number(4)}", f"{number(3)} {number(3)}", f"({number(2)})")),
    }
    out = []
    for _ in range(count):
        text, spans = "", []
        for _ in range(rng.randint(1, 3)):
            kind = rng.choice(("card", "card", "phone", "phone", "ip", "email", "O", "O", "O"))
            item = makers[kind]()
            text += " " * bool(text)
            if kind != "O":
                spans.append(Span(kind, len(text), len(text) + len(item)))
            text += item
            if kind == "email" and rng.random() < 0.3:  # the sentence goes on
                text += f". {name().title()}"
        out.append((text, spans))
    return out


@functools.lru_cache(maxsize=1)
def trained() -> SemiCrf:
    examples = []
    for text, spans in training_stretches():
        tokens = TOKEN.findall(text)
        edge = {0: 0}
        for k, t in enumerate(tokens):
            edge[sum(map(len, tokens[: k + 1]))] = k + 1
        truth = [(edge[s.start], edge[s.end], s.kind) for s in spans]
        inside = {k for a, b, _ in truth for k in range(a, b)}
        truth += [(k, k + 1, "O") for k in range(len(tokens)) if k not in inside]
        examples.append((segments(tokens, "", "", [False] * len(tokens)), truth))
    return SemiCrf().fit(examples)


def overlapping(spans: list[Span], stretches: Iterable[tuple[int, int]]) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
    """Each stretch (ascending) with the parts of it that spans take; one pass over both."""
    ordered, k, open_ = sorted((s.start, s.end) for s in spans), 0, []
    for start, end in stretches:
        while k < len(ordered) and ordered[k][0] < end:
            open_.append(ordered[k])
            k += 1
        open_ = [s for s in open_ if s[1] > start]
        yield start, end, [(max(a, start), min(b, end)) for a, b in open_ if a < end]


def field_spans(text: str, base: list[Span], model: SemiCrf) -> list[Span]:
    """Spans that the field adds; none touches a base span."""
    out: list[Span] = []
    for find in (number_stretches, spelt_stretches):
        for start, end, taken in list(overlapping([*base, *out], find(text))):
            if end - start - sum(b - a for a, b in taken) < 9:
                continue
            tokens = TOKEN.findall(text[start:end])
            ends = start + np.cumsum([len(t) for t in tokens])
            starts = ends - [len(t) for t in tokens]
            fixed = np.zeros(len(tokens), bool)
            for a, b in taken:
                fixed[np.searchsorted(ends, a, side="right") : np.searchsorted(starts, b, side="left")] = True
            segs = segments(tokens, text[start - 1 : start], text[end : end + 1], fixed.tolist())
            out += [Span(s.kind, int(starts[s.start]), int(ends[s.end - 1])) for s in model.best(segs)]
    return out


def joined(spans: list[Span]) -> str:
    return ",".join(f"{s.kind}:{s.start}:{s.end}" for s in sorted(spans, key=lambda s: (KINDS.index(s.kind), s.start)))


SCHEMA = "doc_id long, n_email long, n_ip long, n_card long, n_phone long, base_spans string, spans string"


def find_pii(docs: DataFrame, model: SemiCrf | None = None) -> DataFrame:
    """``doc_id, n_email, n_ip, n_card, n_phone, base_spans, spans`` of every row.

    Counts and ``base_spans`` are those of the base patterns; ``spans`` adds those of the field. A span is
    ``kind:start:end`` in code points, end exclusive, ordered by kind and start. Null and empty texts have none. Rows pass
    one by one, so null and repeated ids stay; other columns are ignored.
    """
    field = model or trained()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        worth = re.compile(r"[0-9@]|at ?[\])}]")
        for batch in batches:
            counts: list[list[int]] = [[] for _ in KINDS]
            base_column, all_column = [], []
            for value in batch.column(1):
                text = value.as_py() or ""
                base = base_spans(text) if worth.search(text) else []
                spans = base + field_spans(text, base, field) if base or worth.search(text) else []
                for k, kind in enumerate(KINDS):
                    counts[k].append(sum(s.kind == kind for s in base))
                base_column.append(joined(base))
                all_column.append(joined(spans))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *(pa.array(c, pa.int64()) for c in counts), pa.array(base_column, pa.string()), pa.array(all_column, pa.string())],
                ["doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_spans", "spans"])

    return docs.selectExpr("cast(doc_id as long) doc_id", "text").mapInArrow(run, SCHEMA)
