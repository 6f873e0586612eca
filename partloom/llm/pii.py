"""Personal data: fixed patterns, and a semi-Markov conditional random field over what lies around digits and at-signs.

The field.  A *region* is a stretch of words that hold digits or at-signs (with the word before as context), or an at-sign, spelled out or not, with the words before it and the domain behind it.  It is cut in atoms: runs of digits, runs of letters, at and dot
as words of their own with what sets them off, single other characters.  A segmentation covers the region with segments of one atom of type ``other`` and of up to ``MAX_ATOMS`` atoms of an entity type; its score is the
sum of its segments' scores, each a weighted sum of features of the *whole span* (number of digits and groups, checksum, octets, what touches its ends, ...).  The
best segmentation is found by dynamic programming over ends, types and bounded lengths, so that boundaries and types are chosen jointly: two card numbers
side by side, which a pattern reads as one number of 32 digits and drops, come out as two.

Training.  The weights maximise the conditional likelihood (forward-backward over segments, ridge penalty) of ``TRAIN_REGIONS`` regions that a seeded generator writes:
entities of each type between words, years, prices, versions, dates and serial numbers; and of ``SPELLED_REGIONS`` with spelled-out addresses between words.  It takes a second or two, once on the driver.

Spans of the patterns stay; the field adds those that overlap none of them.
"""

from __future__ import annotations

import random
import re
from array import array
from bisect import bisect_left
from collections.abc import Iterator
from functools import lru_cache
from itertools import accumulate, pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from ._common import text_of

KINDS = ("email", "ip", "card", "phone")
EMAIL = re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
IP = re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)")
CARD = re.compile(r"[0-9]([\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
MARK = re.compile(r"[0-9@]")
REGION = re.compile(r"[^\s]*[0-9@][^\s]*(?:\x20(?:[^\s]*[0-9@][^\s]*|(?:at|dot|AT|DOT|\(at\)|\[at\]|\(dot\)|\[dot\])(?=\x20)))*")
ATOM = re.compile(r"\s?[(\[](?:at|AT|dot|DOT)[)\]]\s?|\s(?:at|AT|dot|DOT)\s|[0-9]+|[^\W\d_]+|.", re.S)
MAX_ATOMS = 14
MAX_SPAN = 400  # characters
TRAIN_REGIONS = 260
SPELLED_REGIONS = 80
RIDGE = 0.02


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(reversed(digits)):
        x = ord(d) - 48
        if i % 2:
            x = 2 * x - 9 * (x > 4)
        total += x
    return total % 10 == 0


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) by kind, then start: leftmost non-overlapping matches of each pattern that pass their check."""
    out: list[tuple[int, int, int]] = []
    if "@" in text:
        out += [(0, m.start(), m.end()) for m in _emails(text)]
    if not MARK.search(text):
        return out
    out += [(1, m.start(), m.end()) for m in _ADDRESS.finditer(text) if all(len(y := x.lstrip("0")) <= 3 and int(y or 0) <= 255 for x in m[0].split("."))]
    out += [(2, m.start(), m.end()) for m in CARD.finditer(text) if len(m[0]) >= 13 and 13 <= len(d := _digits(m[0])) <= 19 and luhn(d)]
    if "+" in text:
        out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 9 <= len(_digits(m[0])) <= 15]
    return out


#: What IP matches: a match never starts inside a run of digits, nor gives digits of one back, so a long run is read once.
_ADDRESS = re.compile(r"(?<![0-9])[0-9]++(?:\.[0-9]++){3}")


def _emails(text: str) -> Iterator[re.Match]:
    """What EMAIL.finditer gives, without trying it at every word: a match holds one at-sign behind its longest run of local characters."""
    low, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > low and text[start - 1] in _LOCAL_CHARS:
            start -= 1
        m = EMAIL.match(text, start) if start < at else None
        if m:
            yield m
            low = m.end()
        at = text.find("@", max(at + 1, low))


_LOCAL_CHARS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")

# -- the field ------------------------------------------------------------------------------------------------
FEATURES = (
    "bias", "luhn", "digits<7", "digits7-8", "digits9-11", "digits12", "digits13-19", "digits15-16", "digits>19", "groups1", "groups2-3", "groups4", "groups>4", "even_groups4", "octets", "dots3", "at1", "spelled_at", "domain",
    "letters", "letters_no_at", "plus_first", "paren", "hyphen", "space", "other_symbol", "touch_left", "touch_right", "edge_symbol", "cue_phone", "cue_card", "cue_mail", "cue_ip", "no_digit", "bare_at",
)
_F = {f: i for i, f in enumerate(FEATURES)}
_CUES = {"cue_phone": re.compile(r"tel|phon|call|fax|mobil|handy|cell", re.I), "cue_card": re.compile(r"card|visa|kart|carte|tarjeta|master", re.I), "cue_mail": re.compile(r"mail|contact|write", re.I), "cue_ip": re.compile(r"\bip\b|host|server|addr", re.I)}
_AT = r"(?:\s?@\s?|\s(?:at|AT)\s|\s?[(\[](?:at|AT)[)\]]\s?)"
_DOT = r"(?:\.|\s(?:dot|DOT)\s|\s?[(\[](?:dot|DOT)[)\]]\s?)"
_DOMAIN = re.compile(rf"{_AT}[\w-]+(?:{_DOT}[A-Za-z0-9-]{{2,}})+\Z")
_SPELLED = re.compile(r"\s(?:at|AT)\s|[(\[](?:at|AT)[)\]]")
_BARE = re.compile(r"[^\W\d_]+\s(?:at|AT)\s[\w.-]+\Z")
#: An address from its at-sign on, spelled out or set in blanks, and the words before one.
_SPELLED_ADDRESS = re.compile(rf"{_AT}[\w-]++(?:{_DOT}[A-Za-z0-9-]{{2,}}+)+")
_DOT_NEXT = re.compile(r"(?:\s(?:dot|DOT)\s|\s?[(\[](?:dot|DOT)[)\]]\s?)[A-Za-z0-9]")
_LOCAL_DOT = re.compile(r"(?:\s(?:dot|DOT)\s|\s?[(\[](?:dot|DOT)[)\]]\s?)\Z")


def span_features(region: str, start: int, end: int, cues: tuple[str, ...]) -> list[int]:
    """Indices of the features that hold for region[start:end] as a whole."""
    s = region[start:end]
    d = _digits(s)
    n = len(d)
    on = ["bias", *cues]
    groups = [g for g in re.split(r"[^0-9]+", s) if g]
    letters = any(c.isalpha() for c in s)
    if n == 0:
        on.append("no_digit")
    else:
        on.append("digits<7" if n < 7 else "digits7-8" if n < 9 else "digits9-11" if n < 12 else "digits12" if n < 13 else "digits13-19" if n < 20 else "digits>19")
        on.append("groups1" if len(groups) == 1 else "groups2-3" if len(groups) < 4 else "groups4" if len(groups) == 4 else "groups>4")
        if 15 <= n <= 16:
            on.append("digits15-16")
        if 13 <= n <= 19 and luhn(d):
            on.append("luhn")
        if len(groups) == 4 and len({len(g) for g in groups}) == 1:
            on.append("even_groups4")
    if re.fullmatch(r"\d{1,3}(?:\.\d{1,3}){3}", s):
        on.append("dots3")
        if all(int(g) <= 255 for g in groups):
            on.append("octets")
    if s.count("@") == 1:
        on.append("at1")
    if _SPELLED.search(s):
        on.append("spelled_at")
        if _BARE.fullmatch(s):  # as in: look at example.com
            on.append("bare_at")
    if _DOMAIN.search(s):
        on.append("domain")
    if letters:
        on.append("letters")
        if "at1" not in on and "spelled_at" not in on:
            on.append("letters_no_at")
    if s[0] == "+":
        on.append("plus_first")
    on += [f for f, c in (("paren", "("), ("hyphen", "-"), ("space", " ")) if c in s]
    if any(not (c.isalnum() or c in " ()+-.@_%") for c in s):
        on.append("other_symbol")
    if start and (region[start - 1].isalnum() or region[start - 1] in "+.-@_" or _LOCAL_DOT.search(region, max(0, start - 8), start)):
        on.append("touch_left")
    if end < len(region) and (region[end].isalnum() or region[end] in "@_-" or region[end] == "." and end + 1 < len(region) and region[end + 1].isalnum() or _DOT_NEXT.match(region, end)):
        on.append("touch_right")
    if not (s[0].isalnum() or s[0] in "+(") or not s[-1].isalnum():
        on.append("edge_symbol")
    return [_F[f] for f in on]


def _cues(before: str) -> tuple[str, ...]:
    return tuple(k for k, p in _CUES.items() if p.search(before[-16:]))


def _segments(region: str, before: str) -> tuple[list[tuple[int, int]], list[tuple[int, int, list[int]]]]:
    """Atoms' places, and candidate entity segments (first atom, atom after the last, features)."""
    ends = array("q", [0, *(m.end() for m in ATOM.finditer(region))])
    cues = _cues(before)
    return list(pairwise(ends)), [(a, b, f) for a in range(len(ends) - 1) for b, f in _segments_from(region, ends, a, cues)]


def _segments_from(region: str, ends: array, a: int, cues: tuple[str, ...]) -> Iterator[tuple[int, list[int]]]:
    """(atom after the last, features) of the candidates from atom ``a``: at most ``MAX_SPAN`` characters that start and end on letters, digits, plus or parenthesis and hold a digit or an at-sign, spelled out or not. Atom i lies in region[ends[i]:ends[i + 1]]."""
    lo = ends[a]
    if not (region[lo].isalnum() or region[lo] in "+("):
        return
    for b in range(a + 1, min(len(ends) - 1, a + MAX_ATOMS) + 1):
        hi = ends[b]
        if hi - lo > MAX_SPAN:
            return
        if region[hi - 1].isalnum() and (b - a > 1 or hi - lo > 6) and (MARK.search(region, lo, hi) or _SPELLED.search(region, lo, hi)):
            yield b, span_features(region, lo, hi, cues)


def _generate(rng: random.Random) -> tuple[str, str, list[tuple[int, int, int]]]:
    """(region, text before, entities) of one training example."""
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(3, 8)))
    num = lambda n: "".join(rng.choice("0123456789") for _ in range(n))

    def card() -> str:
        n = rng.choice((15, 16, 16, 16))
        body = num(n - 1)
        if rng.random() < 0.6:
            body += next(c for c in "0123456789" if luhn(body + c))
        else:
            body += num(1)
        if n == 16 and rng.random() < 0.4:
            body = rng.choice(" -").join(body[i : i + 4] for i in range(0, 16, 4))
        return body

    def phone() -> str:
        a, b, c = num(3), num(3), num(4)
        return rng.choice((f"+1 ({a}) {b}-{c}", f"({a}) {b}-{c}", f"+{rng.randint(2, 99)} {a} {b} {c}", f"{a}-{b}-{c}", f"+1-{a}-{b}-{c}", f"{a}.{b}.{c}"))

    def email() -> str:
        u, d = word() + rng.choice(("", num(2), "." + word())), word() + rng.choice(("", num(1)))
        return rng.choice((f"{u}@{d}.com", f"{u}@{d}.example.org", f"{u} at {d} dot com", f"{u} (at) {d} (dot) org"))

    make = (email, lambda: ".".join(str(rng.randint(1, 255)) for _ in range(4)), card, phone)
    noise = (
        lambda: str(rng.randint(1900, 2030)), lambda: f"{rng.randint(1, 99)}.{rng.randint(0, 9)}", lambda: f"v{rng.randint(1, 9)}.{rng.randint(0, 20)}.{rng.randint(0, 20)}", lambda: f"{rng.randint(1, 28)}/{rng.randint(1, 12)}/{rng.randint(1990, 2030)}", lambda: f"2{num(3)}-0{rng.randint(1, 9)}-{rng.randint(10, 28)}",
        lambda: f"${num(2)}.{num(2)}", lambda: "".join(rng.choice("0123456789abcdef") for _ in range(40)), lambda: num(rng.randint(1, 6)), lambda: f"{word()}{num(2)}", lambda: f"{num(1)},{num(3)},{num(3)}", lambda: num(rng.randint(20, 30)), lambda: f"@{word()}", lambda: f"{num(1)}.{num(1)}.{num(1)}.",
    )
    text, entities = "", []
    for _ in range(rng.randint(1, 3)):
        if text:
            text += " "
        if rng.random() < 0.55:
            k = rng.randrange(4)
            s = make[k]()
            entities.append((k, len(text), len(text) + len(s)))
            text += s
            if rng.random() < 0.3:
                text += rng.choice((".", ",", "!!", "***", ";", ")"))
        else:
            text += rng.choice(noise)()
    return text, rng.choice((word(), "call", "card", "mail", "tel:", "ip", word(), word())) + " ", entities


def _generate_spelled(rng: random.Random) -> tuple[str, str, list[tuple[int, int, int]]]:
    """As ``_generate``: one spelled-out address between words, or words about a site that are none."""
    word = lambda: "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(rng.randint(2, 8)))
    u, d = word(), word() + rng.choice(("", str(rng.randint(0, 9))))
    if rng.random() < 0.3:
        return f"{u} {rng.choice(('at', 'AT'))} {d}.{rng.choice(('com', 'org', 'example.org'))}", word() + " ", []
    named = u + rng.choice((str(rng.randint(1, 99)), "." + word(), "_" + word()))
    s = rng.choice((f"{named} at {d}.com", f"{rng.choice((u, named))} @ {d}.com", f"{u} (at) {d}.com", f"{rng.choice((u, named))} [at] {d} [dot] com", f"{u} at {d} dot co dot uk", f"{u} dot {word()} at {d} dot com", f"{named}(at){d}(dot)org", f"{u} AT {d} DOT com"))
    left = rng.choice(("", "", word() + " "))
    return left + s + rng.choice(("", "", " " + word(), ".", ",")), word() + " ", [(0, len(left), len(left) + len(s))]


def _forward(n: int, into: list[list[tuple[int, int, float]]], other: float) -> np.ndarray:
    """log sums over segmentations of the first j atoms."""
    alpha = np.zeros(n + 1)
    for j in range(1, n + 1):
        terms = [alpha[j - 1] + other] + [alpha[a] + s for a, _, s in into[j]]
        top = max(terms)
        alpha[j] = top + np.log(sum(np.exp(t - top) for t in terms))
    return alpha


def fit(regions: int = TRAIN_REGIONS, seed: int = 11, rounds: int = 60) -> np.ndarray:
    """Weights, types x features; a segment of ``other`` scores 0 for each atom."""
    rng, data = random.Random(seed), []
    for text, before, entities in [*(_generate(rng) for _ in range(regions)), *(_generate_spelled(rng) for _ in range(SPELLED_REGIONS))]:
        atoms, segments = _segments(text, before)
        place = {lo: i for i, (lo, _) in enumerate(atoms)} | {len(text): len(atoms)}
        gold = {(place.get(lo), place.get(hi, -1)): k for k, lo, hi in entities}
        rows = np.zeros((len(segments), len(FEATURES)), np.float64)
        for i, (_, _, f) in enumerate(segments):
            rows[i, f] = 1
        data.append((len(atoms), [(a, b) for a, b, _ in segments], rows, [gold.get((a, b), -1) for a, b, _ in segments]))
    w = np.zeros((len(KINDS), len(FEATURES)))
    step, speed = np.zeros_like(w), np.zeros_like(w)
    for t in range(1, rounds + 1):
        grad = -RIDGE * w * regions / 10
        for n, spans, rows, gold in data:
            if not spans:
                continue
            scores = rows @ w.T
            into: list[list] = [[] for _ in range(n + 1)]
            back: list[list] = [[] for _ in range(n + 1)]
            total = np.logaddexp.reduce(scores, axis=1)
            for i, (a, b) in enumerate(spans):
                into[b].append((a, i, total[i]))
                back[n - a].append((n - b, i, total[i]))
            alpha, beta = _forward(n, into, 0.0), _forward(n, back, 0.0)[::-1]
            starts, ends = np.array([a for a, _ in spans]), np.array([b for _, b in spans])
            prob = np.exp(alpha[starts] + beta[ends] - alpha[n] + total)[:, None] * np.exp(scores - total[:, None])
            want = np.zeros_like(prob)
            for i, k in enumerate(gold):
                if k >= 0:
                    want[i, k] = 1
            grad += (want - prob).T @ rows
        # Adam, full batch
        step = 0.9 * step + 0.1 * grad
        speed = 0.99 * speed + 0.01 * grad * grad
        w += 0.25 * (step / (1 - 0.9**t)) / (np.sqrt(speed / (1 - 0.99**t)) + 1e-8)
    return w


@lru_cache(maxsize=1)
def trained() -> np.ndarray:
    return fit()


def decode(region: str, before: str, weights: np.ndarray) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the best segmentation's entities, places in the region. The programme runs over the whole region, however long; wherever no entity can lie across, what is before is settled."""
    ends = array("q", [0, *(m.end() for m in ATOM.finditer(region))])
    cues, n = _cues(before), len(ends) - 1
    out: list[tuple[int, int, int]] = []
    came: dict[int, tuple[int, int]] = {}
    coming: dict[int, tuple[float, int, int]] = {}  # by end: score, first atom, type
    value, settled, reach = 0.0, 0, 0
    for a in range(n + 1):
        score, first, k = coming.pop(a, (0.0, 0, 0))
        if score > value:
            value, came[a] = score, (first, k)
        if a >= reach:
            found, j = [], a
            while j > settled:
                if j in came:
                    first, k = came[j]
                    found.append((k, ends[first], ends[j]))
                    j = first
                else:
                    j -= 1
            out += found[::-1]
            value, settled = 0.0, a
            came.clear()
        if a == n:
            break
        for b, f in _segments_from(region, ends, a, cues):
            s = weights[:, f].sum(axis=1)
            k = int(s.argmax())
            if s[k] > 0:
                reach = max(reach, b)
                if b not in coming or value + float(s[k]) > coming[b][0]:
                    coming[b] = (value + float(s[k]), a, k)
    return out


def regions(text: str) -> Iterator[re.Match]:
    """What REGION.finditer gives, found from its digits and at-signs, so that a long word without one is read once and not from each of its places."""
    at = 0
    while mark := MARK.search(text, at):
        start = mark.start()
        while start > at and not text[start - 1].isspace():
            start -= 1
        m = REGION.match(text, start)
        yield m
        at = m.end()


def spelled(text: str) -> Iterator[tuple[int, int]]:
    """Places of what may be a spelled-out address: the domain behind its at-sign and the word before it, with those that dots join to it."""
    low = 0
    for m in _SPELLED_ADDRESS.finditer(text):
        start = m.start()
        while True:
            at = start
            while at > low and text[at - 1] in _LOCAL_CHARS:
                at -= 1
            if at == start:
                break
            start = at
            dot = _LOCAL_DOT.search(text, max(low, at - 8), at)
            if dot is None or dot.start() == low or text[dot.start() - 1] not in _LOCAL_CHARS:
                break
            start = dot.start()
        if start < m.start():
            yield start, m.end()
        low = m.end()


def field_regions(text: str) -> list[tuple[int, int]]:
    """Places that the field decodes, in order and disjoint: regions with enough digits for any type or an at-sign, and spelled-out addresses."""
    places = list(spelled(text))
    for m in regions(text):
        lo, end = m.start(), m.end()
        if "@" not in m[0] and sum("0" <= c <= "9" for c in m[0]) < 7:
            continue  # too few digits for any type
        # A parenthesis or a word before may belong to it.
        places.append((text.rfind(" ", max(0, lo - 40), max(0, lo - 1)) + 1 if re.match(r"[(\[]?(?:at|AT)[)\]]?\s|@", m[0]) else lo, end))
    out: list[tuple[int, int]] = []
    for lo, end in sorted(places):
        if out and lo < out[-1][1]:
            out[-1] = (out[-1][0], max(end, out[-1][1]))
        else:
            out.append((lo, end))
    return out


def field_spans(text: str, weights: np.ndarray) -> list[tuple[int, int, int]]:
    """The field's entities in a whole text."""
    return [(k, lo + a, lo + b) for lo, end in field_regions(text) for k, a, b in decode(text[lo:end], text[max(0, lo - 16) : lo], weights)]


def all_spans(text: str, weights: np.ndarray) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
    base = base_spans(text)
    taken = sorted((a, b) for _, a, b in base)
    starts, reach = [a for a, _ in taken], list(accumulate((b for _, b in taken), max))
    # Of the patterns' spans that start before this one's end, does any reach beyond its start?
    extra = [x for x in field_spans(text, weights) if not ((i := bisect_left(starts, x[2])) and reach[i - 1] > x[1])]
    return base, sorted(set(base) | set(extra))


def scan(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: id, ``base`` and ``found`` (arrays of struct(kind, start, end), by kind, then start; code points, end exclusive).

    Null text counts as empty; repeated rows give repeated rows; other columns are not read.
    """
    weights, kind = trained(), dict(docs.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        show = lambda x: [{"kind": KINDS[k], "start": a, "end": b} for k, a, b in x]
        for batch in batches:
            both = [all_spans(t, weights) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array([show(x[i]) for x in both], spans) for i in (0, 1))], [id_col, "base", "found"])

    one = "array<struct<kind:string,start:int,end:int>>"
    return docs.select(docs[id_col].alias(id_col), text_of(docs, text_col).alias("t")).mapInArrow(run, f"`{id_col}` {kind}, base {one}, found {one}")
