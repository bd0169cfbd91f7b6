"""Personal data by fixed patterns and a semi-Markov conditional random field.

The base patterns (email, ip, card, phone) are read left to right and checked; a match that fails its check is dropped.  They lose
data where two of them stand next to each other, since a greedy match runs into its neighbour, and they do not know
addresses with letters beyond ASCII or phone numbers without a country code.

The random field looks at regions: runs of digits and their separators with at least seven digits, and what surrounds an "@".  A region is a
sequence of atoms (a run of digits, a run of letters, any other character).  A segment is one atom of no type, or an entity of
one of the four types with up to ``BOUND`` atoms.  An entity is scored as a whole: number of digits, lengths of its first, last and
longest run, separators, check digit, parts of an address, the domain, what stands before and after it.  Dynamic programming over
segment ends chooses the boundaries and types with the highest total score; atoms of base spans are taken, so it only adds.

Weights are learned here, by maximum likelihood (forward and backward sums over all segmentations).  The regions to learn from are a
bounded sample of the corpus, labelled by the base patterns, and regions composed by rule: entities next to each other, spellings the
patterns do not know, and look-alikes such as dates, versions and article numbers.
"""

from __future__ import annotations

import re
from collections.abc import Iterable
from dataclasses import dataclass
from itertools import islice

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

# Kinds in the order of results, the base patterns, and words that announce a kind.
KINDS = ["email", "ip", "card", "phone"]
DOMAIN = re.compile(r"@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
LOCAL = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-"
IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
CUES = [
    ["mail", "email", "e", "contact", "write", "correo", "courriel"],
    ["ip", "host", "server", "address", "addr", "adresse"],
    ["card", "visa", "credit", "debit", "mastercard", "karte", "tarjeta", "carte"],
    ["phone", "tel", "fax", "call", "mobile", "cell", "telefon", "telephone", "telefono", "ruf"],
]
#: Longest entity in atoms; regions and atoms of a region that are learned from; documents that the sample looks at, about.
BOUND, MAX_REGIONS, MAX_ATOMS, SAMPLE_DOCS = 24, 600, 48, 4000
#: Candidates scored at once, and bytes of text whose regions are decoded together.
CANDIDATES, BATCH_BYTES = 1 << 17, 1 << 20

_DIGITS = re.compile(r"[+(]?[0-9](?:[0-9 ().+-]*[0-9])?")
_BEFORE, _BEHIND = re.compile(r"[\w.%+&'-]*"), re.compile(r"[\w.%+&'@-]*")
_ATOM = re.compile(r"[0-9]+|[^\W\d_]+|.", re.S)
_WORD = re.compile(r"([^\W\d_]+)[^\w\n]{0,4}$")
# Classes of atoms; ends of the text and any other character have their own.
_CLASSES = {" ": 3, "\n": 3, "\t": 3, ".": 4, "-": 5, "(": 6, ")": 7, "+": 8, "@": 9, "_": 10, ",": 12, ":": 13, "/": 14, "#": 15, "$": 16, "%": 17}
_DIGIT, _LETTER, _OTHER, _NONE, _N_CLASSES = 1, 2, 11, 0, 18


def _luhn(digits: str) -> bool:
    values = [int(c) for c in reversed(digits)]
    return sum(v if k % 2 == 0 else 2 * v - 9 * (v > 4) for k, v in enumerate(values)) % 10 == 0


def _small(part: str) -> bool:
    part = part.lstrip("0")
    return len(part) <= 3 and int(part or 0) <= 255


def base_spans(text: str) -> list[tuple[int, int, int]]:
    """(kind, start, end) of the checked matches of the base patterns, by kind, then start.  Linear in the text."""
    out, last, at = [], 0, 0
    for m in DOMAIN.finditer(text) if "@" in text else ():
        # No "@" lies in a local part, so it reaches back to the previous "@" or the previous match at most.
        floor = max(last, text.rfind("@", at, m.start()) + 1)
        at = m.start()
        before = text[floor:at]
        start = floor + len(before.rstrip(LOCAL))
        if start < at:
            out.append((0, start, m.end()))
            last = m.end()
    out += [(1, m.start(), m.end()) for m in IP.finditer(text) if all(map(_small, m[0].split(".")))]
    for m in CARD.finditer(text):
        if m.end() - m.start() >= 16 and 16 <= len(digits := re.sub("[ -]", "", m[0])) <= 19 and _luhn(digits):
            out.append((2, m.start(), m.end()))
    out += [(3, m.start(), m.end()) for m in PHONE.finditer(text) if 8 <= sum(c.isdigit() for c in m[0]) <= 15] if "+" in text else []
    return out


@dataclass(frozen=True)
class Region:
    """A stretch of text with what stands around it; *taken*: (start, end) pairs that no entity may touch."""

    text: str
    cue: int = 4
    before: int = _NONE
    after: int = _NONE
    taken: tuple[tuple[int, int], ...] = ()


def _class_of(char: str) -> int:
    if not char:
        return _NONE
    return _DIGIT if "0" <= char <= "9" else _LETTER if char.isalpha() else _CLASSES.get(char, _OTHER)


def _cue(before: str) -> int:
    word = _WORD.search(before)
    return next((k for k, words in enumerate(CUES) if word and word[1].lower() in words), 4)


def regions(text: str, spans: Iterable[tuple[int, int, int]]) -> list[tuple[int, Region]]:
    """(offset, region) of every stretch that may hold an entity outside the *spans*; none of an entity's atoms is cut off."""
    found = [(m.start(), m.end()) for m in _DIGITS.finditer(text) if m.end() - m.start() >= 7 and sum("0" <= c <= "9" for c in m[0]) >= 7]
    last, at = 0, text.find("@")
    while at >= 0:
        # A run around one or more "@"; what lies more than a bound of atoms from them cannot belong to an entity with one.
        end = _BEHIND.match(text, at).end()
        begin = at - _BEFORE.match(text[last:at][::-1]).end()
        left = [x.start() for x in _ATOM.finditer(text, begin, at)][-BOUND:]
        right = [x.end() for x in islice(_ATOM.finditer(text, text.rindex("@", at, end) + 1, end), BOUND)]
        found.append((left[0] if left else at, right[-1] if right else end))
        last, at = end, text.find("@", end)
    joined: list[list[int]] = []
    for start, end in sorted(found):
        if joined and start < joined[-1][1]:
            joined[-1][1] = max(joined[-1][1], end)
        else:
            joined.append([start, end])
    taken: list[list[int]] = []
    for s, e in sorted((s, e) for _, s, e in spans):
        if taken and s <= taken[-1][1]:
            taken[-1][1] = max(taken[-1][1], e)
        else:
            taken.append([s, e])
    out, k = [], 0
    for start, end in joined:
        while k < len(taken) and taken[k][1] <= start:
            k += 1
        inside, j, free, at = [], k, [], start
        while j < len(taken) and taken[j][0] < end:
            inside.append((max(taken[j][0], start) - start, min(taken[j][1], end) - start))
            free.append(text[at:start + inside[-1][0]])
            at = start + inside[-1][1]
            j += 1
        rest = "".join(free) + text[at:end]
        if inside and "@" not in rest and sum("0" <= c <= "9" for c in rest) < 7:
            continue
        out.append((start, Region(text[start:end], _cue(text[max(0, start - 24):start]), _class_of(text[start - 1:start]), _class_of(text[end:end + 1]), tuple(inside))))
    return out


class Atoms:
    """Arrays over the atoms of some regions, padded to the longest; sums run from the region's start."""

    def __init__(self, group: list[Region]):
        pieces = [list(_ATOM.finditer(r.text)) for r in group]
        self.sizes = np.array([len(p) for p in pieces])
        shape = (len(group), int(self.sizes.max(initial=0)) + 2)
        self.kind, self.length = np.zeros(shape, np.int64), np.zeros(shape, np.int64)
        self.ends = [[m.end() for m in p] for p in pieces]
        self.starts = [[m.start() for m in p] for p in pieces]
        over, blocked = np.zeros(shape, bool), np.zeros(shape, bool)
        self.cue = np.array([r.cue for r in group])
        luhn = np.zeros((2, *shape), np.int64)
        for k, (region, piece) in enumerate(zip(group, pieces)):
            self.kind[k, 0] = region.before
            seen, shut = 0, np.zeros(len(region.text) + 1, np.int64)
            for start, end in region.taken:
                shut[start:end] = 1
            for j, m in enumerate(piece, 1):
                kind = _class_of(m[0][0])
                self.kind[k, j], self.length[k, j] = kind, m.end() - m.start()
                if kind == _DIGIT:
                    over[k, j] = not _small(m[0])
                    values = np.frombuffer(m[0].encode(), np.uint8).astype(np.int64) - 48
                    doubled = 2 * values - 9 * (values > 4)
                    even = (np.arange(seen, seen + len(values)) % 2) == 0
                    luhn[0, k, j], luhn[1, k, j] = np.where(even, doubled, values).sum(), np.where(even, values, doubled).sum()
                    seen += len(values)
                blocked[k, j] = bool(region.taken) and shut[m.start():m.end()].any()
            self.kind[k, len(piece) + 1] = region.after
        digit = self.kind == _DIGIT
        same = np.zeros(shape, bool)
        same[:, 1:] = (self.kind[:, 1:] == self.kind[:, :-1]) & ~digit[:, 1:] & (self.kind[:, 1:] != _LETTER)
        self.n = {name: np.cumsum(values, axis=1) for name, values in {
            "digits": np.where(digit, self.length, 0), "runs": digit, "letters": self.kind == _LETTER, "spaces": self.kind == 3, "dots": self.kind == 4,
            "hyphens": self.kind == 5, "brackets": (self.kind == 6) | (self.kind == 7), "pluses": self.kind == 8, "at": self.kind == 9,
            "others": self.kind >= 10, "over": over, "blocked": blocked, "doubles": same, "luhn0": luhn[0], "luhn1": luhn[1]}.items()}
        position = np.arange(shape[1])
        self.last_at = np.maximum.accumulate(np.where(self.kind == 9, position, 0), axis=1)
        self.longest = np.where(digit, self.length, 0)

    def candidates(self, first: int, last: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(region, end, length) of the admissible segments whose last atom is in first..last (from 1)."""
        ends = np.arange(first, last + 1)
        spans = np.arange(1, BOUND + 1)
        begin = ends[:, None] - spans[None, :]  # atoms begin+1 .. end
        inside = (begin >= 0)[None] & (ends[None, :, None] <= self.sizes[:, None, None])
        begin = np.maximum(begin, 0)

        def count(name: str) -> np.ndarray:
            total = self.n[name]
            return total[:, ends][:, :, None] - total[:, begin]

        head, tail = self.kind[:, np.minimum(begin + 1, self.kind.shape[1] - 1)], self.kind[:, ends][:, :, None]
        inside &= ((head == _DIGIT) | (head == _LETTER) | (head == 8) | (head == 6)) & ((tail == _DIGIT) | (tail == _LETTER) | (tail == 7))
        at, letters, dots = count("at"), count("letters"), count("dots")
        number = (at == 0) & (letters == 0) & (count("others") == 0) & ((count("digits") >= 7) | ((dots == 3) & (count("runs") == 4)))
        address = (at == 1) & (count("spaces") == 0) & (letters >= 1)
        rows, end, span = np.nonzero(inside & (number | address) & (count("blocked") == 0))
        return rows, end + first, span + 1

    def features(self, rows: np.ndarray, end: np.ndarray, span: np.ndarray) -> np.ndarray:
        """One feature id in each of the groups of FEATURES for every segment."""
        begin = end - span
        n = {name: total[rows, end] - total[rows, begin] for name, total in self.n.items()}
        head, tail = self.kind[rows, begin + 1], self.kind[rows, end]
        left, right = self.kind[rows, begin], self.kind[rows, end + 1]
        # Whether the digit before the last one is doubled depends on the parity of the digits up to here.
        parity = self.n["digits"][rows, end] % 2
        check = np.where(parity == 0, n["luhn0"], n["luhn1"]) % 10
        digits, size = n["digits"], self.length
        first_run = np.where(head == _DIGIT, size[rows, begin + 1], size[rows, np.minimum(begin + 2, end)] * (self.kind[rows, np.minimum(begin + 2, end)] == _DIGIT))
        last_run = np.where(tail == _DIGIT, size[rows, end], 0)
        # Longest run of digits: the greatest over the atoms, a step for each possible length of a segment.
        longest = np.zeros(len(rows), np.int64)
        for k in range(int(span.max(initial=0))):
            longest = np.maximum(longest, np.where(k < span, self.longest[rows, np.maximum(end - k, 0)], 0))
        at = self.last_at[rows, end]
        has_at = n["at"] > 0
        after = self.n["dots"][rows, end] - self.n["dots"][rows, np.maximum(at, begin)]
        label = np.where(has_at & (tail == _LETTER) & (self.kind[rows, end - 1] == 4), np.where((size[rows, end] >= 2) & (size[rows, end] <= 12), 1, 2), 0)
        domain = np.where(has_at, 1 + np.minimum(after, 2) * 3 + label, 0)
        start_at = np.where(has_at, 1 + (at == begin + 1) + 2 * np.isin(self.kind[rows, np.minimum(at + 1, end)], (4, 5, 9)), 0)
        separators = (n["spaces"] > 0) + 2 * (n["dots"] > 0) + 4 * (n["hyphens"] > 0) + 8 * (n["brackets"] > 0) + 16 * (n["pluses"] > 0)
        quad = (span == 7) & (n["runs"] == 4) & (n["dots"] == 3)
        address = np.where(quad, 1 + (n["over"] > 0), 0)
        card = np.where((digits >= 12) & (digits <= 19) & ~has_at, 1 + 2 * (digits - 12) + (check == 0), 0)
        plus = np.where(head == 8, 1, np.where(n["pluses"] > 0, 2, 0))
        columns = [
            np.minimum(digits, 24), np.minimum(n["runs"], 8), head, tail, left, right, domain, start_at, separators, address, card, plus,
            np.minimum(first_run, 7), np.minimum(last_run, 7), np.minimum(longest, 20), np.minimum(n["doubles"], 2), self.cue[rows],
            np.minimum(n["letters"], 6), np.where(digits >= 7, np.minimum(n["brackets"], 3) * 8 + np.minimum(n["runs"], 7), 0),
        ]
        return np.stack([c + base for c, base in zip(columns, _BASES)], axis=1)


#: Values of each group of features, in the order of ``Atoms.features``.
FEATURES = [25, 9, _N_CLASSES, _N_CLASSES, _N_CLASSES, _N_CLASSES, 10, 5, 32, 3, 17, 3, 8, 8, 21, 3, 5, 7, 32]
_BASES = np.concatenate([[0], np.cumsum(FEATURES)[:-1]])


@dataclass(frozen=True)
class Field:
    """*weights*: one row for each feature, one column for each kind; *moves*: score of a kind (last: none) after another."""

    weights: np.ndarray
    moves: np.ndarray


_O = len(KINDS)
_NO = -1e30


def _dense(atoms: Atoms, weights: np.ndarray, first: int, last: int) -> np.ndarray:
    """Scores [region, end, length, kind] of the segments that end in first..last; _NO where there is none."""
    scores = np.full((len(atoms.sizes), last - first + 1, BOUND, _O), _NO)
    rows, end, span = atoms.candidates(first, last)
    if len(rows):
        scores[rows, end - first, span - 1] = weights[atoms.features(rows, end, span)].sum(1)
    return scores


def viterbi(group: list[Region], field: Field) -> list[list[tuple[int, int, int]]]:
    """(kind, start, end) of the entities of every region in its best segmentation; all regions advance together."""
    atoms = Atoms(group)
    many, most = len(group), int(atoms.sizes.max(initial=0))
    # best[:, t, y]: the best score of the first t atoms, the last segment being y; reach: the same, before a segment of y.
    best, reach = np.full((many, most + 1, _O + 1), _NO), np.full((many, most + 1, _O + 1), _NO)
    came, spans = np.zeros((many, most + 1, _O + 1), np.int8), np.ones((many, most + 1, _O + 1), np.int8)
    best[:, 0, _O] = 0
    step = max(1, CANDIDATES // (BOUND * max(many, 1)))
    for first in range(1, most + 1, step):
        last = min(first + step - 1, most)
        scores = _dense(atoms, field.weights, first, last)
        for t in range(first, last + 1):
            total = best[:, t - 1, :, None] + field.moves[None]
            came[:, t - 1], reach[:, t - 1] = total.argmax(1), total.max(1)
            wide = min(t, BOUND)
            options = reach[:, t - wide:t, :_O][:, ::-1] + scores[:, t - first, :wide]
            spans[:, t, :_O] = options.argmax(1) + 1
            best[:, t, :_O] = options.max(1)
            best[:, t, _O] = reach[:, t - 1, _O]
    out = []
    for k in range(many):
        t, found = int(atoms.sizes[k]), []
        y = int(best[k, t].argmax()) if t else _O
        while t > 0:
            span = int(spans[k, t, y])
            if y < _O:
                found.append((y, atoms.starts[k][t - span], atoms.ends[k][t - 1]))
            t -= span
            y = int(came[k, t, y])
        out.append(found[::-1])
    return out


def decode(found: list[Region], field: Field) -> dict[Region, list[tuple[int, int, int]]]:
    """Entities of different regions, in groups of about equal length."""
    order = sorted(set(found), key=lambda r: (len(r.text), r.text))
    out, group, width = {}, [], 0
    for k, region in enumerate(order, 1):
        group.append(region)
        width = max(width, len(region.text))
        if len(group) * width >= 1 << 12 or k == len(order) or len(order[k].text) > 2 * len(group[0].text) + 16:
            out.update(zip(group, viterbi(group, field)))
            group, width = [], 0
    return out


def _sum_exp(values: np.ndarray, axis: int) -> np.ndarray:
    top = values.max(axis=axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(values - top).sum(axis=axis))


def learn(labelled: list[tuple[Region, list[tuple[int, int, int]]]], rounds: int = 80, rate: float = 0.3, ridge: float = 0.02) -> Field:
    """Maximum-likelihood weights of labelled regions by full-batch Adam; entities that are no admissible segment count as none."""
    weights, moves = np.zeros((sum(FEATURES), _O)), np.zeros((_O + 1, _O + 1))
    labelled = [(r, found) for r, found in labelled if r.text]
    if not labelled:
        return Field(weights, moves)
    atoms = Atoms([r for r, _ in labelled])
    many, most = len(labelled), int(atoms.sizes.max())
    rows, end, span = atoms.candidates(1, most)
    ids = atoms.features(rows, end, span)
    where = {(r, e, s): k for k, (r, e, s) in enumerate(zip(rows.tolist(), end.tolist(), span.tolist()))}
    truth, seen_moves = np.zeros((len(rows), _O)), np.zeros_like(moves)
    for k, (_, found) in enumerate(labelled):
        start_at, end_at = {s: j for j, s in enumerate(atoms.starts[k])}, {e: j + 1 for j, e in enumerate(atoms.ends[k])}
        known = {}
        for kind, start, stop in found:
            place = where.get((k, end_at.get(stop), end_at.get(stop, 0) - start_at.get(start, 0)))
            if place is not None and start in start_at:
                known[start_at[start]] = (kind, end_at[stop], place)
        t, last = 0, _O
        while t < atoms.sizes[k]:
            kind, t, place = known.get(t, (_O, t + 1, None))
            if place is not None:
                truth[place, kind] += 1
            seen_moves[last, kind] += 1
            last = kind
    state = [np.zeros_like(weights), np.zeros_like(weights), np.zeros_like(moves), np.zeros_like(moves)]
    index = np.arange(many)
    for step in range(1, rounds + 1):
        scores = np.full((many, most + 1, BOUND, _O), _NO)
        scores[rows, end, span - 1] = weights[ids].sum(1)
        forth, reach = np.full((many, most + 1, _O + 1), _NO), np.full((many, most + 1, _O + 1), _NO)
        forth[:, 0, _O] = 0
        for t in range(1, most + 1):
            reach[:, t - 1] = _sum_exp(forth[:, t - 1, :, None] + moves[None], 1)
            wide = min(t, BOUND)
            forth[:, t, :_O] = _sum_exp(reach[:, t - wide:t, :_O][:, ::-1] + scores[:, t, :wide], 1)
            forth[:, t, _O] = reach[:, t - 1, _O]
        back, ahead = np.full((many, most + BOUND + 2, _O + 1), _NO), np.full((many, most + 2, _O + 1), _NO)
        for t in range(most, -1, -1):
            wide = min(most - t, BOUND)
            if wide:
                j = np.arange(1, wide + 1)
                ahead[:, t, :_O] = _sum_exp(scores[:, t + j, j - 1] + back[:, t + j, :_O], 1)
                ahead[:, t, _O] = back[:, t + 1, _O]
                back[:, t] = _sum_exp(moves[None] + ahead[:, t, None, :], 2)
            back[atoms.sizes == t, t] = 0
        norm = _sum_exp(forth[index, atoms.sizes], 1)
        chance = np.exp(np.minimum(reach[rows, end - span, :_O] + scores[rows, end, span - 1] + back[rows, end, :_O] - norm[rows, None], 0))
        pulls = truth - chance
        slope = np.stack([np.bincount(ids.ravel(), np.repeat(pulls[:, y], ids.shape[1]), len(weights)) for y in range(_O)], 1)
        passed = np.exp(np.minimum(forth[:, :most, :, None] + moves[None, None] + ahead[:, :most, None, :] - norm[:, None, None, None], 0))
        passed[np.arange(most)[None] >= atoms.sizes[:, None]] = 0
        turn = seen_moves - passed.sum((0, 1))
        for at, grad, value in ((0, slope - ridge * weights, weights), (2, turn - ridge * moves, moves)):
            state[at] = 0.9 * state[at] + 0.1 * grad
            state[at + 1] = 0.99 * state[at + 1] + 0.01 * grad**2
            value += rate * (state[at] / (1 - 0.9**step)) / (np.sqrt(state[at + 1] / (1 - 0.99**step)) + 1e-8)
    return Field(weights, moves)


def _made(rng: np.random.Generator) -> list[tuple[Region, list[tuple[int, int, int]]]]:
    """Regions composed by rule, with their entities: the four kinds alone and side by side, other spellings, look-alikes."""
    def digits(n: int) -> str:
        return str(rng.integers(1, 10)) + "".join(str(c) for c in rng.integers(0, 10, n - 1))

    def card(good: bool = True) -> str:
        body = digits(15)
        last = next(c for c in "0123456789" if _luhn(body + c))
        body += last if good else str((int(last) + int(rng.integers(1, 10))) % 10)
        return "".join(body[k:k + 4] + (" -"[rng.integers(2)] if gap else "") for k in range(0, 12, 4)) + body[12:] if (gap := rng.integers(4) == 0) else body

    def ip(good: bool = True) -> str:
        parts = [int(x) for x in rng.integers(0, 256, 4)]
        if not good:
            parts[int(rng.integers(4))] = int(rng.integers(256, 999))
        return ".".join(map(str, parts))

    def phone() -> str:
        a, b, c, country = digits(3), digits(3), digits(4), rng.integers(1, 99)
        return [f"+{country} ({a}) {b}-{c}", f"+{country} {a} {b} {c}", f"+{country}-{a}-{b}-{c}", f"({a}) {b}-{c}", f"{a}-{b}-{c}", f"+{country}{a}{b}{c}",
                f"+{country} {a} {b}{c}"][rng.integers(7)]

    def name(n: int) -> str:
        return "".join("abcdefghijklmnopqrstuvwxyzéüñ"[k] for k in rng.integers(0, 29 if rng.integers(3) == 0 else 26, n))

    def email() -> str:
        return f"{name(rng.integers(2, 9))}{['', '.' + name(4), '.' + digits(2), '_' + name(3)][rng.integers(4)]}@{name(rng.integers(3, 8))}{['', digits(1)][rng.integers(2)]}.{['', name(6) + '.'][rng.integers(2)]}{['com', 'org', 'net', 'de', 'fr', 'es'][rng.integers(6)]}"

    def other() -> str:
        return [f"{rng.integers(1950, 2030)}-{rng.integers(10, 13)}-{rng.integers(10, 31)}", f"{rng.integers(10, 31)}.{rng.integers(10, 13)}.{rng.integers(1950, 2030)}",
                f"978-{rng.integers(10)}-{digits(2)}-{digits(6)}-{rng.integers(10)}", digits(int(rng.integers(7, 15))), ip(False), card(False), digits(int(rng.integers(17, 30))),
                f"{digits(3)} {digits(3)} {digits(3)}", f"{digits(4)}-{digits(4)}", f"{digits(1)}.{digits(2)}.{digits(3)}.{digits(1)}.{digits(2)}", f"{digits(4)}-{digits(6)}-{digits(2)}",
                f"{name(5)}@{name(6)}", f"@{name(8)}", f"{rng.integers(1950, 2030)} ({digits(2)}) {digits(3)}-{digits(3)}"][rng.integers(14)]

    kinds = [email, ip, card, phone]
    out = []
    for _ in range(520):
        parts = [(int(k), kinds[k]()) if k < 4 else (_O, other()) for k in rng.choice(5, 1 + int(rng.integers(5) // 2), p=[0.12, 0.2, 0.22, 0.22, 0.24])]
        text, found = "", []
        for kind, part in parts:
            text += [" ", " ", " ", "  ", " - "][rng.integers(5)] if text else ""
            if kind < _O:
                found.append((kind, len(text), len(text) + len(part)))
            text += part
        cue = found[0][0] if found and rng.integers(6) == 0 else 4
        out.append((Region(text, cue, [3, 3, 3, _NONE, 13][rng.integers(5)], [3, 3, 4, 12, _NONE, 15, 11][rng.integers(7)]), found))
    return out


def _texts(column: pa.Array) -> list[str]:
    return [(t or b"").decode("utf-8", "replace") for t in column.to_pylist()]


def fit(docs: DataFrame, text_col: str = "text", max_regions: int = MAX_REGIONS, sample_docs: int = SAMPLE_DOCS) -> Field:
    """Weights from at most *max_regions* different regions of about *sample_docs* documents, and from the composed ones.

    Documents are chosen by the hash of their text.  A region counts with the base spans in it as its entities; one in which a pattern matched
    and failed its check says nothing and is left out.  Null texts are left out; without any documents the composed regions remain.
    """
    text = F.col(f"`{text_col}`")
    many = docs.filter(text.isNotNull()).count()
    share = min(1.0, sample_docs / max(many, 1))
    rows = docs.filter(text.isNotNull() & (F.pmod(F.xxhash64(text), F.lit(1 << 20)) < int(share * (1 << 20)) + 1)).select(text.cast("binary").alias("text"))

    def extract(batches):
        for batch in batches:
            found: dict[str, tuple] = {}
            for text in _texts(batch.column(0)):
                spans = base_spans(text)
                for offset, region in regions(text, ()):
                    end = offset + len(region.text)
                    inside = [(k, s - offset, e - offset) for k, s, e in spans if offset <= s and e <= end]
                    unsure = any(s < end and e > offset and (s < offset or e > end) for _, s, e in spans)
                    matched = [m.span() for p in (CARD, PHONE, IP) for m in p.finditer(region.text) if sum(map(str.isdigit, m[0])) >= 12]
                    unsure |= any((a, b) not in [(s, e) for _, s, e in inside] for a, b in matched)
                    if not unsure and len(_ATOM.findall(region.text)) <= MAX_ATOMS and len(region.text) <= 8 * MAX_ATOMS:
                        found[region.text] = (region.text, region.cue, region.before, region.after, [k for k, _, _ in inside], [s for _, s, _ in inside], [e for _, _, e in inside])
            if found:
                columns = list(zip(*found.values()))
                yield pa.RecordBatch.from_arrays([
                    pa.array(columns[0], pa.string()), *[pa.array(c, pa.int32()) for c in columns[1:4]], *[pa.array(c, pa.list_(pa.int32())) for c in columns[4:]]],
                    ["text", "cue", "before", "after", "kinds", "starts", "stops"])

    schema = "text string, cue int, before int, after int, kinds array<int>, starts array<int>, stops array<int>"
    seen = rows.mapInArrow(extract, schema)
    rank = [F.xxhash64("text"), *[F.col(c) for c in ("text", "cue", "before", "after", "kinds", "starts", "stops")]]
    one = seen.groupBy("text").agg(F.min_by(F.struct(*seen.columns), F.struct(*rank)).alias("r")).select("r.*").orderBy(*rank).limit(max_regions).collect()
    real = []
    for r in one:
        # Where kinds overlap (a card inside a phone number), one segmentation can hold only one: the first that ends.
        found, last = [], 0
        for kind, start, stop in sorted(zip(r.kinds, r.starts, r.stops), key=lambda x: (x[1], -x[2])):
            if start >= last:
                found.append((kind, start, stop))
                last = stop
        real.append((Region(r.text, r.cue, r.before, r.after), found))
    return learn(real + _made(np.random.default_rng(7)))


_SPANS = ArrayType(StructType([StructField("kind", IntegerType()), StructField("start", LongType()), StructField("stop", LongType())]))


def find(texts: list[str], field: Field) -> list[tuple[list, list]]:
    """(base spans, all spans) of every text, by kind, then start; the regions of all texts are decoded together, each once."""
    base = [base_spans(t) for t in texts]
    places = [regions(t, spans) for t, spans in zip(texts, base)]
    known = decode([r for found in places for _, r in found], field)
    out = []
    for spans, found in zip(base, places):
        added = [(kind, offset + s, offset + e) for offset, region in found for kind, s, e in known[region]]
        out.append((sorted(spans), sorted(set(spans + added))))
    return out


def _listed(rows: list[list[tuple[int, int, int]]]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(r) for r in rows])])
    flat = [x for r in rows for x in r]
    kind, start, stop = (pa.array([x[k] for x in flat], t) for k, t in enumerate((pa.int32(), pa.int64(), pa.int64())))
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.StructArray.from_arrays([kind, start, stop], ["kind", "start", "stop"]))


def scan(docs: DataFrame, field: Field, text_col: str = "text") -> DataFrame:
    """Add base and spans (arrays of kind, start, stop in code points, end exclusive, by kind and start) to every row.

    spans holds the base spans and those the field adds, none of which touches a base span.  Null texts count as empty and have
    none.  Rows are judged one by one, so repeated rows and ids do not matter; own columns named base or spans are replaced.
    Nothing is shuffled.
    """
    carried = [c for c in docs.columns if c not in ("base", "spans")]
    rows = docs.select(*[F.col(f"`{c}`") for c in carried], F.col(f"`{text_col}`").cast("binary").alias("base"))
    schema = rows.drop("base").schema.add("base", _SPANS).add("spans", _SPANS)

    def judge(batches):
        for batch in batches:
            column, start, held = batch.column(len(carried)), 0, 0
            sizes = pa.compute.fill_null(pa.compute.binary_length(column), 0).to_pylist()
            for k, size in enumerate(sizes, 1):
                held += size
                if held >= BATCH_BYTES or k == len(sizes):
                    found = find(_texts(column.slice(start, k - start)), field)
                    part = batch.slice(start, k - start)
                    yield pa.RecordBatch.from_arrays([*part.columns[:len(carried)], _listed([b for b, _ in found]), _listed([s for _, s in found])], schema.names)
                    start, held = k, 0

    return rows.mapInArrow(judge, schema)


def _joined(spans: Column) -> Column:
    names = F.array(*[F.lit(k) for k in KINDS])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", F.element_at(names, s["kind"] + 1), s["start"].cast("string"), s["stop"].cast("string"))), ",")


def digest(scanned: DataFrame, id_col: str = "doc_id") -> DataFrame:
    """Base spans per kind, the hash of the base spans and all spans as text."""
    def count(kind: int) -> Column:
        return F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")

    counts = [count(k).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    return scanned.select(F.col(f"`{id_col}`"), *counts, F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.col("spans")).alias("spans"))
