"""Problem 4: personal information inside free text, replaced by typed placeholders.

A semi-Markov conditional random field. A text is cut into segments: single tokens of no type, and spans of the types
email, phone, id_number, address and name of bounded length. A span is scored as a whole by a log-linear model over
features of its form, its words and what stands before and after it. Decoding is dynamic programming over token
positions, which chooses boundaries and types jointly; learning maximises the likelihood of labelled texts with the
forward-backward sums over the same segments.

Labels are distant and come from the table alone. The template records among the texts name their own fields, so their
values are labelled spans; a first field is fitted on these, without any word of context. It labels the free notes of
the sample, from which a field with context is fitted, and so on for ROUNDS rounds (expectation and maximisation with
the best segmentation). No sentence, name or host is written down here. The fields are fitted on at most FIT_TEXTS texts; every
text is decoded whole.
"""

from __future__ import annotations

import json
import math
import random
import re
from bisect import bisect_left, bisect_right
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

TYPES = ("email", "phone", "id_number", "address", "name")
PLACEHOLDER = {"email": "[EMAIL]", "phone": "[PHONE]", "id_number": "[ID_NUMBER]", "address": "[ADDRESS]", "name": "[NAME]"}
#: Texts that the field is fitted on at most, rounds of labelling the notes among them, passes of a fit, and its step.
FIT_TEXTS, ROUNDS, EPOCHS, RATE = 2000, 2, 3, 0.25
#: Longest spans in tokens.
NAME_WORDS, ADDRESS_TOKENS, NUMBER_TOKENS = 5, 48, 9
#: Texts in which a word must stand, outside of all names and addresses of records, to be an ordinary word of notes.
ORDINARY = 3

_TOKEN = re.compile(r"[^\W\d_]+|\d+|[^\w\s]|_", re.UNICODE)
# Public formats of e-mail addresses, phone numbers, PAN, Aadhaar and passport numbers.
_EMAIL = re.compile(
    r"[A-Za-z0-9][\w.+-]*\s?(?:@|\(at\)|\[at\]|\sat\s)\s?[A-Za-z0-9][A-Za-z0-9-]*(?:(?:\.|\sdot\s|\s?\(dot\)\s?|\s?\[dot\]\s?)[A-Za-z]{2,}[A-Za-z0-9-]*)+", re.IGNORECASE
)
_PHONE = re.compile(r"(?<![\w.])(?:(?:\+|00)\s?91[\s.-]?|0)?[6-9]\d{2,4}[\s.-]?\d{2,4}[\s.-]?\d{3,6}(?!\w)|(?<!\w)\(?0\d{2,4}\)?[\s.-]\d{5,8}(?!\w)|(?<!\w)\(0\d{2,4}\)\s?\d{5,8}(?!\w)")
_PAN = re.compile(r"(?<![\w])[A-Za-z]{5}[\s-]?\d{4}[\s-]?[A-Za-z](?!\w)")
_AADHAAR = re.compile(r"(?<![\w-])\d{4}[\s-]?\d{4}[\s-]?\d{4}(?![\w-])")
_PASSPORT = re.compile(r"(?<!\w)[A-Za-z]\s?\d{7}(?!\w)")
_FORMATS = (("email", _EMAIL, "email"), ("phone", _PHONE, "phone"), ("id_number", _PAN, "pan"), ("id_number", _AADHAAR, "aadhaar"), ("id_number", _PASSPORT, "passport"))
#: What a public format says before anything is learnt; types that no record has (e-mail addresses, passports) start from it.
_PRIOR = {"email|mark=@": 12.0, "email|mark=(at": 12.0, "email|mark=[at": 12.0, "email|domain=True": 6.0, "email|format": 2.0, "phone|format": 2.0, "id_number|format": 2.0} | {f"{kind}|no format": -2.0 for kind in ("email", "phone", "id_number")}
#: A mailbox or a number as it may be written outside of these formats.
_MAILISH = re.compile(r"[^\s@,;<>()\"']+\s?@\s?[^\s@,;<>()\"']+[^\W_]")
_NUMBERISH = re.compile(r"(?<![^\W_])[+(]?[A-Za-z]{0,5}\d[\d\s()./+-]{5,18}\d[A-Za-z]?(?![^\W_])")
#: Common and reserved top-level domains.
_DOMAINS = frozenset("com org net edu gov info biz in co io test example invalid".split())
_DATE = re.compile(r"\d{1,4}[./-]\d{1,2}[./-]\d{2,4}(?!\d)")
_TITLES = frozenset("mr mrs ms smt shri sri dr kum km prof ji".split())
_HOUSE = frozenset("flat flt unit apt f h d no house door plot block blk".split())
_ROAD = frozenset("road rd rood street str st lane ln avenue ave av marg mg cross crs main mn path bazaar bazar".split())


#: Classes of words that an address counts.
_COUNTED = {"num": ("num",), "known": ("address", "partly"), "other": ("name", "other"), "unknown": ("unknown", "halfname", "namelike")}
#: Bits of these counts and of those of roads and houses.
_BITS = np.arange(len(_COUNTED) + 2)


class Lexicon:
    """Which words occur in names, in addresses and elsewhere in the labelled texts, and which begin addresses."""

    def __init__(self) -> None:
        self.name: dict[str, int] = defaultdict(int)
        self.address: dict[str, int] = defaultdict(int)
        self.other: dict[str, int] = defaultdict(int)
        self.starts: dict[str, int] = defaultdict(int)

    def freeze(self) -> Lexicon:
        self.name, self.address, self.other, self.starts = dict(self.name), dict(self.address), dict(self.other), dict(self.starts)
        self.heads = {w[:4] for w in self.name if len(w) >= 5}
        tails: dict[str, int] = defaultdict(int)
        for w in self.name:
            if len(w) >= 6:
                tails[w[-4:]] += 1
                tails[w[-3:]] += 1
        self.tails = {t for t, n in tails.items() if n >= 3}
        self.known: dict[str, tuple] = {}
        return self

    def read(self, w: str) -> tuple[str, str, bool, bool | None, int]:
        """Of a token: lower case, class, whether it may be of a name and of an address (None: if such words stand near), and what it counts as in an address."""
        if w not in self.known:
            if len(self.known) > 200_000:
                self.known.clear()
            low = w.lower()
            c = self.looks(low) if w[0].isalpha() else "num" if w[0].isdigit() else "punct"
            namey = w[0].isalpha() and w.isascii() and not (low in _TITLES and len(w) > 1) and (c in ("name", "namelike", "halfname") or w[0].isupper() and c != "other" or len(w) == 1)
            place: bool | None
            if c in ("address", "num") or low in _HOUSE or low in _ROAD:
                place = True
            elif c == "partly" or c == "unknown" and w.islower():
                place = None
            else:
                place = low in ",.#/-:&()\\" if c == "punct" else c in ("unknown", "halfname", "namelike")
            counted = [c in v for v in _COUNTED.values()] + [low in _ROAD, low in _HOUSE or low == "#"]
            self.known[w] = low, c, namey, place, sum(1 << i for i, x in enumerate(counted) if x)
        return self.known[w]

    def looks(self, low: str) -> str:
        """A coarse class of a word: name, address, other, or what its parts suggest."""
        n, a, o = self.name.get(low, 0), self.address.get(low, 0), self.other.get(low, 0)
        if o < 3 and not n and not a and len(low) >= 5 and low[:4] in self.heads and (low[-4:] in self.tails or low[-3:] in self.tails):
            return "namelike"  # seen once or twice outside of names proves nothing
        if n or a or o:
            if a >= 3 and a < max(n, o):
                return "partly"  # a word of addresses that other texts use more
            return "name" if n >= a and n >= o else "address" if a >= o else "other"
        if len(low) >= 5 and (low[:4] in self.heads) + (low[-4:] in self.tails or low[-3:] in self.tails) >= 2:
            return "namelike"
        if len(low) >= 5 and (low[:4] in self.heads or low[-4:] in self.tails):
            return "halfname"
        return "unknown"


def _tokens(text: str) -> tuple[list[str], list[int], list[int]]:
    words, starts, ends = [], [], []
    for m in _TOKEN.finditer(text):
        words.append(m[0])
        starts.append(m.start())
        ends.append(m.end())
    return words, starts, ends


def _shape(w: str) -> str:
    if w[0].isdigit():
        return f"d{min(len(w), 7)}"
    if not w[0].isalpha():
        return w
    if len(w) == 1:
        return "I" if w.isupper() else "i"
    return "A" if w.isupper() else "T" if w[0].isupper() else "a"


class Lattice:
    """A text's tokens and the spans that may be segments, with their features."""

    def __init__(self, text: str, lex: Lexicon) -> None:
        self.text = text
        self.words, self.starts, self.ends = _tokens(text)
        self.n = len(self.words)
        self.lex = lex
        seen = [lex.read(w) for w in self.words]
        self.low, self.cls, self.namey, place, codes = map(list, zip(*seen)) if seen else ([], [], [], [], [])
        #: Whether a token begins a line; what may be of an address; sums up to each token of what addresses count.
        self.fresh = [True] + ["\n" in text[a:b] for a, b in zip(self.ends, self.starts[1:])]
        self.placey = [self._near(i) if p is None else p for i, p in enumerate(place)]
        self.sums = [[0] * len(_BITS)] + np.cumsum((np.array(codes, dtype=np.int64)[:, None] >> _BITS) & 1, axis=0).tolist()
        self.into: list[list[tuple[int, str, tuple]]] = [[] for _ in range(self.n + 1)]
        self._patterns()
        self._names()
        self._addresses()

    def add(self, a: int, b: int, kind: str, form: tuple) -> None:
        """A segment of tokens a..b-1 with what its form's features are made of, see `features`; those of its context are shared by all that begin or end there."""
        self.into[b].append((a, kind, form))

    def before(self, a: int) -> tuple[str, ...]:
        """What stands before a segment that begins at a."""
        if not a:
            return ("p1=^", "line=True")
        gap = self.fresh[a]
        return (f"p1={self.low[a - 1]}", f"p2={self.low[a - 2] if a > 1 else '^'} {self.low[a - 1]}", f"pc={self.cls[a - 1]}", f"line={gap}")

    def after(self, b: int) -> tuple[str, ...]:
        """What stands after a segment that ends before b."""
        return (f"n1={self.low[b]}", f"nc={self.cls[b]}") if b < self.n else ("n1=$",)

    def _patterns(self) -> None:
        seen = set()
        for kind, pattern, tag in _FORMATS:
            for m in pattern.finditer(self.text):
                self._shaped(m, kind, ["format", tag], seen)
        for kinds, pattern in ((("email",), _MAILISH), (("phone", "id_number"), _NUMBERISH)):
            for m in pattern.finditer(self.text):
                for kind in kinds:
                    self._shaped(m, kind, ["no format"], seen)

    def _shaped(self, m: re.Match, kind: str, form: list[str], seen: set) -> None:
        a, b = bisect_left(self.starts, m.start()), bisect_left(self.ends, m.end()) + 1
        if a < self.n and b <= self.n and self.starts[a] == m.start() and self.ends[b - 1] == m.end() and (a, b, kind) not in seen:
            seen.add((a, b, kind))
            digits = sum(c.isdigit() for c in m[0])
            if kind == "email":
                mark = "@" if "@" in m[0] else re.search(r"[(\[]?\bat\b", m[0].lower())[0]
                self.add(a, b, kind, (*form, f"mark={mark}", f"spelled dot={'dot' in self.low[a:b]}", f"domain={self.low[b - 1] in _DOMAINS}"))
            else:
                shape = re.sub(r"[0-9]+", lambda d: str(len(d[0])), re.sub(r"[A-Za-z]+", "A", m[0]))[:16]
                self.add(a, b, kind, (*form, f"{form[-1]} digits={digits}", f"{form[-1]} shape={shape}"))

    def _names(self) -> None:
        i = 0
        while i < self.n:
            if not self.namey[i]:
                i += 1
                continue
            parts, j, comma = [], i, False
            while j < self.n and len(parts) < NAME_WORDS and self.namey[j]:
                parts.append(j)
                self._name(i, j + 1, parts, comma)
                k = j + 1
                if k < self.n and self.low[k] == "." and self.starts[k] == self.ends[j]:
                    if len(self.words[j]) == 1 or k + 1 < self.n and self.starts[k + 1] == self.ends[k]:
                        self._name(i, k + 1, parts, comma) if len(self.words[j]) == 1 else None
                    else:
                        break
                    k += 1
                if k < self.n and self.low[k] == "," and not comma and "\n" not in self.text[self.ends[k] : self.starts[k + 1] if k + 1 < self.n else self.ends[k]]:
                    comma = True
                    k += 1
                if k < self.n and "\n" in self.text[self.ends[j] : self.starts[k]]:
                    break
                j = k
            i += 1

    def _name(self, a: int, b: int, parts: list[int], comma: bool) -> None:
        words, cls = self.words, self.cls
        long = [cls[p] for p in parts if len(words[p]) > 2]
        if not long:
            return
        part = lambda p: cls[p] if len(words[p]) > 1 else "initial"
        goes = part(b) if b < self.n and self.namey[b] and not self.fresh[b] else None
        back = part(a - 1) if a and self.namey[a - 1] and not self.fresh[a] else None
        low = sum(words[p][0].islower() for p in parts)
        self.add(a, b, "name", ("".join([_shape(words[p]) for p in parts]), len(parts), comma, part(parts[0]), part(parts[-1]), tuple(long), low, goes, back))

    def _near(self, i: int) -> bool:
        return any(0 <= k < self.n and (self.cls[k] in ("address", "num")) for k in (i - 1, i + 1, i - 2, i + 2))

    def _addresses(self) -> None:
        i = 0
        while i < self.n:
            if not self.placey[i] or self.low[i] in ",./-:&()":
                i += 1
                continue
            j = i
            while j < self.n and self.placey[j]:
                j += 1
            # Starts: where a part may begin. Ends: after words and numbers. All of the run, only the span's length is bounded.
            begins = [k for k in range(i, j) if self.low[k] == "#" or self.cls[k] != "punct" and (k == i or self._edge(k)) and (self.cls[k] != "partly" or self.lex.starts.get(self.low[k]))]
            ends = [k for k in range(i + 1, j + 1) if self.cls[k - 1] != "punct" or self.low[k - 1] == "." and k - 1 > i]
            ends = [k for k in ends if k == j or k == ends[-1] or self._stop(k)]
            for a in begins:
                for b in ends[bisect_left(ends, a + 3) : bisect_right(ends, a + ADDRESS_TOKENS)]:
                    self._address(a, b)
            i = j if j > i else i + 1

    def _edge(self, k: int) -> bool:
        """A part may begin after punctuation, a line's end or a word that is none of an address."""
        return self.cls[k - 1] == "punct" or self.fresh[k] or self.cls[k - 1] not in ("address", "num") or self.low[k] in _HOUSE or self.cls[k] == "num"

    def _stop(self, k: int) -> bool:
        if k >= self.n:
            return True
        dash = self.low[k] in "-–—" and self.starts[k] > self.ends[k - 1] and k + 1 < self.n and self.starts[k + 1] > self.ends[k]
        return dash or self.low[k] in ".;" or self.fresh[k] or self.cls[k - 1] == "num" and len(self.low[k - 1]) in (3, 6)

    def _address(self, a: int, b: int) -> None:
        nums, known, other, unknown, road, house = (y - x for x, y in zip(self.sums[a], self.sums[b]))
        if not nums or not known:
            return
        cls, low = self.cls, self.low
        end = cls[b - 1]
        pin = end == "num" and (len(low[b - 1]) == 6 or b - a > 2 and cls[b - 2] == "num" and len(low[b - 1]) == len(low[b - 2]) == 3)
        self.add(a, b, "address", (
            min(known, 8), min(nums, 5), min(unknown, 5), min(other, 3), low[a] if cls[a] in ("address", "punct") or low[a] in _HOUSE else cls[a],
            f"{end}{len(low[b - 1])}" if end == "num" else end, self.lex.starts.get(low[a], 0) >= 3 or cls[a], road > 0, house > 0, min((b - a) // 4, 9), pin, self._beyond(b, 1), self._beyond(a - 1, -1),
        ))

    def _beyond(self, k: int, step: int) -> str:
        """The class of the next word on the line, from token k on, if it may be of an address: a span should not stop short of it."""
        while 0 <= k < self.n and self.cls[k] == "punct" and self.low[k] in ",./-–—:#()":
            k += step
        if not 0 <= k < self.n or (k > 0 and self.fresh[k] if step > 0 else k + 1 < self.n and self.fresh[k + 1]):
            return "nothing"
        return self.cls[k] if self.cls[k] != "punct" and self.placey[k] else "nothing"


def features(kind: str, form: tuple) -> list[str]:
    """The features of a segment's form by name."""
    if kind == "name":
        shapes, n, comma, first, last, long, low, goes, back = form
        out = [f"name shape={shapes}", f"name n={n} long={len(long)} comma={comma}", f"name first={first}", f"name last={last}", *[f"name {c}={k}" for c, k in Counter(long).items()], f"name low={low}"]
        return out + ([f"name goes on={goes}"] if goes else []) + ([f"name before={back}"] if back else [])
    if kind == "address":
        known, nums, unknown, other, start, end, seen, road, house, size, pin, goes, back = form
        out = [f"addr known={known}", f"addr nums={nums}", f"addr unknown={unknown}", f"addr other={other}", f"addr start={start}", f"addr end={end}", f"addr start seen={seen}", f"addr road={road}", f"addr house={house}", f"addr len={size}"]
        return out + (["addr pin at end"] if pin else []) + [f"addr goes on={goes}", f"addr before={back}"]
    return list(form)


class Weights:
    """Weights of features, named "type|feature", with the sums that decoding asks for again and again."""

    def __init__(self, values: dict[str, float], context: bool) -> None:
        self.values, self.context = values, context
        self.sums: dict[tuple, float] = {}

    def of(self, kind: str, form: tuple, context: bool = False) -> float:
        """The sum for a segment's form or, already named, for its context."""
        key = (kind, context, form)
        s = self.sums.get(key)
        if s is None:
            if len(self.sums) > 300_000:
                self.sums.clear()
            get = self.values.get
            s = self.sums[key] = sum(get(f"{kind}|{f}", 0.0) for f in (form if context else features(kind, form)))
        return s


def decode(x: Lattice, weights: Weights) -> list[tuple[int, int, str]]:
    """The best segmentation as (first token, end token, type)."""
    best = [0.0] * (x.n + 1)
    back: list[tuple[int, str] | None] = [None] * (x.n + 1)
    of, left = weights.of, {}
    bias = {k: weights.values.get(f"{k}|bias", 0.0) for k in TYPES}
    for b in range(1, x.n + 1):
        top, arg = best[b - 1], None
        right: dict[str, float] = {}
        for a, kind, form in x.into[b]:
            s = best[a] + bias[kind] + of(kind, form)
            if weights.context:
                if (a, kind) not in left:
                    left[a, kind] = of(kind, x.before(a), True)
                if kind not in right:
                    right[kind] = of(kind, x.after(b), True)
                s += left[a, kind] + right[kind]
            if s > top:
                top, arg = s, (a, kind)
        best[b], back[b] = top, arg
    out, b = [], x.n
    while b > 0:
        if back[b] is None:
            b -= 1
        else:
            a, kind = back[b]
            out.append((a, b, kind))
            b = a
    return out[::-1]


def _logsum(xs: list[float]) -> float:
    top = max(xs)
    return top + math.log(sum(math.exp(x - top) for x in xs)) if len(xs) > 1 else top


class Learner:
    """Stochastic gradient ascent of the log likelihood, with rates that adapt to each weight. Features are numbered once."""

    def __init__(self, context: bool) -> None:
        self.context, self.number = context, {}
        self.w: list[float] = []
        self.g2: list[float] = []
        for name in _PRIOR:
            self._id(name)

    def prepared(self, x: Lattice, gold: set[tuple[int, int, str]]) -> tuple[int, list[tuple[int, int, list[int], bool]]]:
        """(tokens, segments) of a text: begin, end, feature numbers and whether it is a labelled one."""
        out = []
        for b in range(1, x.n + 1):
            for a, kind, form in x.into[b]:
                names = ("bias", *features(kind, form), *x.before(a), *x.after(b)) if self.context else ("bias", *features(kind, form))
                out.append((a, b, [self._id(f"{kind}|{f}") for f in names], (a, b, kind) in gold))
        return x.n, out

    def _id(self, name: str) -> int:
        i = self.number.get(name)
        if i is None:
            i = self.number[name] = len(self.w)
            self.w.append(_PRIOR.get(name, 0.0))
            self.g2.append(0.0)
        return i

    def marginals(self, n: int, segments: list[tuple[int, int, list[int], bool]]) -> tuple[float, list[float]]:
        """The logarithm of the sum over all segmentations, and the probability of each segment, by forward and backward sums."""
        w = self.w
        scores = [sum([w[i] for i in ids]) for _, _, ids, _ in segments]
        ends: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        begins: list[list[tuple[int, float]]] = [[] for _ in range(n + 1)]
        for (a, b, _, _), s in zip(segments, scores):
            ends[b].append((a, s))
            begins[a].append((b, s))
        ahead, after = [0.0] * (n + 1), [0.0] * (n + 1)
        for b in range(1, n + 1):
            ahead[b] = _logsum([ahead[b - 1], *[ahead[a] + s for a, s in ends[b]]]) if ends[b] else ahead[b - 1]
        for a in range(n - 1, -1, -1):
            after[a] = _logsum([after[a + 1], *[after[b] + s for b, s in begins[a]]]) if begins[a] else after[a + 1]
        total = ahead[n]
        return total, [math.exp(min(0.0, ahead[a] + s + after[b] - total)) for (a, b, _, _), s in zip(segments, scores)]

    def step(self, n: int, segments: list[tuple[int, int, list[int], bool]], rate: float) -> None:
        grad: dict[int, float] = defaultdict(float)
        for (_, _, ids, labelled), p in zip(segments, self.marginals(n, segments)[1]):
            g = labelled - p
            if abs(g) > 1e-3:
                for i in ids:
                    grad[i] += g
        w, g2 = self.w, self.g2
        for i, g in grad.items():
            g2[i] += g * g
            w[i] = w[i] * 0.9999 + rate * g / math.sqrt(g2[i] + 1e-6)

    def weights(self) -> Weights:
        return Weights({k: round(self.w[i], 4) for k, i in self.number.items() if abs(self.w[i]) > 0.01}, self.context)


# --- distant labels -----------------------------------------------------------------------------------------------------

#: Fields of template records and what their values are.
_FIELDS = {"applicant_name": "name", "fathers_name": "name", "address": "address", "current_address": "address", "mobile_no": "phone", "pan_number": "id_number", "aadhaar_number": "id_number"}
_TITLE = re.compile(r"^(?:(?:mrs?|ms|m/s|smt|shri|sri|dr|kum)\b\.?\s*)+", re.IGNORECASE)

Spans = list[tuple[int, int, str]]


def record_spans(text: str) -> tuple[Spans, int] | None:
    """The labelled spans of a template record and where its free part begins; None for a text that is none."""
    if not text.lstrip().startswith("{"):
        return None
    try:
        record = json.loads(text)
    except ValueError:
        return None
    if not isinstance(record, dict):
        return None
    spans, cut = [], len(text)
    for field, v in record.items():
        if field not in _FIELDS and isinstance(v, str) and len(v) > 40:
            at = text.find(json.dumps(v, ensure_ascii=False))
            cut = min(cut, at) if at >= 0 else cut
    for field, kind in _FIELDS.items():
        v = record.get(field)
        if not isinstance(v, str) or not v.strip() or kind == "id_number" and re.search(r"[Xx*]{3}", v):
            continue
        key = text.find(f'"{field}"')
        at = text.find(v, key + len(field) + 2) if key >= 0 else -1
        if 0 <= at < cut:
            title = _TITLE.match(v) if kind == "name" else None
            spans.append((at + (len(title[0]) if title else 0), at + len(v), kind))
    return spans, cut


def sampled(texts: list[str]) -> tuple[list[tuple[str, Spans]], list[str]]:
    """Records without their free parts, labelled, and the free parts and notes, unlabelled."""
    records, notes = [], []
    for t in texts:
        found = record_spans(t)
        if found is None:
            notes.append(t)
            continue
        spans, cut = found
        records.append((t[:cut], spans))
        if cut < len(t):
            notes.append(t[cut:])
    return records, notes


_WORD = re.compile(r"[^\W\d_]{2,}", re.UNICODE)


def lexicon(labelled: list[tuple[str, Spans]], notes: list[str]) -> Lexicon:
    """Words by where they stand in labelled texts; words of unlabelled notes are ordinary if they recur and stand in no name or address."""
    lex = Lexicon()
    for text, spans in labelled:
        inside = [0] * (len(text) + 1)
        for a, b, kind in spans:
            if kind == "address" and (first := _TOKEN.match(text, a)):
                lex.starts[first[0].lower()] += 1
            inside[a:b] = [1 if kind == "name" else 2 if kind == "address" else 3] * (b - a)
        for m in _WORD.finditer(text):
            at = inside[m.start()]
            if at < 3:
                (lex.other, lex.name, lex.address)[at][m[0].lower()] += 1
    # A word seen once in a name or an address is as well a slip as a word: the model must learn to do without.
    seen = dict(lex.address)
    lex.name = {w: n for w, n in lex.name.items() if n >= 2}
    lex.address = {w: n for w, n in lex.address.items() if n >= 3}
    lex.freeze()
    for w, n in Counter(w for t in notes for w in {m[0].lower() for m in _WORD.finditer(t)}).items():
        # What is made of the parts of names is taken for one that no record has; a word of addresses must be far more frequent.
        if n >= ORDINARY and w not in lex.name and n > 4 * seen.get(w, 0) and w[:4] not in lex.heads:
            lex.other[w] = lex.other.get(w, 0) + n
    return lex


def voted(labelled: list[tuple[str, Spans]]) -> list[tuple[str, Spans]]:
    """Labels of numbers without those whose word before says another kind: most numbers after it are in no public format."""
    last = re.compile(r"([^\W\d_]+)\W{0,3}$", re.UNICODE)
    before = lambda t, at: m[1].lower() if (m := last.search(t, max(0, at - 24), at)) else ""
    all_after, taken = Counter(), Counter()
    for t, spans in labelled:
        numbers = {a: b for a, b, kind in spans if kind in ("phone", "id_number")}
        taken.update(before(t, a) for a in numbers)
        all_after.update(before(t, a) for a in numbers.keys() | {m.start() for m in _NUMBERISH.finditer(t) if not _DATE.match(m[0])})
    other = {w for w, n in all_after.items() if w and n >= ORDINARY and taken[w] < 0.6 * n}
    return [(t, [x for x in spans if x[2] not in ("phone", "id_number") or before(t, x[0]) not in other]) for t, spans in labelled]


class Model:
    """A fitted field: weights and lexicon."""

    def __init__(self, weights: Weights, lexicon: Lexicon) -> None:
        self.weights, self.lexicon = weights, lexicon

    def spans(self, text: str | None) -> Spans:
        """(start, end, type) of personal information, 0-based, in order and disjoint."""
        if not text or not text.strip():
            return []
        x = Lattice(text, self.lexicon)
        return [(x.starts[a], x.ends[b - 1], kind) for a, b, kind in decode(x, self.weights)]


def _gold(x: Lattice, spans: Spans) -> set[tuple[int, int, str]]:
    gold = set()
    for a, b, kind in spans:
        i, j = bisect_left(x.starts, a), bisect_left(x.ends, b) + 1
        if kind == "name" or kind == "address":  # closing punctuation is no part of a segment
            fits = [(p, q) for q in range(max(0, j - 2), min(x.n, j + 1) + 1) for p, k, _ in x.into[q] if k == kind and p == i]
            if fits:
                i, j = min(fits, key=lambda f: abs(f[1] - j))
        gold.add((i, j, kind))
    return gold


def _fit(labelled: list[tuple[str, Spans]], lex: Lexicon, context: bool, epochs: int, seed: int) -> Model:
    learner, rng = Learner(context), random.Random(seed)
    ready = []
    for text, spans in labelled:
        x = Lattice(text, lex)
        ready.append(learner.prepared(x, _gold(x, spans)))
    for epoch in range(epochs):
        rng.shuffle(ready)
        for n, segments in ready:
            learner.step(n, segments, RATE / (1 + 0.3 * epoch))
    return Model(learner.weights(), lex)


def fit(texts: list[str], epochs: int = EPOCHS, rounds: int = ROUNDS, seed: int = 5) -> Model:
    """The field of a sample of texts: records label themselves, notes are labelled by the round before."""
    records, notes = sampled(texts)
    model = _fit(records, lexicon(records, notes), False, epochs, seed)
    for _ in range(rounds):
        labelled = records + voted([(t, model.spans(t)) for t in notes])
        model = _fit(labelled, lexicon(labelled, []), True, epochs, seed)
    return model


def fitted(rows: DataFrame, key: str = "extraction_id", text: str = "_formatted_text") -> Model:
    """The model of a table: fitted on at most FIT_TEXTS of its texts, taken by a hash of the key."""
    # Thinned by a hash first, so that what all tasks together hand over stays near the bound.
    every = max(1, rows.count() // (4 * FIT_TEXTS))
    thin = rows.where((F.pmod(F.xxhash64(key), F.lit(every)) == 0) & F.col(text).isNotNull())
    return fit(thin.select(key, text).orderBy(F.xxhash64(key), key).limit(FIT_TEXTS).toPandas()[text].tolist())


def find(rows: DataFrame, model: Model, key: str = "extraction_id", text: str = "_formatted_text") -> DataFrame:
    """(key, redacted, spans): each text with a typed placeholder in place of each piece of personal information.

    spans: array of struct pii_type, start_pos (1-based), length. A null text stays null, an empty one empty, both
    without spans; repeated rows are treated alike; extra columns are ignored. Texts are decoded whole.
    """
    model.lexicon.known = {}
    shared = rows.sparkSession.sparkContext.broadcast((model.weights.values, model.weights.context, model.lexicon))
    kind = rows.schema[key].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        values, context, words = shared.value
        own = Model(Weights(values, context), words)
        for pdf in batches:
            known: dict[str, tuple[str, list]] = {}
            out = []
            for k, t in zip(pdf[key], pdf[text]):
                if not isinstance(t, str):
                    out.append((k, None, []))
                    continue
                if t not in known:
                    spans = own.spans(t)
                    clean, last = [], 0
                    for a, b, c in spans:
                        clean += [t[last:a], PLACEHOLDER[c]]
                        last = b
                    known[t] = "".join([*clean, t[last:]]), [(c, a + 1, b - a) for a, b, c in spans]
                out.append((k, *known[t]))
            yield pd.DataFrame(out, columns=[key, "redacted", "spans"])

    return rows.select(key, text).mapInPandas(run, f"{key} {kind}, redacted string, spans array<struct<pii_type:string,start_pos:bigint,length:int>>")


def occurrences(found: DataFrame, key: str = "extraction_id") -> DataFrame:
    """(key, pii_type, start_pos) of each occurrence."""
    return found.select(key, F.explode("spans").alias("x")).select(key, "x.pii_type", "x.start_pos")
