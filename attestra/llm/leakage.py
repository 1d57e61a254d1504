"""Problem 8: passages of held-out evaluation items inside corpus documents.

Template canonicalisation. A text becomes a sequence of words and, beside it, of template tokens: numbers, units and
names have a typed placeholder each, the ordinary words of the evaluation items stand for themselves. A word that is none of
these (a name that no item has, a misread word) counts as a name.
Windows of WINDOW template tokens are hashed, and the documents' windows meet the items' windows in a hash join.
What meets is checked slot by slot along its diagonal:

* literal: the words taken over are followed in both directions, where a single altered, misread, split, lost or added
  word and a page heading do not end the stretch. Only words that agree count, so another text of the same template is none.
* re-parameterised: LEAST or more template tokens agree in one piece, some slots hold other values, and the slots are
  consistent: one value of the item always became the same value of the document, and different ones different values.

The join has two ways. Items of up to ITEM_BYTES are handed to every task and the documents are streamed past them once.
Larger sets stay distributed: documents keep what passes a bitmap of the items' windows, of a fixed size, and the rest is joined by hash.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from operator import eq

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.session import checkpointed

#: Template tokens of a hashed window; fewest of them that are no placeholders; words (or template tokens) a stretch must take over.
WINDOW, SOLID, LEAST = 5, 2, 18
#: Template tokens of numbers, of units and of names and words that are none of the template's; all others are larger.
NUMBER, UNIT, NAME = 1, 2, 3
#: Units and currencies.
UNITS = frozenset(
    "rupees rupee rs inr paise lakh lakhs crore crores dollar dollars euro euros percent percentage bps day days week weeks fortnight fortnights month months quarter quarters "
    "year years hour hours minute minutes kg kgs kilogram kilograms gram grams quintal quintals tonne tonnes km kms kilometre kilometres metre metres acre acres hectare hectares litre litres".split()
)
#: A stretch is followed from pieces of it: two or more windows on one diagonal with PIECE equal words, single words between them aside.
#: The pieces of all diagonals within REACH must hold ENOUGH words: about half of LEAST, as what lies on a diagonal with a single window is not counted.
PIECE, REACH, ENOUGH = 5, 20, 10
#: Bytes of passages up to which items are handed to every task; bits of the bitmaps of words and of windows.
ITEM_BYTES, WORD_BITS, WINDOW_BITS = 32 << 20, 20, 22
#: Words that a page heading or other inserted line may have within a stretch.
HEADING = 12

_BREAK = re.compile(r"(?<=[^\W\d_])-[ \t]*\n\s*(?=[^\W\d_])")
#: Letters as they are, apostrophes and soft hyphens away, all other ASCII characters to blanks.
_ASCII = {i: chr(i).lower() if chr(i).isalnum() else " " for i in range(128)} | {ord("'"): ""}
_THOUSANDS = re.compile(r"(?<=\d),(?=\d)")
_APART = re.compile(r"[^\w\s]|_", re.UNICODE)
_COMPATIBLE = re.compile(r"[\u0080-\u024f\u2000-\u206f\ufb00-\uffef]")
_JOINERS = dict.fromkeys(map(ord, "\u00ad\u200b\u200c\u200d\u2060\ufeff\u2019\u2018'"), None)
_FOREIGN = re.compile(r"[^\x00-\x7f]+(?:\s+[^\x00-\x7f]+)*")


def words(text: str | None, latin: bool = False) -> list[str]:
    """Lower-case words and numbers of a text; a word broken by a hyphen at a line's end is one word.

    latin: stretches in other scripts may count as one word, which is all that items in Latin script need of them.
    """
    if not text:
        return []
    if not text.isascii():
        if _COMPATIBLE.search(text):
            text = unicodedata.normalize("NFKC", text.translate(_JOINERS))
        text = _FOREIGN.sub(" 0foreign ", text) if latin else text
    if "-" in text:
        text = _BREAK.sub("", text)
    if "," in text:
        text = _THOUSANDS.sub("", text)
    if text.isascii():
        return text.translate(_ASCII).split()
    return _APART.sub(" ", text.lower()).split()


class Vocabulary(dict):
    """The template token of a word, from a bitmap of the items' ordinary words."""

    def __init__(self, bits: np.ndarray) -> None:
        self.bits = bits

    def __missing__(self, w: str) -> int:
        if len(self) > 500_000:
            self.clear()
        h = xxhash.xxh64_intdigest(w)
        if w[0].isdigit():
            code = NUMBER
        elif w in UNITS:
            code = UNIT
        else:
            code = (h >> 2) | 8 if self.bits[h & ((1 << WORD_BITS) - 1)] else NAME
        self[w] = code
        return code


_LETTERS = re.compile(r"[^\W\d_]+", re.UNICODE)


def ordinary(passages: list[str | None]) -> Counter:
    """How the words of passages speak for or against being ordinary ones: (word, "lower", "upper" or "head") -> times.

    A name is written with a capital throughout and no sentence starts with it; the rest is the template's vocabulary.
    """
    seen: Counter = Counter()
    for p in passages:
        seen.update((w.lower(), "lower" if w[0].islower() else "upper") for w in _LETTERS.findall(p or ""))
        seen.update((m[1].lower(), "head") for s in re.split(r"(?<=[.!?])\s+", p or "") if (m := re.match(r"\W*([^\W\d_]+)", s, re.UNICODE)))
    return seen


def is_ordinary(word: str, lower: int, head: int) -> bool:
    return lower > 0 and len(word) > 1 or head > 0


def word_bits(words_in: list[str]) -> np.ndarray:
    bits = np.zeros(1 << WORD_BITS, dtype=bool)
    for w in words_in:
        bits[xxhash.xxh64_intdigest(w) & ((1 << WORD_BITS) - 1)] = True
    return bits


def windows(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes and positions of the template windows with enough words that are no placeholders."""
    n = len(code) - WINDOW + 1
    if n <= 0:
        return np.empty(0, np.int64), np.empty(0, np.int64)
    h, solid = np.zeros(n, dtype=np.int64), np.zeros(n, dtype=np.int8)
    with np.errstate(over="ignore"):
        for i in range(WINDOW):
            c = code[i : i + n]
            h = h * np.int64(1_000_003) + (c ^ (c >> np.int64(21)))
            solid += c > NAME
        h ^= h >> np.int64(29)
    pos = np.flatnonzero(solid >= SOLID)
    return h[pos], pos


class Index:
    """The built side of the join: template windows of items, with their words for the check of slots."""

    def __init__(self, ids: list[int], passages: list[str | None], bits: np.ndarray | None = None) -> None:
        self.ids = ids
        if bits is None:
            seen = ordinary(passages)
            bits = word_bits([w for w in {w for w, _ in seen} if is_ordinary(w, seen[w, "lower"], seen[w, "head"])])
        self.codes = Vocabulary(bits)
        self.items = [words(p) for p in passages]
        self.latin = all(w.isascii() for item in self.items for w in item)
        self.backwards = [item[::-1] for item in self.items]
        self.number = {w: i for i, w in enumerate({w for item in self.items for w in item}, 1)}
        codes = [self.coded(item) for item in self.items]
        self.start = np.cumsum([0] + [len(c) for c in codes])
        self.code = np.concatenate(codes) if codes else np.empty(0, np.int64)
        self.word = np.array([self.number[w] for item in self.items for w in item], dtype=np.int64)
        found = [windows(c) for c in codes]
        h = np.concatenate([f[0] for f in found]) if found else np.empty(0, np.int64)
        place = np.concatenate([np.stack([np.full(len(f[1]), n), f[1]], axis=1) for n, f in enumerate(found)]) if found else np.empty((0, 2), int)
        order = np.argsort(h, kind="stable")
        self.hashes, self.place = h[order], place[order]
        self.filter = np.zeros(1 << WINDOW_BITS, dtype=bool)
        self.filter[self.hashes & ((1 << WINDOW_BITS) - 1)] = True

    def coded(self, ws: list[str]) -> np.ndarray:
        return np.fromiter(map(self.codes.__getitem__, ws), dtype=np.int64, count=len(ws))

    def leaks(self, text: str | None) -> list[tuple[int, str, int, int]]:
        """(item id, kind, words taken over or template tokens in the longest stretch, its first word) of items that leaked into a text."""
        doc = words(text, self.latin)
        code = self.coded(doc)
        h, pos = windows(code)
        near = self.filter[h & ((1 << WINDOW_BITS) - 1)]
        h, pos = h[near], pos[near]
        if not len(h):
            return []
        left, right = np.searchsorted(self.hashes, h, "left"), np.searchsorted(self.hashes, h, "right")
        times = right - left
        if not times.any():
            return []
        # Every meeting of two windows lies on a diagonal of (item, document); all of a diagonal's words are compared at once.
        at = np.repeat(left - np.cumsum(times) + times, times) + np.arange(times.sum())
        n, q, p = self.place[at, 0], self.place[at, 1], np.repeat(pos, times)
        key = n * (1 << 32) + (p - q)
        order = np.argsort(key, kind="stable")
        key, q = key[order], q[order]
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        meets = np.diff(np.append(first, len(key)))
        several = meets >= 2
        if not several.any():
            return []
        lane = key[first[several]]
        dd = ((lane + (1 << 31)) & ((1 << 32) - 1)) - (1 << 31)
        dn = (lane - dd) >> 32
        # Only what lies between a diagonal's first and last meeting, and LEAST words around it, can be of a stretch that starts on it.
        lo = np.maximum(np.maximum(q[first[several]] - LEAST, 0), -dd)
        hi = np.minimum(np.minimum(q[first[several] + meets[several] - 1] + WINDOW + LEAST, self.start[dn + 1] - self.start[dn]), len(doc) - dd)
        size = hi - lo
        flat = np.repeat(np.arange(len(dn)), size)
        inside = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size - lo, size)
        here, own = inside + dd[flat], self.start[dn][flat] + inside
        number = self.number.get
        ids = np.fromiter((number(w, 0) for w in doc), dtype=np.int64, count=len(doc))
        change = flat[1:] != flat[:-1]
        equal = ids[here] == self.word[own]
        # A piece closes single words that differ.
        closed = equal.copy()
        closed[1:-1] |= equal[:-2] & equal[2:] & ~change[1:] & ~change[:-1]
        a, b = _runs(closed, change)
        total = np.concatenate([[0], np.cumsum(equal)])
        # What a stretch takes over lies in pieces of its diagonal and, after a split, lost or added word or a heading, of near ones.
        held = np.concatenate([[0], np.cumsum(np.bincount(flat[a], weights=b - a, minlength=len(lane)))])
        around = held[np.searchsorted(lane, lane + REACH, "right")] - held[np.searchsorted(lane, lane - REACH, "left")]
        good = (total[b] - total[a] >= PIECE) & (around[flat[a]] >= ENOUGH)
        # Within a piece a stretch may break and begin anew: it is followed from each run of equal words that no stretch covers yet.
        within = np.zeros(len(equal) + 1, dtype=np.int64)
        within[a[good]] += 1
        within[b[good]] -= 1
        starts = _runs(equal, change)[0]
        starts = starts[np.cumsum(within)[starts] > 0]
        out = self._literal(doc, dn[flat[starts]], inside[starts], here[starts])
        known = {x[0] for x in out}
        a, b = _runs(code[here] == self.code[own], change)
        long = b - a >= LEAST
        best: dict[int, tuple[int, int]] = {}
        for x, y in zip(a[long].tolist(), b[long].tolist()):
            i, f, g = int(dn[flat[x]]), int(inside[x]), int(here[x])
            if self.ids[i] not in known and y - x > best.get(i, (0, 0))[0] and consistent(self.items[i][f : f + y - x], doc[g : g + y - x]):
                best[i] = (y - x, g)
        return out + [(self.ids[i], "re-parameterised", k, g) for i, (k, g) in sorted(best.items())]

    def _literal(self, doc: list[str], n: np.ndarray, q: np.ndarray, p: np.ndarray) -> list[tuple[int, str, int, int]]:
        backwards = doc[::-1]
        best: dict[int, tuple[int, int]] = {}
        done: dict[int, list[tuple[int, int, int, int]]] = {}
        for i, b, a in zip(n.tolist(), q.tolist(), p.tolist()):
            # A piece within a stretch already followed adds nothing.
            item, spans = self.items[i], done.setdefault(i, [])
            if any(s <= a < e and f <= b < g for s, e, f, g in spans):
                continue
            # Words before the piece are read from reversed copies.
            back, p0, q0 = stretch(backwards, self.backwards[i], len(doc) - a, len(item) - b, -1)
            p0, q0 = len(doc) - p0, len(item) - q0
            ahead, p1, q1 = stretch(doc, item, a, b, 1)
            spans.append((p0, p1, q0, q1))
            if back + ahead > best.get(i, (0, 0))[0]:
                best[i] = (back + ahead, p0)
        return [(self.ids[i], "literal", k, first) for i, (k, first) in sorted(best.items()) if k >= LEAST]


def _runs(flags: np.ndarray, change: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the runs of true flags, which do not go over a change."""
    begins = flags.copy()
    begins[1:] &= ~flags[:-1] | change
    ends = flags.copy()
    ends[:-1] &= ~flags[1:] | change
    return np.flatnonzero(begins), np.flatnonzero(ends) + 1


def consistent(item: list[str], doc: list[str]) -> bool:
    """Whether slots that differ are filled by one rule: equal values stay equal and different ones different."""
    there: dict[str, str] = {}
    back: dict[str, str] = {}
    changed = False
    for x, y in zip(item, doc):
        if there.setdefault(x, y) != y or back.setdefault(y, x) != x:
            return False
        changed |= x != y
    return changed


def misread(a: str, b: str) -> bool:
    """Whether a is b with some characters read wrongly: about as long, and most characters in place from either end."""
    n, m = len(a), len(b)
    if abs(n - m) > 1 or min(n, m) < 3:
        return False
    head = sum(map(eq, a, b))
    tail = head if n == m else sum(map(eq, reversed(a), reversed(b)))
    return max(head, tail) * 3 >= max(n, m) * 2 or head + tail >= max(n, m) + 1


def stretch(d: list[str], e: list[str], p: int, q: int, step: int) -> tuple[int, int, int]:
    """Words of an item e taken over into d from (p, q) on, and where the stretch ends. step is -1 if both are read backwards."""
    i, j, taken = p, q, 0
    nd, ne = min(len(d), p + len(e) + len(e) // 2 + 8 * HEADING), len(e)
    while i < nd and j < ne:
        x, y = d[i], e[j]
        if x == y:
            taken, i, j = taken + 1, i + 1, j + 1
            continue
        d1, e1 = d[i + 1] if i + 1 < nd else "", e[j + 1] if j + 1 < ne else ""
        if (x + d1 if step > 0 else d1 + x) == y:  # a split word
            taken, i, j = taken + 1, i + 2, j + 1
        elif (y + e1 if step > 0 else e1 + y) == x:  # two words run together
            taken, i, j = taken + 2, i + 1, j + 2
        elif d1 == e1 and (near := misread(x, y)) or d1 == e1 and d[i + 1 : i + 3] == e[j + 1 : j + 3]:  # a misread or altered word
            taken, i, j = taken + bool(near), i + 1, j + 1
        elif d1 == y and d[i + 1 : i + 4] == e[j : j + 3]:  # an added word
            i += 1
        elif e1 == x and d[i : i + 3] == e[j + 1 : j + 4]:  # a lost word
            j += 1
        elif d[i + 2 : i + 5] == e[j + 1 : j + 4] and d[i + 2 : i + 5]:  # an altered word in two pieces
            i, j = i + 2, j + 1
        elif d[i + 1 : i + 4] == e[j + 2 : j + 5] and d[i + 1 : i + 4]:
            i, j = i + 1, j + 2
        else:
            # A heading stands between two words of the passage, which goes on after it.
            jump = y in d[i + 2 : i + HEADING + 1] and next((k for k in range(2, min(HEADING + 1, nd - i)) if d[i + k] == y and d[i + k : i + k + 4] == e[j : j + 4]), 0)
            if not jump:
                break
            i += jump
    return taken, i, j


def leaked(documents: DataFrame, items: DataFrame, key: str = "doc_id", text: str = "text", item: str = "item_id", passage: str = "passage", item_bytes: int = ITEM_BYTES) -> DataFrame:
    """(key, item_id, kind, words, first_word): documents into which an item leaked, literally or with other values in its slots.

    Every document is scanned whole, once, against all items. Null and empty texts and passages match nothing; repeated
    documents are reported each under its key; extra columns are ignored; a literal leak is not reported as a re-parameterised one too.
    """
    rows = items.where(F.col(passage).isNotNull()).select(F.col(item).alias("item_id"), F.col(passage).alias("passage"))
    kind, ikind = documents.schema[key].dataType.simpleString(), items.schema[item].dataType.simpleString()
    schema = f"{key} {kind}, item_id {ikind}, kind string, words int, first_word int"
    columns = [key, "item_id", "kind", "words", "first_word"]
    if (rows.agg(F.sum(F.octet_length("passage"))).first()[0] or 0) > item_bytes:
        return _joined(documents, rows, key, text, schema, columns)
    held = rows.orderBy("item_id", "passage").toPandas()
    shared = documents.sparkSession.sparkContext.broadcast((held["item_id"].tolist(), held["passage"].tolist()))

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        index = Index(*shared.value)
        for pdf in batches:
            yield pd.DataFrame([(k, *x) for k, t in zip(pdf[key], pdf[text]) for x in index.leaks(t if isinstance(t, str) else None)], columns=columns)

    return documents.select(key, text).mapInPandas(run, schema)


def _joined(documents: DataFrame, items: DataFrame, key: str, text: str, schema: str, columns: list[str]) -> DataFrame:
    """The same for items of any number. What reaches the driver are the set bits of two bitmaps of a fixed size."""

    def spoken(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(w, how, k) for (w, how), k in ordinary(pdf["passage"].tolist()).items()], columns=["word", "how", "n"])

    def bit_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"bit": np.flatnonzero(word_bits([w for w, n, h in zip(pdf["word"], pdf["lower"], pdf["head"]) if is_ordinary(w, n, h)]))})

    count = lambda how: F.sum(F.when(F.col("how") == how, F.col("n")).otherwise(0))
    said = items.mapInPandas(spoken, "word string, how string, n bigint").groupBy("word").agg(count("lower").alias("lower"), count("head").alias("head"))
    ordinary_bits = np.zeros(1 << WORD_BITS, dtype=bool)
    ordinary_bits[said.mapInPandas(bit_of, "bit bigint").distinct().toPandas()["bit"].to_numpy(dtype=np.int64)] = True

    sc = documents.sparkSession.sparkContext
    vocabulary = sc.broadcast(ordinary_bits)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes = Vocabulary(vocabulary.value)
        for pdf in batches:
            found = [(i, windows(np.fromiter(map(codes.__getitem__, ws), np.int64, len(ws)))[0]) for i, p in zip(pdf["item_id"], pdf["passage"]) if (ws := words(p))]
            yield pd.DataFrame([(i, x) for i, h in found for x in np.unique(h).tolist()], columns=["item_id", "h"])

    ikind = items.schema["item_id"].dataType.simpleString()
    cuts = checkpointed(items.mapInPandas(cut, f"item_id {ikind}, h bigint"))
    window_bits = np.zeros(1 << WINDOW_BITS, dtype=bool)
    window_bits[cuts.select(F.col("h").bitwiseAND(F.lit((1 << WINDOW_BITS) - 1)).alias("bit")).distinct().toPandas()["bit"].to_numpy(dtype=np.int64)] = True
    passed = sc.broadcast(window_bits)

    def near(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        codes = Vocabulary(vocabulary.value)
        for pdf in batches:
            out = []
            for k, t in zip(pdf[key], pdf[text]):
                ws = words(t if isinstance(t, str) else None)
                h = windows(np.fromiter(map(codes.__getitem__, ws), np.int64, len(ws)))[0]
                h = np.unique(h[passed.value[h & ((1 << WINDOW_BITS) - 1)]])
                if len(h):
                    out.append((k, t, h.tolist()))
            yield pd.DataFrame(out, columns=[key, "text", "hs"])

    kind = documents.schema[key].dataType.simpleString()
    met = checkpointed(documents.select(key, text).mapInPandas(near, f"{key} {kind}, text string, hs array<bigint>").withColumn("_row", F.monotonically_increasing_id()))
    pairs = met.select("_row", F.explode("hs").alias("h")).join(cuts, "h").select("_row", "item_id").distinct()
    both = met.select("_row", key, "text").join(pairs, "_row").join(items, "item_id").select(key, "text", "item_id", "passage")

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame([(k, *x) for k, t, i, p in zip(pdf[key], pdf["text"], pdf["item_id"], pdf["passage"]) for x in Index([i], [p], vocabulary.value).leaks(t)], columns=columns)

    return both.mapInPandas(check, schema)
