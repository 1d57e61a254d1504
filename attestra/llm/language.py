"""Problem 9: the language of each document and of each segment of a mixed one, with a confidence.

String-kernel classification. Two texts are as similar as they share character n-grams of all lengths up to P (the
blended-spectrum presence kernel, normalised by the sizes of their n-gram sets). Landmark sentences span the kernel's
feature space (Nyström), in which one-versus-rest ridge regression is fitted. The kernel is linear in the presence of
n-grams, so landmarks and regression weights fold into one weight row per n-gram, and a batch of sentences is scored
as the product of its sparse presence matrix with these weights.

The model is fitted on a bounded sample of labelled rows (FIT_DOCUMENTS); every sentence of every document is scored.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from attestra.llm.text import sentences

#: Notations of the languages, as far as they are no prefix of each other ("en-IN" is cut to "en").
NOTATIONS = {
    "en": ("en", "eng", "english", "अंग्रेज़ी"),
    "hi": ("hi", "hin", "hindi", "हिन्दी", "हिंदी"),
    "mr": ("mr", "mar", "marathi", "मराठी"),
    "ta": ("ta", "tam", "tamil", "தமிழ்"),
    "kn": ("kn", "kan", "kannada", "ಕನ್ನಡ"),
    "te": ("te", "tel", "telugu", "తెలుగు"),
}
LANGUAGES = tuple(NOTATIONS)
_OF = {n: lang for lang, names in NOTATIONS.items() for n in names}
#: Longest n-gram, and bits of the space into which n-grams are hashed.
P, BITS = 4, 18
#: Labelled documents that the model is fitted on at most, distinct sentences of them, and landmarks per language.
FIT_DOCUMENTS, FIT_SENTENCES, LANDMARKS = 3000, 6000, 80
#: Sentences of one labelled document that the model is fitted on at most.
FIT_OF_ONE = 40
RIDGE = 0.3


def named(label: str | None) -> set[str]:
    """The languages that a label names in some notation; none for null, unknown and foreign ones."""
    if not isinstance(label, str):
        return set()
    return {_OF[p] for p in re.split(r"[^\wऀ-෿]+", label.strip().lower()) if p in _OF}


_DIGITS = re.compile(r"\d+")


def canonical(sentence: str) -> str:
    """A sentence as the kernel sees it: lower case, numbers as 0, single spaces."""
    return _DIGITS.sub("0", " ".join(sentence.lower().split()))


#: How the consonants and vowels of the Indic scripts, as Unicode names them, are written in Latin letters.
_LATIN = {
    "ca": "ch", "cha": "chh", "tta": "t", "ttha": "th", "dda": "d", "ddha": "dh", "nna": "n", "nnna": "n", "nya": "ny", "nga": "ng", "ssa": "sh",
    "lla": "l", "llla": "zh", "rra": "r", "dddha": "dh", "rha": "dh", "va": "v",
    "a": "a", "aa": "a", "i": "i", "ii": "i", "u": "u", "uu": "u", "e": "e", "ee": "e", "ai": "ai", "o": "o", "oo": "o", "au": "au", "vocalic r": "ru",
    "candra e": "e", "candra o": "o", "short e": "e", "short o": "o",
}


@lru_cache(maxsize=4096)
def _sign(ch: str) -> tuple[str, str]:
    """(kind, letters) of an Indic character: consonant, vowel, sign, mute (virama) or other."""
    name = unicodedata.name(ch, "").lower()
    if m := re.search(r" letter (.+)$", name):
        n = m[1]
        if n in _LATIN and not n.endswith("a") or n in ("a", "aa"):
            return "vowel", _LATIN[n]
        return "consonant", _LATIN.get(n, n.removesuffix("a"))
    if m := re.search(r" vowel sign (.+)$", name):
        return "sign", _LATIN.get(m[1], m[1][:1])
    if "virama" in name or "pulli" in name:
        return "mute", ""
    if "anusvara" in name or "candrabindu" in name:
        return "nasal", "n"
    if "nukta" in name:
        return "nukta", ""
    return "other", ch


def romanised(s: str, final: bool = False) -> str:
    """A sentence in an Indic script as people type it in Latin letters. final: the inherent vowel is written at word ends."""
    out, open_ = [], False
    for i, ch in enumerate(s):
        kind, letters = _sign(ch) if ch > "\u0900" else ("other", ch)
        if kind in ("sign", "mute"):
            open_ = False
        elif kind != "nukta" and open_:
            if final or kind in ("consonant", "vowel", "nasal"):
                out.append("a")
            open_ = False
        out.append(letters)
        open_ = open_ or kind == "consonant"
    return "".join(out)


def presence(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The presence matrix of at most 2^14 texts in sparse form: row numbers and n-gram bins, each pair once, sorted by row."""
    joined = "\x00".join(texts) + "\x00"
    codes = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    ends = codes == 0
    row = (np.cumsum(ends, dtype=np.uint32) - ends).astype(np.uint32) << np.uint32(BITS)
    keys = []
    h = np.zeros(len(codes), dtype=np.uint32)
    good = np.ones(len(codes), dtype=bool)
    for n in range(1, P + 1):
        shifted = np.zeros(len(codes), dtype=np.uint32)
        shifted[: len(codes) - n + 1] = codes[n - 1 :]
        h = (h ^ shifted) * np.uint32(0x9E3779B1)
        h ^= h >> np.uint32(15)
        good &= shifted != 0
        keys.append((row | (h >> np.uint32(32 - BITS)))[good])
    key = np.concatenate(keys)
    key.sort()
    key = key[np.concatenate([[True], key[1:] != key[:-1]])] if len(key) else key
    return (key >> np.uint32(BITS)).astype(np.int64), (key & np.uint32((1 << BITS) - 1)).astype(np.int64)


def fit(texts: list[str], labels: list[str], rounds: int = 3, seed: int = 7) -> np.ndarray:
    """Weights per n-gram bin and language.

    Labels may be wrong. A wrong label is a minority among the texts that are alike, though it may be most of a rare
    label's texts, so the first rounds weigh all texts alike; texts that the model puts elsewhere are left out of the
    next round. The last round weighs all languages alike.
    """
    texts, y = list(texts), np.array([LANGUAGES.index(v) for v in labels])
    keep = np.arange(len(texts))
    weights = np.zeros((1 << BITS, len(LANGUAGES)), dtype=np.float32)
    rng = np.random.default_rng(seed)
    for n in range(rounds):
        last = n == rounds - 1
        if last:
            marks = np.concatenate([rng.permutation(keep[y[keep] == c])[:LANDMARKS] for c in range(len(LANGUAGES))])
        else:
            marks = rng.permutation(keep)[: LANDMARKS * len(LANGUAGES)]
        row, col = presence([texts[i] for i in marks])
        used, local = np.unique(col, return_inverse=True)
        land = np.zeros((len(used), len(marks)), dtype=np.float32)
        land[local, row] = 1.0
        land /= np.sqrt(land.sum(axis=0))
        slot = np.full(1 << BITS, -1)
        slot[used] = np.arange(len(used))
        mark_kernel = land.T @ land
        kernel = np.zeros((len(keep), len(marks)), dtype=np.float32)
        for at in range(0, len(keep), 500):
            part = [texts[i] for i in keep[at : at + 500]]
            r, c = presence(part)
            sizes = np.bincount(r, minlength=len(part))
            known = slot[c] >= 0
            r, c = r[known], slot[c[known]]
            bounds = np.searchsorted(r, np.arange(len(part) + 1))
            for i in range(len(part)):
                kernel[at + i] = land[c[bounds[i] : bounds[i + 1]]].sum(axis=0) / max(1.0, np.sqrt(sizes[i]))
        values, vectors = np.linalg.eigh(mark_kernel.astype(np.float64))
        good = values > 1e-6
        root = vectors[:, good] / np.sqrt(values[good])
        phi = kernel @ root
        share = np.bincount(y[keep], minlength=len(LANGUAGES)).clip(1)
        w = 1.0 / share[y[keep]] * len(keep) / len(LANGUAGES) if last else np.ones(len(keep))
        target = np.where(y[keep][:, None] == np.arange(len(LANGUAGES)), 1.0, -1.0)
        solved = np.linalg.solve((phi * w[:, None]).T @ phi + RIDGE * np.eye(phi.shape[1]), (phi * w[:, None]).T @ target)
        weights = np.zeros((1 << BITS, len(LANGUAGES)), dtype=np.float32)
        weights[used] = land @ (root @ solved)
        agree = np.concatenate([score([texts[i] for i in keep[at : at + 2000]], weights).argmax(axis=1) for at in range(0, len(keep), 2000)] or [np.empty(0, int)])
        keep = keep[agree == y[keep]]
    return weights


def score(texts: list[str], weights: np.ndarray) -> np.ndarray:
    """One row of one-versus-rest scores per text."""
    out = np.zeros((len(texts), weights.shape[1]), dtype=np.float64)
    for at in range(0, len(texts), 2000):
        part = texts[at : at + 2000]
        row, col = presence(part)
        sizes = np.maximum(1, np.bincount(row, minlength=len(part)))
        for c in range(weights.shape[1]):
            out[at : at + len(part), c] = np.bincount(row, weights=weights[col, c], minlength=len(part)) / np.sqrt(sizes)
    return out


def confidence(scores: np.ndarray) -> np.ndarray:
    """The share of the best language: scores of -1 to 1 through a softmax."""
    e = np.exp(3.0 * (scores - scores.max(axis=1, keepdims=True)))
    return 1.0 / e.sum(axis=1)


def fitted(documents: DataFrame, key: str = "doc_id", text: str = "text", label: str = "lang") -> np.ndarray:
    """Weights from at most FIT_DOCUMENTS labelled documents, taken by a hash of their key; sentences are sampled within."""
    known = F.lower(F.regexp_extract(F.trim(label), r"^([^\W_]+)", 1)).isin(list(_OF))
    # Thinned by a hash first, so that no more than about twice the bound is gathered from all tasks together.
    every = max(1, documents.count() // (2 * FIT_DOCUMENTS))
    thin = documents.where(F.pmod(F.xxhash64(key), F.lit(every)) == 0)
    picked = thin.where(known & F.col(text).isNotNull()).select(key, text, label).orderBy(F.xxhash64(key), key).limit(FIT_DOCUMENTS).toPandas()
    votes: dict[str, Counter] = {}
    for t, lab in zip(picked[text], picked[label]):
        langs = named(lab)
        if len(langs) == 1:
            for a, b in sentences(t)[:FIT_OF_ONE]:
                votes.setdefault(canonical(t[a:b]), Counter())[next(iter(langs))] += 1
    pairs = {t: max(sorted(v), key=v.get) for t, v in votes.items()}
    chosen = sorted(pairs.items(), key=lambda x: hash_text(x[0]))[:FIT_SENTENCES]
    # Any of the languages may be typed in Latin letters, few are in the sample: its sentences are added in both scripts.
    chosen += [(romanised(t, final=lang not in ("hi", "mr")), lang) for t, lang in chosen if sum(ch > "\u0900" for ch in t) * 2 > len(t)]
    return fit([x[0] for x in chosen], [x[1] for x in chosen])


def hash_text(s: str) -> int:
    """A fixed order for sampling."""
    h = 0
    for b in s.encode()[:64]:
        h = (h * 131 + b) % 2_147_483_647
    return h


_LETTER = re.compile(r"[^\W\d_]", re.UNICODE)


def remainder(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """What lies between whole sentences and holds letters: headings, table rows, greetings, texts without terminal marks."""
    out, at = [], 0
    for a, b in [*spans, (len(text), len(text))]:
        piece = text[at:a]
        if _LETTER.search(piece):
            out.append((at + len(piece) - len(piece.lstrip()), at + len(piece.rstrip())))
        at = b
    return out


def classify(documents: DataFrame, weights: np.ndarray, key: str = "doc_id", text: str = "text", label: str | None = None, rest: bool = False) -> DataFrame:
    """One row per document: key, languages (array of struct lang, sentences, letters, confidence), segments and total sentences.

    segments: maximal runs of sentences in one language, with 1-based positions in the text. rest: what lies outside of whole
    sentences is classified too, as pieces that count no sentence, so that every text with letters has a language and no part
    of it is without a segment. Otherwise a document without whole sentences has none of either; null and empty texts have
    none in any case. Repeated rows are classified each. Extra columns are ignored.
    """
    shared = documents.sparkSession.sparkContext.broadcast(weights)
    kind = documents.schema[key].dataType.simpleString()
    schema = (
        f"{key} {kind}, _label string, n_sentences int, languages array<struct<lang:string,sentences:int,letters:int,confidence:double>>, "
        "segments array<struct<lang:string,start_pos:int,end_pos:int,sentences:int,confidence:double>>"
    )

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        w = shared.value
        known: dict[str, tuple[int, float]] = {}
        for pdf in batches:
            whole = [sentences(t) if isinstance(t, str) else [] for t in pdf[text]]
            spans = [sorted([(*x, 1) for x in s] + [(*x, 0) for x in remainder(t, s)]) if rest and isinstance(t, str) else [(*x, 1) for x in s] for t, s in zip(pdf[text], whole)]
            forms = [[canonical(t[a:b]) for a, b, _ in s] for t, s in zip(pdf[text], spans)]
            if len(known) > 200_000:
                known.clear()
            new = list({f for fs in forms for f in fs} - known.keys())
            if new:
                s = score(new, w)
                known.update(zip(new, zip(s.argmax(axis=1).tolist(), confidence(s).tolist())))
            rows = []
            for k, lab, span, fs, n_whole in zip(pdf[key], pdf["_label"], spans, forms, map(len, whole)):
                runs: list[list] = []
                total: dict[int, list] = {}
                for (a, b, one), f in zip(span, fs):
                    c, p = known[f]
                    t = total.setdefault(c, [0, 0, 0, 0.0])
                    t[0] += one
                    t[1] += b - a
                    t[2] += 1
                    t[3] += p
                    if runs and runs[-1][0] == c:
                        last = runs[-1]
                        last[2], last[3], last[4], last[5] = b, last[3] + one, last[4] + 1, last[5] + p
                    else:
                        runs.append([c, a + 1, b, one, 1, p])
                ranked = sorted(total.items(), key=lambda x: (-x[1][0], -x[1][1], x[0]))
                rows.append((
                    k, lab, n_whole,
                    [(LANGUAGES[c], n, size, p / m) for c, (n, size, m, p) in ranked],
                    [(LANGUAGES[c], a, b, n, p / m) for c, a, b, n, m, p in runs],
                ))
            yield pd.DataFrame(rows, columns=[key, "_label", "n_sentences", "languages", "segments"])

    tagged = documents.select(key, F.col(text), (F.col(label) if label else F.lit(None).cast("string")).alias("_label"))
    return tagged.mapInPandas(run, schema)


def labels(classified: DataFrame, key: str = "doc_id") -> DataFrame:
    """One row per document: its main language and confidence, and whether it is mixed.

    The main language has most whole sentences, or most of the text where there are none. The confidence is its share of
    these times their mean confidence. A text without letters has neither.
    """
    first = F.try_element_at("languages", F.lit(1))
    size = F.aggregate("languages", F.lit(0), lambda a, x: a + x["letters"])
    share = F.when(F.col("n_sentences") > 0, first["sentences"] / F.col("n_sentences")).otherwise(first["letters"] / size)
    return classified.select(
        key,
        first["lang"].alias("lang"),
        (first["confidence"] * share).alias("confidence"),
        (F.size(F.filter("languages", lambda x: x["sentences"] >= 2)) > 1).alias("mixed"),
    )


def unnamed(classified: DataFrame, key: str = "doc_id") -> DataFrame:
    """(key, lang): languages with two or more whole sentences, or the only one, that the document's label does not name."""
    each = classified.select(key, "_label", "n_sentences", F.explode("languages").alias("x"))
    enough = (F.col("x.sentences") >= 2) | (F.col("n_sentences") == 1) & (F.col("x.sentences") == 1)
    out = each.where(enough).select(key, F.col("x.lang").alias("lang"), "_label")
    words = F.split(F.lower(F.trim("_label")), r"[^\p{L}\p{M}]+")
    names = F.create_map(*[x for lang, ns in NOTATIONS.items() for x in (F.lit(lang), F.array(*map(F.lit, ns)))])
    stated = F.arrays_overlap(words, F.element_at(names, F.col("lang")))
    return out.where(~F.coalesce(stated, F.lit(False))).select(key, "lang")
