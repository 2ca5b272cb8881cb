"""Toxicity by a subsequence string kernel, Nyström landmarks and a support vector machine.

Two words are similar by their common subsequences of three symbols, each occurrence weighted by
``DECAY`` to the power of the gap symbols it spans, so an insult with inserted or missing characters stays near the
insult. Landmark words give each word a vector (Nyström), and a machine with squared hinge loss
learns from labelled sentences: in a clean one every word is an example, in a toxic one its witnesses
are (the words that toxic texts alone have beyond chance; where there is none, the word that the last
fit scores highest), with the clean words that score highest as hard examples. The decision is linear in the subsequences, so landmarks and machine fold into
one table of weights by subsequence; scoring a word costs its subsequences, whatever the landmarks.

A document's score is a logistic function of its two highest words. Whole texts are scored, one map
over the documents; only the fit collects, and the model that is sent to the workers has a fixed size.

What is fitted is a machine over words: sentences of toxic texts only choose their witnesses, as in
multiple-instance learning, and are no examples themselves. Bounds of the fit, none of them of the scoring:
``most_labelled`` documents a class (3,000) and ``most_bytes`` of their whole texts (64 MB a class);
``negatives`` clean words drawn as examples (4,000) and a quarter as many hard ones a round; ``landmarks``
(192); near copies among the labelled are looked for by the ``sketch`` (6) least hashes of a text, among the
last ``compared`` (20) texts of each. The logistic layer is fitted on 15 % of the labelled texts that the
words were not learnt from, if each class has 8, and on all of them otherwise.

Defined results
* null, empty and white texts have no words and get the lowest score. Text is all that is scored.
* a document labelled twice counts as toxic if any label says so; null labels are left out. Rows that
  share an id teach with one of their texts and are scored one by one. Without
  labels of both classes the score is the constant 0.
* equal rows, ties and null ids are scored one by one. Empty table: no rows.
"""

from __future__ import annotations

import re
import sys
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import checkpointed, fresh, kept, release, rest, text_or_empty

DECAY = 0.6
REACH = 6
SYMBOLS = 40
FLOOR = -4.0
#: Digits and signs that stand for letters.
LOOKALIKES = {"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "$": "s", "@": "a", "!": "i"}
EDGES = ".,;:!?\"'()[]{}<>*#%&|-_~"
_SPACED = re.compile(r"(?<!\S)\w(?:[ .*_-]\w){2,}(?!\S)")


def _symbol_table() -> np.ndarray:
    """Code of every character below U+0250: 1-26 letters, 27 digits, 28-37 other letters; 0 for signs, which are only gaps."""
    out = np.zeros(0x250, dtype=np.int64)
    for i in range(0x250):
        c = LOOKALIKES.get(chr(i), chr(i)).lower()[:1]
        if "a" <= c <= "z":
            out[i] = ord(c) - 96
        elif c.isdigit():
            out[i] = 27
        elif c.isalpha():
            out[i] = 28 + ord(c) % 10
    return out


_TABLE = _symbol_table()
FIRST, LAST = 38, 39


def _subsequences(words: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, float]]:
    """For each pair of gaps: the words, the subsequence codes and the weight of one occurrence."""
    raw = np.frombuffer("".join(f"\ue000{w}\ue001" for w in words).encode("utf-32-le", "replace"), dtype="<u4").astype(np.int64)
    code = np.where(raw < len(_TABLE), _TABLE[np.minimum(raw, len(_TABLE) - 1)], 28 + raw % 10)
    code[raw == 0xE000] = FIRST
    code[raw == 0xE001] = LAST
    # A word's own private-use characters would look like borders: the borders are the known ones.
    sizes = np.array([len(w) + 2 for w in words], dtype=np.int64)
    ends = np.cumsum(sizes)
    inner = (raw == 0xE000) | (raw == 0xE001)
    inner[ends - 1] = inner[ends - sizes] = False
    code[inner] = 0
    of = np.repeat(np.arange(len(words)), sizes)
    for a in range(1, REACH):
        for b in range(1, REACH - a + 1):
            n = len(code) - a - b
            if n <= 0:
                continue
            x, y, z = code[:n], code[a : a + n], code[a + b :]
            ok = (of[:n] == of[a + b :]) & (x > 0) & (y > 0) & (z > 0)
            yield of[:n][ok], (x[ok] * SYMBOLS + y[ok]) * SYMBOLS + z[ok], DECAY ** (a + b - 2)


def word_scores(words: list[str], table: np.ndarray, chunk: int = 20_000) -> np.ndarray:
    """The linear function ``table`` of each word's normalised subsequences."""
    out = []
    for at in range(0, len(words), chunk):
        part = words[at : at + chunk]
        total, norm = np.zeros(len(part)), np.full(len(part), 1e-12)
        for of, code, weight in _subsequences(part):
            total += weight * np.bincount(of, table[code], minlength=len(part))
            norm += weight**2 * np.bincount(of, minlength=len(part))
        out.append(total / np.sqrt(norm))
    return np.concatenate(out) if out else np.array([])


def kernel_rows(words: list[str], landmarks: np.ndarray, chunk: int = 200) -> np.ndarray:
    """Kernel of each word with landmarks given as (subsequence, landmark) columns."""
    used = np.flatnonzero(landmarks.any(axis=1))
    place = np.full(len(landmarks), -1)
    place[used] = np.arange(len(used))
    kept, out = landmarks[used].astype(np.float64), []
    for at in range(0, len(words), chunk):
        part = words[at : at + chunk]
        features, norm = np.zeros(len(part) * len(used)), np.full(len(part), 1e-12)
        for of, code, weight in _subsequences(part):
            norm += weight**2 * np.bincount(of, minlength=len(part))
            known = place[code] >= 0
            features += weight * np.bincount(of[known] * len(used) + place[code[known]], minlength=len(features))
        out.append(features.reshape(len(part), len(used)) @ kept / np.sqrt(norm)[:, None])
    return np.concatenate(out) if out else np.zeros((0, landmarks.shape[1]))


def landmark_columns(words: list[str]) -> np.ndarray:
    columns, norm = np.zeros((SYMBOLS**3, len(words)), dtype=np.float32), np.full(len(words), 1e-12)
    for of, code, weight in _subsequences(words):
        np.add.at(columns, (code, of), np.float32(weight))
        norm += weight**2 * np.bincount(of, minlength=len(words))
    return columns / np.sqrt(norm).astype(np.float32)


def cleaned(word: str) -> str:
    return word.strip(EDGES).lower()


def words_in(text: str | None) -> list[str]:
    """White-space words; letters that stand alone in a row are also read as one word."""
    if not text:
        return []
    words = text.split()
    return words + [re.sub(r"[ .*_-]", "", m) for m in _SPACED.findall(text)]


def squared_hinge(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-2, rounds: int = 20) -> np.ndarray:
    """Primal Newton steps; the last coefficient is the intercept."""
    x = np.hstack([x, np.ones((len(x), 1))])
    w, before = np.zeros(x.shape[1]), None
    for _ in range(rounds):
        active = y * (x @ w) < 1
        if before is not None and (active == before).all():
            break
        before, a = active, x[active] * weight[active, None]
        w = np.linalg.solve(a.T @ x[active] + ridge * np.eye(x.shape[1]), a.T @ y[active])
    return w


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 1e-2, rounds: int = 30) -> np.ndarray:
    x = np.hstack([x, np.ones((len(x), 1))])
    w = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        w = w - np.linalg.solve((x * (p * (1 - p) + 1e-6)[:, None]).T @ x + ridge * np.eye(x.shape[1]), x.T @ (p - y) + ridge * w)
    return w


@dataclass
class Model:
    """Weights by subsequence, the machine's intercept, and the document's logistic coefficients."""

    table: np.ndarray
    intercept: float
    document: np.ndarray

    def words(self, words: list[str]) -> np.ndarray:
        return np.maximum(word_scores(words, self.table) + self.intercept, FLOOR)

    def score(self, tops: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(np.hstack([tops, np.ones((len(tops), 1))]) @ self.document, -30, 30)))


def two_highest(words: list[str], value: dict[str, float]) -> tuple[float, float]:
    """The highest scores of two occurrences of words."""
    if not words:
        return FLOOR, FLOOR
    distinct = list(set(words))
    scores = [value[w] for w in distinct]
    top = max(scores)
    best = distinct[scores.index(top)]
    scores[scores.index(top)] = FLOOR
    return top, top if words.count(best) > 1 else max(scores)


def sentences(text: str) -> list[str]:
    return [s for s in re.split(r"(?<=[.!?])\s+|\n", text) if s.strip()]


def unlike(bags: list[list[str]], share: float = 0.5, sketch: int = 6, compared: int = 20) -> list[bool]:
    """Whether each bag is no near copy of one before it: copies would make any word of theirs look telling.

    Bags meet by the smallest hashes of their longer words, each with the last few of the same hash."""
    known: dict[int, list[np.ndarray]] = {}
    out = []
    for bag in bags:
        own = np.unique(np.array([zlib.crc32(w.encode("utf-8", "replace")) for w in bag], dtype=np.uint32))
        least = sorted({zlib.crc32(w.encode("utf-8", "replace")) for w in bag if len(w) > 6} or own.tolist())[:sketch]
        near = {id(x): x for h in least for x in known.get(h, ())[-compared:]}
        shared = (np.intersect1d(own, x, assume_unique=True) for x in near.values())
        fresh = not any(len(s) > share * (len(own) + len(x) - len(s)) for s, x in zip(shared, near.values()))
        if fresh:
            for h in least:
                known.setdefault(h, []).append(own)
        out.append(fresh)
    return out


def telling_words(positive: list[list[str]], negative: list[list[str]], least: float = 13.0) -> dict[str, int]:
    """Words that toxic texts have far beyond chance (log-likelihood ratio) and clean ones hardly ever, with their counts."""
    toxic, clean = (Counter(w for bag in bags for w in bag) for bags in (positive, negative))
    share = toxic.total() / max(1, toxic.total() + clean.total())
    out = {}
    for w, n in toxic.items():
        m = clean.get(w, 0)
        if n > 9 * m and 2 * (n * np.log(n / (share * (n + m))) + (m * np.log(m / ((1 - share) * (n + m))) if m else 0.0)) >= least:
            out[w] = n
    return out


def fit(texts: list[str], toxic: list[int], landmarks: int = 192, negatives: int = 4000, rounds: int = 3, seed: int = 5) -> Model | None:
    """A model from labelled texts, cut into sentences that carry their text's label; None without both classes.

    The first witnesses are the telling words of toxic sentences. Sentences of toxic texts without one get
    theirs from the machine, once it finds a word likelier toxic than not in them.
    """
    y = np.array(toxic)
    if not (y == 1).any() or not (y == 0).any():
        return None
    rng = np.random.default_rng(seed)
    bags = [list({sys.intern(c) for w in words_in(t) if (c := cleaned(w))}) for t in texts]
    fresh = np.array(unlike(bags))
    learn = rng.random(len(bags)) < 0.85 if min((y == 1).sum(), (y == 0).sum()) >= 8 else np.ones(len(bags), dtype=bool)
    inside = lambda label: [(i, bags[i]) for i in np.flatnonzero(learn & fresh & (y == label)) if bags[i]]
    positive, negative = inside(1), inside(0)
    if not positive or not negative:
        return None
    telling = telling_words([b for _, b in positive], [b for _, b in negative])
    if not telling:  # too few labels to tell: the words of toxic texts that no clean one has
        clean = {w for _, b in negative for w in b}
        telling = dict(Counter(w for _, b in positive for w in b if w not in clean))
    clean_words = sorted({w for _, b in negative for w in b} - telling.keys())
    split = [[[c for w in words_in(s) if (c := cleaned(w))] for s in sentences(texts[i])] for i, _ in positive]
    words_of_toxic = sorted({w for _, b in positive for w in b})
    value: dict[str, float] = {}
    hard: list[str] = []
    model = None
    for _ in range(rounds if telling else 0):
        witness = Counter()
        for held in split:
            told = [w for s in held for w in s if w in telling]
            witness.update(told)
            if not told and value:
                best = max((w for s in held for w in s), key=lambda w: (value[w], w), default=None)
                if best is not None and value[best] > 0:
                    witness[best] += 1
        examples = sorted(witness)
        sample = [clean_words[i] for i in rng.permutation(len(clean_words))[:negatives]]
        sample = [w for w in dict.fromkeys(sample + hard) if w not in witness]
        often = [w for w, _ in witness.most_common(landmarks // 2)]
        chosen = often + [sample[i] for i in rng.permutation(len(sample))[: landmarks - len(often)]]
        columns = landmark_columns(chosen)
        values, vectors = np.linalg.eigh(kernel_rows(chosen, columns))
        root = vectors[:, values > 1e-6] / np.sqrt(values[values > 1e-6])
        x = np.vstack([kernel_rows(examples, columns) @ root, kernel_rows(sample, columns) @ root])
        sign = np.r_[np.ones(len(examples)), -np.ones(len(sample))]
        count = np.sqrt([witness[w] for w in examples])
        weight = np.r_[count / count.sum(), np.ones(len(sample)) / max(1, len(sample))] * len(sign) / 2
        w = squared_hinge(x, sign, weight)
        model = Model((columns @ (root @ w[:-1])).astype(np.float64), float(w[-1]), np.array([1.0, 1.0, 0.0]))
        value = dict(zip(words_of_toxic, model.words(words_of_toxic)))
        scored = model.words(clean_words)
        hard = list(dict.fromkeys(hard + [clean_words[i] for i in np.argsort(-scored)[: negatives // 4]]))
    if model is None:
        return None
    held = np.flatnonzero(~learn) if (~learn & (y == 1)).any() and (~learn & (y == 0)).any() else np.arange(len(y))
    raw = [words_in(texts[i]) for i in held]
    names = sorted({w for ws in raw for w in ws})
    value = dict(zip(names, model.words([cleaned(w) for w in names])))
    model.document = logistic(np.array([two_highest(ws, value) for ws in raw]), y[held].astype(float))
    return model


def train(docs: DataFrame, labels: DataFrame, most_labelled: int = 3000, most_bytes: int = 64 << 20) -> Model | None:
    """Fit on at most ``most_labelled`` documents of each class and ``most_bytes`` of whole texts of each, the first by a hash of their ids.

    Of rows that share an id the least text is read."""
    one = labels.filter("toxic is not null and doc_id is not null").groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    picked = [one.filter(F.col("toxic") == c).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_labelled) for c in (0, 1)]
    rows = docs.select("doc_id", text_or_empty().alias("text")).join(F.broadcast(picked[0].unionByName(picked[1])), "doc_id")
    rows = checkpointed(rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.first("toxic").alias("toxic")))
    upto = F.sum(F.octet_length("text")).over(Window.partitionBy("toxic").orderBy(F.xxhash64("doc_id"), "doc_id"))  # over the picked rows
    rows = rows.withColumn("upto", upto).filter(F.col("upto") <= most_bytes).orderBy("doc_id").select("text", "toxic").toArrow()
    return fit(rows["text"].to_pylist(), rows["toxic"].to_pylist())


_CACHE: dict[str, tuple[dict, dict]] = kept()


def toxicity(docs: DataFrame, model: Model | None, capacity: int = 100_000, name: str = "score") -> DataFrame:
    """All columns of ``docs`` with ``name`` (0 to 1) added."""
    if model is None:
        return docs.withColumn(name, F.lit(0.0))
    key = str(hash((model.table.tobytes(), model.document.tobytes())))

    @F.pandas_udf("double")
    def scored(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        release(_CACHE)
        new, old = _CACHE.setdefault(key, ({}, {}))  # scores of words, two generations, until another operator's task releases them
        if len(_CACHE) > 2:
            _CACHE.clear()
            _CACHE[key] = (new, old)
        for texts in batches:
            tops = np.empty((len(texts), 2))
            for at in range(0, len(texts), 256):
                words = [words_in(t) for t in texts.iloc[at : at + 256]]
                if len(new) > capacity:
                    old, new = new, {}
                    _CACHE[key] = (new, old)
                missing = []
                for w in set().union(*words).difference(new):
                    if w in old:
                        new[w] = old[w]
                    else:
                        missing.append(w)
                new.update(zip(missing, model.words([cleaned(w) for w in missing]).tolist()))
                for i, ws in enumerate(words):
                    tops[at + i] = two_highest(ws, new)
            yield pd.Series(model.score(tops))
        rest()

    return docs.withColumn(name, scored(text_or_empty()))


def fold(of: int) -> Column:
    """Remainder of the checksum of the id's decimal text; a null id has the remainder of the empty text."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(of))


def score_documents(docs: DataFrame, labels: DataFrame, folds: int = 5, most_labelled: int = 3000) -> DataFrame:
    """doc_id, held_out, score, predicted; rows of fold 0 teach nothing."""
    model = train(docs.filter(fold(folds) != 0), labels, most_labelled)
    scored = toxicity(docs.select("doc_id", F.col("text")), model)
    return scored.select("doc_id", (fold(folds) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def without_toxic(docs: DataFrame, labels: DataFrame, **options) -> DataFrame:
    """The documents that score below one half; every column of ``docs``."""
    name = fresh(docs, "toxicity")
    return toxicity(docs, train(docs, labels, **options), name=name).filter(F.col(name) < 0.5).drop(name)
