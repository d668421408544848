"""Language identification: averaged embeddings of hashed subwords and a linear softmax, trained by gradient descent in numpy.

A text's subwords are the runs of 2 to 4 bytes of its words with their bounding blanks (letters of A-Z lower-cased, all
other ASCII signs taken for blanks). Prediction uses whole texts. Because the embeddings are averaged before the linear
layer, both fold into one table of scores for each subword bucket.

A softmax only says which learned language is nearest, so that of foreign text and gibberish is sure of itself as well. What
a text has of its language is its familiarity: the mean log probability of its subwords among those of the language's
training texts, against even odds. Its threshold lies between texts held from training and texts made to be out of class.

Familiarity is with the training texts' vocabulary; ordinary text in other words isn't familiar either. What all texts of a
language share are its common words, so a text stays, however odd the rest is, if more of its words are among those of the
language than in all but a few texts of other languages or of none.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from palimp.llm import textvec as tv
from palimp.llm.durable import few_at_once

BITS, ORDERS, DIM = 14, (2, 3, 4), 16
#: The bounds of the training sample, which comes to the driver: rows, characters of a row, languages.
TRAIN_ROWS, TRAIN_CHARS, LANGUAGES = 1200, 20_000, 256
#: A text is rejected if its calibrated score or its familiarity is below what all but this part of the calibration texts reach.
REJECT = 0.002
#: Familiarity counts so many subwords of the mean in class besides a text's own: a few odd ones don't reject a short text.
PRIOR = 20
#: A language's common words are in this part of its training texts of so many words; a text has at least so many of them.
COMMON, ENOUGH, SPOKEN = 0.5, 30, 3
#: The part of the texts out of class that have fewer common words than the threshold.
FOREIGN = 0.99
_WORD = re.compile(r"[^\W\d_]+")
U = np.uint64
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_CLASS = np.arange(256)
_CLASS[:128] = 32
_CLASS[97:123] = _CLASS[65:91] = np.arange(97, 123)
TABLE = tv.BYTE[_CLASS]
UNKNOWN = "und"


def buckets(buf: np.ndarray, bits: int = BITS) -> list[np.ndarray]:
    """For each order, the bucket of the run that starts at each byte, or -1 where a blank stands within it."""
    t, blank = TABLE[buf], np.r_[0, np.cumsum(_CLASS[buf] == 32)]
    out, total = [], np.zeros(len(buf), U)
    for k in range(max(ORDERS)):
        total = total[: len(buf) - k] + t[k:] * (tv.P + U(2 * k))
        n = k + 1
        if n in ORDERS and len(total):
            h = ((total * U(0xD6E8FEB86659FD93)) >> U(64 - bits)).astype(np.int32)
            last = len(buf) - n + 1
            inside = blank[n - 1 : n - 1 + last] - blank[1 : 1 + last] if n > 2 else 0
            alone = (blank[1 : 1 + last] > blank[:last]) & (blank[n : n + last] > blank[n - 1 : n - 1 + last]) if n == 2 else False
            out.append(np.where((inside > 0) | alone, -1, h))
    return out


def counts(found: list[np.ndarray], a: int, b: int, size: int) -> np.ndarray:
    """How often each bucket occurs in bytes a to b."""
    parts = [x[a : b - n + 1] for n, x in zip(ORDERS, found, strict=False) if b - a >= n]
    x = np.concatenate(parts) if parts else np.empty(0, np.int32)
    return np.bincount(x[x >= 0], minlength=size)


@dataclass
class Model:
    languages: list[str]
    scores: np.ndarray  # (buckets, languages): embedding times weights
    bias: np.ndarray
    temperature: float
    least: float  # texts with lower scores are rejected
    familiar: np.ndarray  # (buckets, languages): log probability in a language's training texts, against even odds
    usual: float = 0.0  # mean familiarity of texts in class
    least_familiar: float = -np.inf  # texts of lower familiarity are rejected
    common: dict[str, frozenset[str]] = field(default_factory=dict)  # each language's common words
    least_common: float = 1.0  # texts with a larger part of common words stay

    def logits(self, n: np.ndarray) -> np.ndarray:
        total = n.sum()
        used = np.flatnonzero(n)
        return (n[used] @ self.scores[used]) / total + self.bias if total else self.bias

    def predict(self, n: np.ndarray) -> tuple[str, float]:
        if not self.languages:
            return UNKNOWN, 0.0
        z = self.logits(n) / self.temperature
        e = np.exp(z - z.max())
        k = int(e.argmax())
        return self.languages[k], float(e[k] / e.sum())

    def familiarity(self, n: np.ndarray, lang: str) -> float:
        used = np.flatnonzero(n)
        own = n[used] @ self.familiar[used, self.languages.index(lang)]
        return float((own + PRIOR * self.usual) / (n.sum() + PRIOR))

    def spoken(self, text: str, lang: str) -> float:
        """The part of a text's words that are among the common ones of a language; 0 if there are too few to tell."""
        words = _WORD.findall(text.lower())
        known = sum(map(self.common.get(lang, frozenset()).__contains__, words))
        return known / len(words) if known >= SPOKEN else 0.0

    def judge(self, n: np.ndarray, text: Callable[[], str] = str) -> tuple[str, float, bool]:
        """Language, score and whether the text is rejected; `text` is asked for only if the subwords alone would reject it."""
        lang, score = self.predict(n)
        if lang == UNKNOWN:
            return lang, score, True
        odd = score < self.least or self.familiarity(n, lang) < self.least_familiar
        return lang, score, odd and self.spoken(text(), lang) <= self.least_common


def strangers(raw: bytes, rng: np.random.Generator) -> list[bytes]:
    """Texts of about the same length that are in no language: the text's own signs shuffled, random letters and hex digits."""
    signs = np.array(list(raw.decode("utf-8", "ignore")))
    letters = np.frombuffer(b"abcdefghijklmnopqrstuvwxyz      ", np.uint8)
    return ["".join(rng.permutation(signs)).encode(), rng.choice(letters, len(raw)).tobytes(), rng.bytes(len(raw) // 2 + 1).hex(" ", 4).encode()]


def train(texts: list[str], langs: list[str], *, seed: int = 7, epochs: int = 30, rate: float = 4.0, bits: int = BITS) -> Model:
    """Fits embeddings, weights, temperature and rejection thresholds; every fifth text is kept for the last two.

    Longer texts also train by two windows of them, so that short texts are known as well.
    """
    languages = sorted(set(langs))
    size, label = 1 << bits, {x: i for i, x in enumerate(languages)}
    if not languages:
        return Model([], np.zeros((size, 0)), np.zeros(0), 1.0, 0.0, np.zeros((size, 0)))
    rng = np.random.default_rng(seed)

    def vector(raw: bytes) -> np.ndarray:
        buf = np.frombuffer(b" " + raw + b" ", np.uint8)
        return counts(buckets(buf, bits), 0, len(buf), size)

    # Sparse rows: the buckets of a cut and their parts of it.
    x, y, held, held_y = [], [], [], []
    seen = np.zeros((size, len(languages)))
    long: Counter = Counter()
    inside: dict[str, Counter] = {x: Counter() for x in languages}
    for i, (text, lang) in enumerate(zip(texts, langs, strict=True)):
        raw = text.encode()
        if i % 5 == 4:
            held.append(raw)
            held_y.append(label[lang])
            continue
        seen[:, label[lang]] += vector(raw)
        words = _WORD.findall(text.lower())
        if len(words) >= ENOUGH:
            long[lang] += 1
            inside[lang].update(set(words))
        cuts = [raw]
        if len(raw) > 200:
            for n in (60, 200):
                a = int(rng.integers(0, len(raw) - n))
                cuts.append(raw[a : a + n])
        for c in cuts:
            v = vector(c)
            if v.sum():
                used = np.flatnonzero(v)
                x.append((used, (v[used] / v.sum()).astype(np.float32)))
                y.append(label[lang])
    emb = rng.normal(0, 0.1, (size, DIM)).astype(np.float32)
    w, bias = np.zeros((DIM, len(languages)), np.float32), np.zeros(len(languages), np.float32)
    w += rng.normal(0, 0.1, w.shape).astype(np.float32)
    if y:
        y = np.array(y)
        for epoch in range(epochs):
            step = np.float32(rate * (1 - epoch / epochs))
            order = rng.permutation(len(x))
            for lo in range(0, len(order), 64):
                part = order[lo : lo + 64]
                used, at = np.unique(np.concatenate([x[i][0] for i in part]), return_inverse=True)
                xb = np.zeros((len(part), len(used)), np.float32)
                xb[np.repeat(np.arange(len(part)), [len(x[i][0]) for i in part]), at] = np.concatenate([x[i][1] for i in part])
                h = xb @ emb[used]
                z = h @ w + bias
                g = np.exp(z - z.max(1, keepdims=True))
                g /= g.sum(1, keepdims=True)
                g[np.arange(len(part)), y[part]] -= 1
                g /= len(part)
                grad = xb.T @ (g @ w.T)
                w -= step * (h.T @ g)
                bias -= step * g.sum(0)
                emb[used] -= step * 20 * grad
    familiar = np.log((seen + 0.5) / (seen.sum(0) + 0.5 * size) * size)
    common = {x: frozenset(w for w, k in inside[x].items() if k >= COMMON * long[x]) for x in languages}
    model = Model(languages, (emb @ w).astype(np.float64), bias.astype(np.float64), 1.0, 0.0, familiar, common=common)
    calibrate(model, held, held_y, vector, rng)
    return model


def calibrate(model: Model, held: list[bytes], of: list[int], vector: Callable[[bytes], np.ndarray], rng: np.random.Generator) -> None:
    """Sets temperature and thresholds by texts that weren't trained on, whole and cut, and by texts out of class.

    Out of class are strangers() of each, and the text itself to a model that knows all languages but its own.
    """
    own, y, outside, foreign = [], [], [], []
    for raw, k in zip(held, of, strict=True):
        cuts = [raw]
        for n in (60, 200):
            if len(raw) > n:
                a = int(rng.integers(0, len(raw) - n))
                cuts.append(raw[a : a + n])
        for cut in cuts:
            v = vector(cut)
            if not v.sum():
                continue
            own.append((v.sum(), model.logits(v), v @ model.familiar[:, k]))
            y.append(k)
            z = own[-1][1].copy()
            z[k] = -np.inf
            words = cut.decode("utf-8", "ignore")
            if len(z) > 1:
                outside.append((v.sum(), v @ model.familiar[:, int(z.argmax())]))
                foreign.append(model.spoken(words, model.languages[int(z.argmax())]))
            for other in strangers(cut, rng):
                v = vector(other)
                if v.sum():
                    nearest = int(model.logits(v).argmax())
                    outside.append((v.sum(), v @ model.familiar[:, nearest]))
                    foreign.append(model.spoken(other.decode("utf-8", "ignore"), model.languages[nearest]))
    if not own:
        return
    z, y = np.stack([r[1] for r in own]), np.array(y)
    if z.shape[1] > 1:
        # Separable texts would have the lowest temperature of all; one more error than was seen keeps it finite.
        doubt = 1 / (len(z) + 2)
        goal = np.full(z.shape, doubt / (z.shape[1] - 1))
        goal[np.arange(len(z)), y] = 1 - doubt
        best = np.inf
        for t in np.geomspace(0.01, 100, 120):
            e = z / t - (z / t).max(1, keepdims=True)
            lost = (np.log(np.exp(e).sum(1)) - (e * goal).sum(1)).mean()
            if lost < best - 1e-9:
                best, model.temperature = lost, float(t)
    e = np.exp((z - z.max(1, keepdims=True)) / model.temperature)
    model.least = float(np.quantile(1 / e.sum(1), REJECT))
    total, known = np.array([r[0] for r in own]), np.array([r[2] for r in own])
    model.usual = float((known / total).mean())
    shrunk = lambda n, x: (x + PRIOR * model.usual) / (n + PRIOR)
    low = float(np.quantile(shrunk(total, known), REJECT))
    high = float(np.quantile([shrunk(*r) for r in outside], 1 - REJECT)) if outside else low
    if foreign:
        model.least_common = float(np.quantile(foreign, FOREIGN))
    # Where the two overlap, clean texts stay.
    model.least_familiar = (low + high) / 2 if high < low else low


def part(key: str) -> F.Column:
    """crc32 of the key as text, modulo 4: rows with 2 are held out; null for a null key."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % 4


def fit(docs: DataFrame, *, text: str = "text", lang: str = "lang", key: str = "doc_id", rows: int = TRAIN_ROWS, chars: int = TRAIN_CHARS, seed: int = 7) -> Model:
    """Trains on a sample of the labelled rows that aren't held out: about `rows` rows of up to `chars` characters, as many
    for each of the (at most LANGUAGES, most frequent) languages where there are so many, drawn by a hash of the key."""
    known = docs.select(F.col(f"`{key}`").alias("k"), F.col(f"`{text}`").alias("t"), F.col(f"`{lang}`").alias("l")).where(F.col("l").isNotNull() & F.col("t").isNotNull() & (part("k") != 2) & (F.length("t") <= chars))
    found = known.groupBy("l").count().orderBy(F.desc("count"), "l").limit(LANGUAGES).collect()
    if not found:
        return train([], [])
    each = max(8, rows // len(found))
    odds = F.create_map(*(F.lit(x) for r in found for x in (r["l"], min(1.0, 1.2 * each / r["count"]))))
    draw = F.xxhash64("k", F.lit("langid"))
    drawn = known.where(F.pmod(draw, F.lit(1 << 30)) < F.coalesce(odds[F.col("l")], F.lit(0.0)) * F.lit(float(1 << 30)))
    # The first of the order, if more were drawn than expected: the sample doesn't depend on where rows lie.
    sample = drawn.select(draw.alias("d"), "l", "t").orderBy("d", "l", "t").limit(3 * max(rows, 8 * len(found))).collect()
    sample.sort(key=lambda r: (r["d"], r["l"], r["t"]))
    return train([r["t"] for r in sample], [r["l"] for r in sample], seed=seed)


def identify(docs: DataFrame, model: Model, *, text: str = "text", keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """keep + lang_pred, score, rejected for each row, from the whole text.

    A null text or one without a letter is `und`, score 0, rejected. Otherwise lang_pred is a learned language (ties: the
    first by name) and the row is rejected if its calibrated score or its familiarity is below the model's threshold and it
    has no more common words of that language than texts out of class have.
    Repeated rows are judged each; columns beside `text` and `keep` are not read; an empty table gives an empty result.
    """
    kept = docs.select(*(F.col(f"`{c}`") for c in keep))
    size = len(model.scores)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, scores, rejected = [], [], []
            for _, buf, offs in tv.slices(b.column(len(keep))):
                plain = np.r_[0, np.cumsum(_LETTER[buf])]
                # Each text stands between blanks of its own.
                wide = np.full(len(buf) + 2 * len(offs), 32, np.uint8)
                own = np.repeat(np.arange(len(offs) - 1), np.diff(offs))
                wide[np.arange(len(buf)) + 2 * own + 1] = buf
                found = buckets(wide)
                for i, (a, e) in enumerate(zip(offs[:-1].tolist(), offs[1:].tolist(), strict=True)):
                    if plain[e] == plain[a] and not any(c.isalpha() for c in buf[a:e].tobytes().decode("utf-8", "replace")):
                        lang, score, out = UNKNOWN, 0.0, True
                    else:
                        lang, score, out = model.judge(counts(found, a + 2 * i, e + 2 * i + 2, size), lambda a=a, e=e, buf=buf: buf[a:e].tobytes().decode("utf-8", "replace"))
                    langs.append(lang)
                    scores.append(score)
                    rejected.append(out)
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(keep))), pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())], names=[*keep, "lang_pred", "score", "rejected"])

    schema = T.StructType([*kept.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("rejected", T.BooleanType())])
    return few_at_once(docs).select(*(F.col(f"`{c}`") for c in keep), F.col(f"`{text}`").alias("__text")).mapInArrow(judge, schema)
