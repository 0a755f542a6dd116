"""Language identification by a linear-chain conditional random field over words.

Every word gets a language. A word's score for each language is the sum of learned weights of its
features: the word itself (lexicon), its affixes and its inner n-grams of characters, all hashed; learned
transitions join neighbouring words. The field is trained on sequences that switch language now and then,
cut from documents of known language, and decoded by forward-backward; a document's language is the one
with the greatest mean posterior over its distinct words, so that a word which a text repeats without end
counts once, with the mean of its places.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tickloom.llm.common import id_text, map_rows
from tickloom.llm.crf import slopes

UNKNOWN = "und"
BITS = 17
#: Characters of the n-grams; those that hold the mark of a word's begin or end are its affixes.
ORDERS = (1, 2, 3, 4)
CHUNK = 64
WORDS_HELD = 150_000
_WORD = re.compile(r"[^\W\d_]+")


@dataclass(frozen=True)
class Settings:
    """sample: training documents of each language at most (those with the least hash of the id); total: of all
    languages, so that each has fewer where they are many, but one at least. They bound what reaches the driver. sequences, or `each` for every
    language if that is more, x length words are cut from them; run: mean words before the language changes."""

    sample: int = 200
    total: int = 20_000
    sequences: int = 3000
    each: int = 750
    length: int = 64
    run: float = 12.0
    epochs: int = 6
    decay: float = 1e-6
    rate: float = 0.3


def words_of(text: str | None) -> list[str]:
    """Runs of letters, in lower case; runs without a letter proper (such as superscripts) are no words."""
    found = _WORD.findall(text.lower()) if text else []
    return [w for w in found if w.isalpha() or any(map(str.isalpha, w))]


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hashed features of the words and, for each, the number of its word."""
    marked = "".join(f"\2{w}\3" for w in words)
    codes = np.frombuffer(marked.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.fromiter(map(len, words), np.int64, len(words)) + 2
    owner = np.repeat(np.arange(len(words)), sizes)
    found, of = [], []
    value = np.zeros(len(codes), np.uint64)
    for n in range(1, max(ORDERS) + 1):
        m = len(codes) - n + 1
        if m <= 0:
            break
        value = value[:m] * np.uint64(0x100000001B3) + codes[n - 1 :] + np.uint64(n)
        inside = owner[:m] == owner[n - 1 :]
        if n in ORDERS:
            found.append(value[inside])
            of.append(owner[:m][inside])
    ends = np.cumsum(sizes)
    up = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(int(sizes.max(initial=0)), 0x9E3779B97F4A7C15, np.uint64))), dtype=np.uint64)
    within = np.arange(len(codes)) - np.repeat(ends - sizes, sizes)
    whole = np.add.reduceat(codes * up[within + 1], ends - sizes) if len(words) else np.array([], np.uint64)
    found.append(whole)
    of.append(np.arange(len(words)))
    hashed = np.concatenate(found)
    hashed = (hashed ^ (hashed >> np.uint64(31))) * np.uint64(0xFF51AFD7ED558CCD)
    return (hashed >> np.uint64(64 - BITS)).astype(np.int32), np.concatenate(of)


@dataclass
class Model:
    """weights: (features, languages); transitions: (languages, languages); first: of a document's first word."""

    languages: list[str]
    weights: np.ndarray
    transitions: np.ndarray
    first: np.ndarray

    def emissions(self, words: list[str]) -> np.ndarray:
        """Scores of distinct words."""
        feature, of = features(words)
        return np.stack([np.bincount(of, self.weights[feature, k], minlength=len(words)) for k in range(len(self.languages))], axis=1)


class Tagger:
    """Posteriors of words; holds the scores of words met before."""

    def __init__(self, model: Model):
        self.model = model
        self.place: dict[str, int] = {}
        self.scores = np.empty((0, len(model.languages)))

    def _rows(self, words: list[str]) -> np.ndarray:
        if len(self.place) > WORDS_HELD:
            self.place, self.scores = {}, self.scores[:0]
        new = [w for w in set(words) if w not in self.place]
        if new:
            self.place.update(zip(new, range(len(self.scores), len(self.scores) + len(new))))
            own = self.model.emissions(new)
            self.scores = np.concatenate((self.scores, np.exp(np.clip(own - own.max(axis=1, keepdims=True), -30, 0))))
        return np.fromiter(map(self.place.__getitem__, words), np.int64, len(words))

    def posteriors(self, texts: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Posteriors of all words of all texts, one after another, and a number for each distinct word; a text's first word starts anew."""
        flat = [w for words in texts for w in words]
        starts = np.zeros(len(flat), bool)
        sizes = np.fromiter(map(len, texts), np.int64, len(texts))
        starts[(np.cumsum(sizes) - sizes)[sizes > 0]] = True
        rows = self._rows(flat)
        return forward_backward(self.scores[rows], starts, np.exp(self.model.transitions), np.exp(self.model.first)), rows


def forward_backward(psi: np.ndarray, starts: np.ndarray, move: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Posteriors of a long chain of words that starts anew where `starts` says.

    Each word is a matrix (from state to state); the matrices of chunks are multiplied for all chunks at
    once, then chunks are passed one by one, then all chunks are filled in at once.
    """
    n, k = psi.shape
    if not n:
        return psi.copy()
    chunks = -(-n // CHUNK)
    wide = np.ones((chunks * CHUNK, k))
    wide[:n] = psi
    anew = np.zeros(chunks * CHUNK, bool)
    anew[:n] = starts
    anew[n:] = True
    wide, anew = wide.reshape(chunks, CHUNK, k), anew.reshape(chunks, CHUNK)
    into = np.tile(np.eye(k), (chunks, 1, 1))
    for t in range(CHUNK):
        step = (into.reshape(-1, k) @ move).reshape(chunks, k, k)
        step = np.where(anew[:, t, None, None], into.sum(axis=2, keepdims=True) * first, step) * wide[:, None, t]
        into = step / step.sum(axis=(1, 2), keepdims=True)
    ahead, behind = np.empty((chunks, k)), np.empty((chunks, k))
    state = np.full(k, 1 / k)
    for c in range(chunks):
        ahead[c] = state
        state = state @ into[c]
        state /= state.sum()
    state = np.ones(k)
    for c in range(chunks - 1, -1, -1):
        behind[c] = state
        state = into[c] @ state
        state /= state.sum()
    alpha = np.empty((CHUNK, chunks, k))
    state = ahead
    for t in range(CHUNK):
        state = np.where(anew[:, t, None], state.sum(axis=1, keepdims=True) * first, state @ move) * wide[:, t]
        state = state / state.sum(axis=1, keepdims=True)
        alpha[t] = state
    state = behind
    for t in range(CHUNK - 1, -1, -1):
        alpha[t] *= state
        back = state * wide[:, t]
        state = np.where(anew[:, t, None], (back * first).sum(axis=1, keepdims=True), back @ move.T)
        state = state / state.sum(axis=1, keepdims=True)
    out = alpha.transpose(1, 0, 2).reshape(-1, k)[:n]
    return out / out.sum(axis=1, keepdims=True)


def _switched(texts: list[list[str]], labels: np.ndarray, n_languages: int, settings: Settings) -> tuple[list[str], np.ndarray]:
    """Training sequences: spans of documents of changing language."""
    random = np.random.default_rng(17)
    by = [[i for i in range(len(texts)) if labels[i] == k and texts[i]] for k in range(n_languages)]
    usable = [k for k in range(n_languages) if by[k]]
    words, tags = [], []
    sequences = max(settings.sequences, settings.each * len(usable))
    for _ in range(sequences):
        own: list[str] = []
        mark: list[int] = []
        k = usable[random.integers(len(usable))]
        while len(own) < settings.length:
            size = min(1 + int(random.geometric(1 / settings.run)), settings.length - len(own))
            text = texts[by[k][random.integers(len(by[k]))]]
            at = int(random.integers(max(1, len(text) - size + 1)))
            span = text[at : at + size]
            own += span
            mark += [k] * len(span)
            k = usable[random.integers(len(usable))]
        words += own
        tags += mark
    return words, np.array(tags).reshape(sequences, -1)


def fit(texts: list[str | None], languages: list[str], settings: Settings = Settings()) -> Model | None:
    """Train on texts of known language by the gradient of the conditional likelihood; None without any word."""
    names = sorted(set(languages))
    label = np.array([names.index(x) for x in languages], int)
    cut = [words_of(t) for t in texts]
    k = len(names)
    if not any(cut):
        return None
    words, tags = _switched(cut, label, k, settings)
    distinct = sorted(set(words))
    number = {w: i for i, w in enumerate(distinct)}
    row = np.fromiter(map(number.__getitem__, words), np.int64, len(words)).reshape(tags.shape)
    feature, of = features(distinct)
    order = np.argsort(of, kind="stable")
    feature, ends = feature[order], np.cumsum(np.bincount(of, minlength=len(distinct)))
    weights, speed = np.zeros((1 << BITS, k)), np.full((1 << BITS, k), 1e-6)
    move, first = np.zeros((k, k)), np.zeros(k)
    move_speed, first_speed = np.full((k, k), 1e-6), np.full(k, 1e-6)
    batch = 250
    for epoch in range(settings.epochs):
        for a in range(0, len(tags), batch):
            rows, own = row[a : a + batch], tags[a : a + batch]
            used, inverse = np.unique(rows, return_inverse=True)
            sizes = np.diff(np.concatenate((np.zeros(1, np.int64), ends)))[used]
            at = np.repeat(ends[used] - sizes, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            held, owner = feature[at], np.repeat(np.arange(len(used)), sizes)
            emission = np.stack([np.bincount(owner, weights[held, j], minlength=len(used)) for j in range(k)], axis=1)
            score = emission[inverse.reshape(rows.shape)]
            slope, slope_move, slope_first = slopes(score, own, move, first)
            by_word = np.stack([np.bincount(inverse.reshape(-1), slope[..., j].reshape(-1), minlength=len(used)) for j in range(k)], axis=1)
            touched, place = np.unique(held, return_inverse=True)
            step = np.stack([np.bincount(place, by_word[owner, j], minlength=len(touched)) for j in range(k)], axis=1) / len(rows) - settings.decay * weights[touched]
            speed[touched] += step**2
            weights[touched] += settings.rate * step / np.sqrt(speed[touched])
            for value, pace, turn in ((move, move_speed, slope_move / len(rows)), (first, first_speed, slope_first / len(rows))):
                pace += turn**2
                value += settings.rate * turn / np.sqrt(pace)
    return Model(names, weights, move, first)


def held_out(key: str = "doc_id"):
    """crc32(doc_id as text) mod 4 is 2; never trained on. A null id is not held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(docs: DataFrame, settings: Settings = Settings()) -> Model | None:
    """Fit on documents of known language that are not held out, at most settings.sample of each language and about settings.total of all; their texts reach the driver. An id that has several languages or texts counts with the first of each."""
    known = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("lang").cast("string").alias("lang")).where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out())
    bound = max(1, min(settings.sample, settings.total // max(1, known.select("lang").distinct().count())))
    # ranks up to a bound are cut off in each task, before the shuffle, so a common language isn't one task's
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id"), "doc_id")
    picked = known.withColumn("_rank", F.row_number().over(first)).where(F.col("_rank") <= bound)
    sample = picked.groupBy("doc_id").agg(F.min("lang").alias("lang"))
    rows = id_text(docs).join(F.broadcast(sample), "doc_id").groupBy("doc_id", "lang").agg(F.min("text").alias("text")).collect()
    rows = sorted(((r["doc_id"], r["lang"], r["text"] or "") for r in rows))
    return fit([r[2] for r in rows], [r[1] for r in rows], settings)


def _names(model: Model, tagger: Tagger, texts: list[str | None]) -> tuple[list[str], list[float]]:
    cut = [words_of(t) for t in texts]
    marginal, row = tagger.posteriors(cut)
    sizes = np.fromiter(map(len, cut), np.int64, len(cut))
    text_of = np.repeat(np.arange(len(cut)), sizes)
    _, place, times = np.unique(text_of << 32 | row, return_inverse=True, return_counts=True)
    weight = 1 / times[place]
    total = np.stack([np.bincount(text_of, marginal[:, k] * weight, minlength=len(cut)) for k in range(len(model.languages))], axis=1)
    mean = total / np.maximum(np.bincount(text_of, weight, minlength=len(cut)), 1e-9)[:, None]
    best = mean.argmax(axis=1)
    names = [model.languages[k] if n else UNKNOWN for k, n in zip(best, sizes)]
    return names, [float(min(1.0, mean[i, best[i]])) if n else 0.0 for i, n in enumerate(sizes)]


def identify(docs: DataFrame, settings: Settings = Settings()) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row, from the whole text alone.

    Texts that are null or have no letter are `und` with score 0, and so is every text where no language
    could be learned. Rows that repeat are judged alike. An empty table gives an empty result.
    """
    model = train(docs, settings)
    if model is None:
        rows = id_text(docs).select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"))
    else:
        at = np.flatnonzero(model.weights.any(axis=1)).astype(np.int32)
        shared = docs.sparkSession.sparkContext.broadcast((model.languages, at, model.weights[at].astype(np.float32), model.transitions, model.first))

        def setup() -> Tagger:
            languages, place, value, move, first = shared.value
            weights = np.zeros((1 << BITS, len(languages)), np.float32)
            weights[place] = value
            return Tagger(Model(languages, weights, move, first))

        def of(part: pa.RecordBatch, tagger: Tagger) -> dict:
            names, scores = _names(tagger.model, tagger, part.column("text").to_pylist())
            return {"doc_id": part.column("doc_id"), "lang_pred": names, "score": scores}

        rows = map_rows(id_text(docs), "text", of, "doc_id long, lang_pred string, score double", setup)
    return rows.select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def word_languages(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, words, languages: the language of every word, by the greatest posterior."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def of(part: pa.RecordBatch, tagger: Tagger) -> dict:
        cut = [words_of(t) for t in part.column("text").to_pylist()]
        best, at, tags = tagger.posteriors(cut)[0].argmax(axis=1), 0, []
        for words in cut:
            tags.append([tagger.model.languages[k] for k in best[at : at + len(words)]])
            at += len(words)
        return {"doc_id": part.column("doc_id"), "words": cut, "languages": tags}

    return map_rows(id_text(docs), "text", of, "doc_id long, words array<string>, languages array<string>", lambda: Tagger(shared.value))
