"""Language identification by interpolated Kneser-Ney character models.

A language's model has the n-grams of its words (lower case, a mark for the word's beginning and end; a context ends at the
beginning of the word). All models lie in one array of sorted 64-bit hashes, one entry for each n-gram that any language has,
with two rows of numbers: the discounted probability of the n-gram, and the weight that it leaves to shorter n-grams when it is a
context. The language with the lowest cross-entropy a character is chosen; a text whose cross-entropy lies beyond what
calibration texts of that language show is rejected.
"""

from __future__ import annotations

import uuid
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import held, small_batches, written
from .units import Units, _Rows

#: Bound of what a model is fitted to: documents of each language, a quarter of them for calibration. Nothing else is bounded.
SAMPLE_DOCS = 560
ORDER = 5
#: Languages that are learned at most: those with most labelled texts.
MOST_LANGS = 200
#: Units of text that a worker remembers at most, and costs of these; a cost is a whole number of steps.
MOST_TOKENS, MOST_CELLS, STEPS = 600_000, 4_000_000, 1 << 20
UNKNOWN = "und"
#: A mean over n characters strays by this, divided by the root of n, before a text is rejected: a key or a number makes much of a short text.
STRAY = 15.0
_MUL, _EDGE = np.uint64(0x9E3779B97F4A7C15), 32
_LETTERS = regex.compile(r"\p{L}+")


def grams(words: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """([n - 1, position] hashes of the n-grams that end at each position, [position] depth in its word) of all words with their marks.

    Where a word is shorter than n, the hash is 0.
    """
    text = "".join(f" {w} " for w in words)
    code = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    length = np.fromiter((len(w) + 2 for w in words), np.int64, len(words))
    depth = np.arange(len(code)) - np.repeat(np.cumsum(length) - length, length)
    out = np.zeros((order, len(code)), dtype=np.uint64)
    h = np.zeros(len(code), dtype=np.uint64)
    power = np.uint64(1)
    with np.errstate(over="ignore"):
        mixed = (code + np.uint64(1)) * _MUL
        mixed ^= mixed >> np.uint64(29)
        mixed *= np.uint64(0xBF58476D1CE4E5B9)
        mixed ^= mixed >> np.uint64(32)
        for n in range(order):
            h[n:] = h[n:] + mixed[: len(code) - n] * power
            power *= np.uint64(0xD6E8FEB86659FD93)
            x = h + np.uint64(n + 1) * _MUL
            x = (x ^ (x >> np.uint64(30))) * np.uint64(0x94D049BB133111EB)
            out[n] = np.where(depth >= n, (x ^ (x >> np.uint64(31))) | np.uint64(1), np.uint64(0))
    return out, depth


def trained(texts: list[str], order: int = ORDER) -> pd.DataFrame:
    """The model of one language as rows (hash, share, rest): the discounted probability of an n-gram, and the weight it leaves as a context."""
    count = Counter(w for t in texts for w in _LETTERS.findall(t.lower()))
    if not count:
        return pd.DataFrame({"hash": np.zeros(0, np.int64), "share": np.zeros(0), "rest": np.zeros(0)})
    words = sorted(count)
    h, depth = grams(words, order)
    times = np.repeat(np.fromiter((count[w] for w in words), np.int64, len(words)), [len(w) + 2 for w in words])
    predicted = depth > 0
    share: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    rest: list[tuple[np.ndarray, np.ndarray]] = []
    for n in range(order, 0, -1):
        full = predicted & (depth >= n - 1)
        at = np.flatnonzero(full)
        if not len(at):
            continue
        keys, first, inverse = np.unique(h[n - 1, at], return_index=True, return_inverse=True)
        raw = np.bincount(inverse, weights=times[at])
        if n < order:
            # How many characters come before it; n-grams at the beginning of a word have none before and keep their counts.
            begins = depth[at[first]] == n - 1
            longer = np.flatnonzero(predicted & (depth >= n))
            pairs, one = np.unique(h[n, longer], return_index=True)
            before = np.bincount(np.searchsorted(keys, h[n - 1, longer[one]]), minlength=len(keys))
            use = np.where(begins, raw, np.maximum(before, 1))
        else:
            use = raw
        ones, twos = (use == 1).sum(), (use == 2).sum()
        off = min(0.95, max(0.05, ones / (ones + 2 * twos))) if ones else 0.5
        context = h[n - 2, at[first] - 1] if n > 1 else np.zeros(len(keys), np.uint64)
        contexts, of = np.unique(context, return_inverse=True)
        total, kinds = np.bincount(of, weights=use), np.bincount(of)
        share[n] = (keys, (use - off) / total[of])
        rest.append((contexts, off * kinds / total))
    keys = np.concatenate([k for k, _ in share.values()])
    alpha = pd.Series(np.concatenate([v for _, v in share.values()]), index=keys)
    gamma = pd.Series(np.concatenate([v for _, v in rest]), index=np.concatenate([k for k, _ in rest]))
    both = pd.DataFrame({"share": alpha, "rest": gamma})
    return pd.DataFrame({"hash": both.index.to_numpy(np.uint64).view(np.int64), "share": both["share"].fillna(0.0).to_numpy(), "rest": both["rest"].fillna(1.0).to_numpy()})


class Models:
    """The models of all languages in one array of sorted hashes."""

    def __init__(self, langs: list[str], rows: pd.DataFrame, order: int = ORDER, signs: int = 1 << 10) -> None:
        self.langs, self.order = langs, order
        keys, at = np.unique(rows["hash"].to_numpy(np.int64).view(np.uint64), return_inverse=True)
        which = rows["lang"].map({x: i for i, x in enumerate(langs)}).to_numpy(np.int64) if len(rows) else np.zeros(0, np.int64)
        self.keys = keys
        self.share, self.rest = np.zeros((len(keys) + 1, len(langs)), np.float32), np.ones((len(keys) + 1, len(langs)), np.float32)
        self.share[at, which], self.rest[at, which] = rows["share"], rows["rest"]
        # The empty context has hash 0.
        zero = np.flatnonzero(keys == 0)
        self.root = self.rest[zero[0]] if len(zero) else np.ones(len(langs), np.float32)
        self.floor = 1.0 / signs
        self.scale, self.most = 20.0, np.full(len(langs), np.inf)
        self.key = uuid.uuid4().hex
        self.memory: _Tokens | None = None

    def __getstate__(self) -> dict:
        return {**self.__dict__, "memory": None}

    def find(self, hashes: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.keys, hashes)
        at[at == len(self.keys)] = 0
        return np.where((self.keys[at] == hashes) & (hashes != 0), at, len(self.keys)) if len(self.keys) else np.zeros(len(hashes), np.int64)

    def costs(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """[word, language] the sum of minus log probability over a word's characters and its end, and [word] how many they are."""
        if not words:
            return np.zeros((0, len(self.langs))), np.zeros(0, np.int64)
        h, depth = grams(words, self.order)
        to = np.flatnonzero(depth > 0)
        p = np.full((len(to), len(self.langs)), self.floor, dtype=np.float32) * self.root
        found = self.find(h[0])
        p += self.share[found[to]]
        for n in range(1, self.order):
            before, found = found, self.find(h[n])
            deep = np.flatnonzero(depth[to] >= n)
            at = to[deep]
            p[deep] = self.share[found[at]] + self.rest[before[at - 1]] * p[deep]
        cost = -np.log(p)
        length = np.fromiter((len(w) + 1 for w in words), np.int64, len(words))
        return np.add.reduceat(cost, np.cumsum(length) - length, axis=0), length

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """[text, language] cross-entropy a character over the whole text, and [text] the number of characters (0: no letter)."""
        if self.memory is None:
            self.memory = _Tokens(self)
        return self.memory.entropies(texts)

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray]:
        """(language, score, cross-entropy, rejected) of each text. The score is the chosen language's share under the calibrated scale."""
        h, n = self.entropies(texts)
        if not self.langs:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.full(len(texts), np.nan), np.ones(len(texts), bool)
        best = h.argmin(axis=1)
        low = h.min(axis=1)
        score = 1.0 / np.exp(-self.scale * (h - low[:, None])).sum(axis=1)
        none = n == 0
        lang = [UNKNOWN if x else self.langs[i] for x, i in zip(none.tolist(), best.tolist(), strict=True)]
        return lang, np.where(none, 0.0, score), np.where(none, np.nan, low), none | (low > self.most[best] + STRAY / np.sqrt(np.maximum(n, 1)))

    def calibrate(self, texts: list[str], langs: list[str]) -> None:
        """Sets the scale with the least log loss, and for each language the cross-entropy beyond which a text is rejected: well above what its calibration texts show, by quantiles that a few odd texts among them do not move."""
        h, n = self.entropies(texts)
        ok = n > 0
        h, truth = h[ok], np.asarray([self.langs.index(x) for x, k in zip(langs, ok, strict=True) if k], dtype=np.int64)
        if not len(h):
            return
        off = h - h.min(axis=1)[:, None]
        loss = lambda b: float(np.mean(b * off[np.arange(len(off)), truth] + np.log(np.exp(-b * off).sum(axis=1))))
        self.scale = min((float(2.0**k) for k in range(-1, 9)), key=loss)
        best = h.argmin(axis=1)
        for i in range(len(self.langs)):
            own = h[best == i, i]
            if len(own):
                low, mid, high = np.quantile(own, [0.25, 0.5, 0.9])
                self.most[i] = max(high * 1.5, mid + 8 * (mid - low))


class _Tokens:
    """The costs of units of text, by number; sums of whole steps, so they do not depend on the order. No unit splits a run of letters."""

    def __init__(self, models: Models) -> None:
        self.models = models
        self.cost, self.length = _Rows(np.int64, max(1, len(models.langs))), _Rows(np.int64)
        self.units = Units(self._learn, self._kept, min(MOST_TOKENS, max(1, MOST_CELLS // max(1, len(models.langs)))))

    def _learn(self, units: list[str]) -> None:
        words = [_LETTERS.findall(t) for t in units]
        cost, length = self.models.costs([w for ws in words for w in ws])
        ends = np.cumsum([len(ws) for ws in words])
        begins = np.concatenate([[0], ends[:-1]])
        steps = np.zeros((len(cost) + 1, max(1, len(self.models.langs))), np.int64)
        steps[1:, : cost.shape[1]] = np.cumsum(np.rint(cost * STEPS).astype(np.int64), axis=0)
        length = np.concatenate([[0], np.cumsum(length)])
        self.cost.add(steps[ends] - steps[begins])
        self.length.add(length[ends] - length[begins])

    def _kept(self, stay: np.ndarray) -> None:
        self.cost.keep(self.cost.all[stay])
        self.length.keep(self.length.all[stay])

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        k = len(self.models.langs)
        sums, n = np.zeros((len(texts), k), np.int64), np.zeros(len(texts), np.int64)
        for numbers, of in self.units.walk(pa.array([None if t is None else t.lower() for t in texts], pa.large_string())):
            first = np.flatnonzero(np.concatenate([[True], of[1:] != of[:-1]]))
            sums[of[first]] += np.add.reduceat(self.cost.all[numbers], first, axis=0)[:, :k]
            n[of[first]] += np.add.reduceat(self.length.all[numbers], first)
        return sums / STEPS / np.maximum(n, 1)[:, None], n


def fit(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample_docs: int = SAMPLE_DOCS, order: int = ORDER, most_langs: int = MOST_LANGS) -> Models:
    """Models from a bounded sample of the labelled rows, the same in each run: of each language the ``sample_docs`` pairs of id and
    text with the smallest hashes; whole texts. Every fourth of them serves for calibration. Rows without language or without a letter in the text do not
    count; rows that repeat an id and a text count once; a null or a repeated id is like any other. Of more than ``most_langs`` languages those with most such
    texts are learned, of equals the first by name. The models are trained in parallel; what comes to the driver are the models and the calibration
    texts, both bounded by these parameters. An empty table gives models that know no language.
    """
    place = F.shiftrightunsigned("h", 11) / float(1 << 53)
    rows = labelled.where(F.col(lang_col).isNotNull() & F.col(text_col).rlike(r"\p{L}")).select(F.col(lang_col).alias("lang"), F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("h", F.xxhash64("id", "text"))
    # One row a language. Only about three times as many texts of a language as are wanted are ranked, by their hashes, however many there are.
    counts = rows.groupBy("lang").agg(F.approx_count_distinct("h", 0.05).alias("texts")).orderBy(F.desc("texts"), "lang").limit(most_langs)
    counts = written(counts.select("lang", (3.0 * sample_docs / F.col("texts")).alias("part")), "op3-languages")
    near = rows.join(F.broadcast(counts), "lang").where(place < F.col("part")).groupBy("lang", "h").agg(F.min(F.struct("id", "text")).alias("r"))
    # The window goes by the same hash without its sign, so those with the smallest are all there.
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.shiftrightunsigned("h", 11), "h"))
    sample = written(near.withColumn("n", rank).where(F.col("n") <= sample_docs).select("lang", "n", F.col("r.text").alias("text")), "op3-sample")
    model = sample.where(F.col("n") % 4 != 0).groupBy("lang").applyInPandas(lambda key, x: trained(x.sort_values("n")["text"].tolist(), order).assign(lang=key[0]), "hash long, share double, rest double, lang string")
    rows_of = model.toPandas()
    held = sample.where(F.col("n") % 4 == 0).orderBy("lang", "n").toPandas()
    models = Models(sorted(set(rows_of["lang"])), rows_of, order)
    if models.langs:
        held = held[held["lang"].isin(models.langs)]
        models.calibrate(held["text"].tolist(), held["lang"].tolist())
        models.memory = None
    return models


def identified(docs: DataFrame, models: Models, text_col: str = "text") -> DataFrame:
    """``docs`` with lang_pred, lang_score, lang_entropy and lang_rejected.

    A text that is null or has no letter is ``und``, has score 0 and is rejected. Whole texts are read. Each row is judged by itself,
    so repeated rows get equal results; ties between languages go to the first by name. Columns of ``docs`` that have the names of the
    new columns are replaced. The models are broadcast; their size is bounded by the training parameters.
    """
    small_batches(docs.sparkSession)
    shipped = docs.sparkSession.sparkContext.broadcast(models)
    key = models.key
    docs = docs.drop("lang_pred", "lang_score", "lang_entropy", "lang_rejected")
    names = docs.columns
    at = names.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = held(f"languages-{key}", lambda: shipped.value)
        for batch in batches:
            lang, score, low, rejected = own.predict(batch.column(at).to_pylist())
            new = [pa.array(lang, pa.string()), pa.array(score, pa.float64()), pa.array(low, pa.float64(), from_pandas=True), pa.array(rejected, pa.bool_())]
            yield pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*names, "lang_pred", "lang_score", "lang_entropy", "lang_rejected"])

    more = "lang_pred string, lang_score double, lang_entropy double, lang_rejected boolean"
    return docs.mapInArrow(run, ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema), more]))


def held_out(id_col: str = "doc_id"):
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op3_query(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score, and lang_entropy and lang_rejected besides."""
    rows = docs.select("doc_id", "text", "lang").withColumn("held_out", held_out())
    models = fit(rows.where(~F.col("held_out")))
    return identified(rows.select("doc_id", "held_out", "text"), models).select("doc_id", "held_out", "lang_pred", F.col("lang_score").alias("score"), "lang_entropy", "lang_rejected")
