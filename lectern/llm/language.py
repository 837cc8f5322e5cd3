"""Language identification: first the language family, then one-versus-one linear SVMs within it."""

from __future__ import annotations

from collections import Counter
from collections.abc import Mapping
from itertools import combinations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import small_batches
from .tokens import forget, lean
from .vec import U64, chunks, text_buffers

#: Families of ISO 639-1 codes (fixed values); a language that isn't listed is a family of its own.
FAMILIES = {
    "germanic": "af da de en fo is lb nl nn no sv yi",
    "romance": "ca es fr gl it la oc pt ro",
    "slavic": "be bg bs cs hr mk pl ru sk sl sr uk",
    "uralic": "et fi hu",
    "baltic": "lt lv",
    "turkic": "az kk ky tr tt uz",
    "semitic": "am ar he mt",
    "indic": "as bn gu hi mr ne pa sa si ur",
    "dravidian": "kn ml ta te",
    "iranian": "fa ku ps tg",
}

GRAMS = (2, 3, 4)
DIM = 1 << 15
#: ASCII letters as they are, other ASCII as a space, bytes of other characters as they are.
_LETTER = np.array([c if c >= 0x80 or chr(c).isalpha() else 0x20 for c in range(256)], np.uint8)
_MULTIPLIERS = {2: 0x9E3779B1, 3: 0x85EBCA77C2B2AE63, 4: 0xC2B2AE3D27D4EB4F}


def gram_places(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For lower-cased bytes: a (grams, bytes) array of hashed n-gram numbers (0: none starts here), and new offsets.

    Runs of anything but letters count as one space.
    """
    d = _LETTER[data]
    keep = np.ones(len(d), bool)
    keep[1:] = (d[1:] != 0x20) | (d[:-1] != 0x20)
    off = np.concatenate([[0], np.cumsum(keep)])[off]
    d = d[keep].astype(np.uint64)
    n, out = len(d), np.zeros((len(GRAMS), len(d)), np.int64)
    left = np.repeat(off[1:], np.diff(off)) - np.arange(n)  # bytes to the document's end
    for g, size in enumerate(GRAMS):
        m = n - size + 1
        if m > 0:
            code = d[:m].copy()
            for k in range(1, size):
                code = code << U64(8) | d[k : k + m]
            h = ((code * U64(_MULTIPLIERS[size])) ^ ((code * U64(_MULTIPLIERS[size])) >> U64(29))) * U64(0x9E3779B97F4A7C15) >> U64(64 - 15)
            out[g, :m] = np.where(left[:m] >= size, h.astype(np.int64) + g * DIM + 1, 0)
    return out, off


def _lower(col):
    return pc.utf8_lower(col.cast(pa.large_string()))


def _features(batches):
    """lang, and the distinct hashed n-grams of each text with their shares, as binary arrays."""
    for b in batches:
        data, off = text_buffers(_lower(b.column("text")))
        at, val = [], []
        for i, j in chunks(off, 1 << 19):
            places, o = gram_places(data[off[i] : off[j]], off[i : j + 1] - off[i])
            for s, e in zip(o[:-1], o[1:]):
                k, n = np.unique(places[:, s:e], return_counts=True)
                n = n[k > 0]
                k = k[k > 0]
                at.append(k.astype("<i4").tobytes())
                val.append((n / max(1, n.sum())).astype("<f4").tobytes())
        yield pa.RecordBatch.from_arrays([b.column("lang"), pa.array(at, pa.binary()), pa.array(val, pa.binary())], names=["lang", "at", "val"])


def linear_svm(at: np.ndarray, val: np.ndarray, row: np.ndarray, y: np.ndarray, dim: int, c: float = 300.0, steps: int = 60) -> np.ndarray:
    """Weights of a squared-hinge linear SVM (the last one is the bias) by accelerated gradient descent.

    Row i of the sparse matrix has val[k] at at[k] for row[k] == i; y is -1 or 1. Each class has half of the weight.
    """
    n = len(y)
    share = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    scale = np.sqrt(np.bincount(at, val * val, dim) / n) + 1e-4  # each feature in units of its size
    val = val / scale[at]
    norms = np.bincount(row, val * val, n) + 1
    step = 1.0 / (1.0 / c + 2 * float((share * norms).sum()))
    w, v, t = np.zeros(dim + 1), np.zeros(dim + 1), 1.0
    for _ in range(steps):
        slack = np.maximum(0, 1 - y * (np.bincount(row, val * v[at], n) + v[dim]))
        g = -2 * share * y * slack
        grad = v / c
        grad[:dim] += np.bincount(at, val * g[row], dim)
        grad[dim] += g.sum()
        new, t2 = v - step * grad, (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, w, t = new + (t - 1) / t2 * (new - w), new, t2
    w[:dim] /= scale
    return w


def platt(margin: np.ndarray, y: np.ndarray) -> float:
    """The slope of a logistic curve through 0 that fits the margins best, by Newton's method."""
    a = 1.0
    for _ in range(30):
        p = 1 / (1 + np.exp(-np.clip(a * margin, -30, 30)))
        g, h = ((p - (y > 0)) * margin).sum(), (p * (1 - p) * margin * margin).sum()
        a = float(np.clip(a - g / (h + 1e-9), 0.1, 50))
    return a


#: Grams that a short text's likeness to a language is widened by, and how often the likeness may be that of one text in a hundred.
_WIDEN, _FAR = 200, 4.0
#: Bytes of weights, which every task holds; they grow with the square of the languages of a family and of the families.
MOST_MODEL_BYTES = 256 << 20


class Model:
    """Languages with their families, a weight column for each pair of families and of languages of one family, and a profile of each language.

    A profile is a column of log shares of n-grams, with the mean over the language's texts (`usual`) and how far below
    it a text may be (`limit`, for a long one): a text whose n-grams are as rare as that is in another language.
    """

    def __init__(self, languages: list[str], family: Mapping[str, str], columns: list[tuple], weights: np.ndarray, bias: np.ndarray, slope: np.ndarray, usual: np.ndarray, limit: np.ndarray):
        self.languages, self.family, self.columns, self.weights, self.bias, self.slope = languages, dict(family), columns, weights, bias, slope
        self.usual, self.limit = usual, limit

    def familiar(self, lang: list, mean: np.ndarray, grams: np.ndarray) -> np.ndarray:
        """0 to 1, a half at the limit: how well the texts' n-grams, by their mean log shares, fit the languages."""
        of = np.array([self.languages.index(x) for x in lang], np.int64)
        far = (self.usual[of] - mean[np.arange(len(of)), of]) / np.sqrt(1 + _WIDEN / np.maximum(1, grams))
        return 1 / (1 + np.exp(np.clip(6 * (far / self.limit[of] - 1), -30, 30)))

    def decide(self, margins: np.ndarray) -> tuple[list, np.ndarray]:
        """The language and score of each row of margins (one for each column)."""
        n = len(margins)
        p = 1 / (1 + np.exp(-np.clip(margins * self.slope, -30, 30)))
        families = sorted(set(self.family.values()))

        def winners(names: list[str], level: str) -> tuple[np.ndarray, np.ndarray]:
            if len(names) == 1:
                return np.zeros(n, np.int64), np.ones(n)
            votes, least = np.zeros((n, len(names))), np.ones((n, len(names)))
            for k, (kind, a, b) in enumerate(self.columns):
                if kind == level and a in names and b in names:
                    i, j = names.index(a), names.index(b)
                    votes[:, i] += (p[:, k] >= 0.5) + p[:, k] * 1e-3
                    votes[:, j] += (p[:, k] < 0.5) + (1 - p[:, k]) * 1e-3
                    least[:, i], least[:, j] = np.minimum(least[:, i], p[:, k]), np.minimum(least[:, j], 1 - p[:, k])
            best = votes.argmax(1)
            return best, least[np.arange(n), best]

        fam, p_fam = winners(families, "family")
        lang, score = np.full(n, None, object), np.zeros(n)
        for f, name in enumerate(families):
            own = [x for x in self.languages if self.family[x] == name]
            best, p_lang = winners(own, "language")
            mine = fam == f
            lang[mine], score[mine] = np.array(own, object)[best[mine]], (p_fam * p_lang)[mine]
        return lang.tolist(), score


def families_of(languages: list[str]) -> dict[str, str]:
    known = {x: f for f, xs in FAMILIES.items() for x in xs.split()}
    return {x: known.get(x, x) for x in languages}


def _sample(labelled: DataFrame, most: int) -> DataFrame:
    """lang and text: of each language the `most` distinct texts of the least hashes, or all that there are.

    Hashes alone are counted and ranked; texts are shuffled only if they are chosen, a text's copies as one.
    """
    keyed = labelled.select("lang", "text", F.xxhash64("text").alias("h"))
    counts = {r["lang"]: r["n"] for r in keyed.groupBy("lang").agg(F.approx_count_distinct("h").alias("n")).collect()}
    if not counts:
        return labelled
    # some twice as many as are wanted, so that an estimate's error costs none
    top = {k: (1 << 63) - 1 if n <= 4 * most else int((1 << 64) * (2 * most / n)) - (1 << 63) for k, n in counts.items()}
    near = F.col("h") <= F.element_at(F.create_map(*[x for k, v in top.items() for x in (F.lit(k), F.lit(v).cast("long"))]), F.col("lang"))
    place = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    chosen = keyed.where(near).select("lang", "h").distinct().withColumn("place", place).where(F.col("place") <= most).select("lang", "h")
    return keyed.where(near).join(F.broadcast(chosen), ["lang", "h"]).dropDuplicates(["lang", "h"]).select("lang", "text")


def fit(labelled: DataFrame, rows_per_language: int = 300, family: Mapping[str, str] | None = None) -> Model | None:
    """A model of labelled texts (text, lang), None if no row has both.

    It is fitted on `rows_per_language` whole distinct texts of each language, those of the least hashes (all, if there
    are fewer), so no language is lost and copies count once; those texts' n-gram counts are the only thing gathered on
    the driver.  Scores are calibrated by margins of texts that the weights were not fitted on, two halves crosswise.
    """
    labelled = small_batches(labelled).select("text", "lang").where("text IS NOT NULL AND lang IS NOT NULL")
    rows = _sample(labelled, rows_per_language).mapInArrow(lean(_features), "lang string, at binary, val binary").collect()
    rows.sort(key=lambda r: (r["lang"], r["at"]))
    languages = sorted({r["lang"] for r in rows})
    if not languages:
        return None
    family = dict(family or families_of(languages))
    sizes = Counter(family[x] for x in languages)
    dim = len(GRAMS) * DIM + 1
    if 4 * dim * (len(sizes) ** 2 // 2 + sum(n * n // 2 + n for n in sizes.values())) > MOST_MODEL_BYTES:
        raise ValueError(f"{len(languages)} languages in {len(sizes)} families need more than {MOST_MODEL_BYTES} bytes of weights; name larger families")
    lang = np.array([languages.index(r["lang"]) for r in rows])
    size = np.array([len(r["at"]) // 4 for r in rows])
    at = np.frombuffer(b"".join(r["at"] for r in rows), "<i4")
    val = np.frombuffer(b"".join(r["val"] for r in rows), "<f4")
    row = np.repeat(np.arange(len(rows), dtype=np.int32), size)
    half = np.arange(len(rows)) % 2
    rows.clear()
    fam = np.array([family[x] for x in languages])[lang]
    columns, weights, bias, slope = [], [], [], []

    def learn(kind: str, a: str, b: str, of: np.ndarray) -> None:
        use = (of == a) | (of == b)
        y = np.where(of == a, 1.0, -1.0)

        def svm(part: np.ndarray) -> np.ndarray:
            new, k = np.cumsum(part, dtype=np.int32) - 1, part[row]
            return linear_svm(at[k], val[k], new[row[k]], y[part], dim)

        w, margin, seen = svm(use), np.zeros(len(use)), np.zeros(len(use), bool)
        for h in (0, 1):
            other, own = use & (half != h), use & (half == h)
            if len(set(y[other].tolist())) == 2:
                v, k = svm(other), own[row]
                margin += own * (np.bincount(row[k], val[k] * v[at[k]], len(use)) + v[dim])
                seen |= own
        columns.append((kind, a, b))
        weights.append(w[:dim])
        bias.append(w[dim])
        slope.append(platt(margin[seen], y[seen]) if seen.any() else 1.0)

    for a, b in combinations(sorted(set(fam.tolist())), 2):
        learn("family", a, b, fam)
    name = np.array(languages, object)[lang]
    for f in sorted(set(fam.tolist())):
        for a, b in combinations([x for x in languages if family[x] == f], 2):
            learn("language", a, b, name)
    usual, limit = np.zeros(len(languages)), np.ones(len(languages))
    grams = np.maximum(1.0, 1 / np.maximum(1e-9, np.minimum.reduceat(val, np.cumsum(size) - size))) if len(val) and size.all() else np.ones(len(size))
    for i in range(len(languages)):
        own, far = np.flatnonzero(lang == i), []
        for h in (0, 1):  # one half's profile, the other's likeness to it
            one, two = own[half[own] != h], own[half[own] == h]
            log = _profile(at, val, row, one if len(one) else own, dim)
            k = np.isin(row, two)
            far.append((two, np.bincount(row[k], val[k] * log[at[k]], len(lang))[two]))
        who, mean = (np.concatenate(x) for x in zip(*far))
        usual[i] = np.median(mean)
        limit[i] = max(0.5, _FAR * np.quantile((usual[i] - mean) / np.sqrt(1 + _WIDEN / grams[who]), 0.99))
        weights.append(_profile(at, val, row, own, dim))
    del at, val, row
    forget()
    return Model(languages, family, columns, np.ascontiguousarray(np.array(weights).T, np.float32), np.array(bias), np.array(slope), usual, limit)


def _profile(at: np.ndarray, val: np.ndarray, row: np.ndarray, texts: np.ndarray, dim: int) -> np.ndarray:
    """Logarithms of the mean shares of n-grams in some texts, unseen ones at a millionth."""
    k = np.isin(row, texts)
    log = np.log(np.bincount(at[k], val[k], dim)[:dim] / max(1, len(texts)) + 1e-6)
    log[0] = 0
    return log


def _judged(b: pa.RecordBatch, model: Model | None) -> tuple[list, np.ndarray]:
    """The language and score of each text of a batch."""
    text = b.column("text")
    letters = pc.fill_null(pc.match_substring_regex(text, r"\p{L}"), False).to_numpy(zero_copy_only=False)
    lang, score = ["und"] * b.num_rows, np.zeros(b.num_rows)
    if model is not None:
        data, off = text_buffers(_lower(text))
        pairs = len(model.columns)
        for i, j in chunks(off, 1 << 18):
            places, o = gram_places(data[off[i] : off[j]], off[i : j + 1] - off[i])
            each = sum((model.weights[p] for p in places[1:]), model.weights[places[0]])
            total = np.concatenate([np.zeros((1, each.shape[1])), np.cumsum(each, axis=0, dtype=np.float64)])
            grams = np.concatenate([[0], np.cumsum((places > 0).sum(0))])
            margin = (total[o[1:]] - total[o[:-1]]) / np.maximum(1, np.diff(grams[o]))[:, None]
            own, p = model.decide(margin[:, :pairs] + model.bias)
            lang[i:j], score[i:j] = own, p * model.familiar(own, margin[:, pairs:], np.diff(grams[o]))
    return [x if ok else "und" for x, ok in zip(lang, letters)], np.where(letters, score, 0.0)


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """doc_id, lang_pred and score (0 to 1) of every whole text.

    A text that is null or has no letter is `und` with score 0; so is any text if there is no model.  Repeated rows
    are predicted each for itself, a null doc_id stays null, and other columns are neither read nor returned.
    """

    def run(batches):
        for b in batches:
            lang, score = _judged(b, model)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(lang, pa.string()), pa.array(score)], names=["doc_id", "lang_pred", "score"])

    return small_batches(docs).select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(lean(run), "doc_id long, lang_pred string, score double")


def accepted(docs: DataFrame, model: Model | None, least: float = 0.3) -> DataFrame:
    """The rows of `docs`, all columns, but for those that are `und` or in no learned language: whose score is below `least`."""

    def run(batches):
        for b in batches:
            lang, score = _judged(b, model)
            yield b.filter(pa.array(np.array([x != "und" for x in lang], bool) & (score >= least)))

    return small_batches(docs).mapInArrow(lean(run), docs.schema)


def held_out(folds: int = 5):
    """True for the fold that is never learned from: crc32 of doc_id as text is divisible by `folds` (a null doc_id: false)."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == 0, F.lit(False))


def identify(docs: DataFrame, rows_per_language: int = 300) -> DataFrame:
    """Learn from all but the held-out fold, then predict every text: doc_id, held_out, lang_pred, score."""
    model = fit(docs.where(~held_out()), rows_per_language)
    return predict(docs, model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
