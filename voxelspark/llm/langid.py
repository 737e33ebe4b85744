"""Language identification by interpolated Kneser-Ney models over characters, one for each language.

Fitting: the n-grams of a bounded sample of labelled texts (`sample` texts of each language, those with the least hash of
their id) are counted in Spark; the counts, bounded by the sample, make the models. They are kept in sorted arrays of
64-bit n-gram hashes with one column of log probabilities for each language, found by binary search. An n-gram that no
language has seen falls back to the weight of its context and the next shorter n-gram.

Prediction: the language with the lowest cross-entropy per character over the whole text. A fifth of the sample is kept
from the counts to calibrate rejection. What counts is how far a text's entropy lies above its language's median, on a scale
that widens for short texts. Texts two thirds of the way to even noise over the alphabet are noise and do not calibrate. Of the
others, the distance that all but a share of `reject` keep (the furthest, if there are too few to tell) times `margin` is the
limit of its language and length band (up to 64 letters, up to 512, more), never more than the bound of noise. Bands with under
20 such texts take all of their language's; a language with under 20 has the bound of noise alone, from their lower median or
the median of all languages, whichever is higher (from the texts it was fitted on if no language has any). A text most of whose
letters no language has seen is rejected too, and its score is lowered by that share. Map-only: nothing is shuffled.

Texts are lower-cased letters; runs of anything else are one space. Nulls: a null text, or one without letters, is `und`
with score 0 and not rejected by entropy but as undetermined. Null languages and null ids are not learned from. Without
any labelled text every prediction is `und`. Repeated rows come out alike; ties go to the first language by name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voxelspark.llm.bytewords import slices, utf8
from voxelspark.llm.shared import bounded
from voxelspark.llm.symbols import codepoints, letters_only

ORDER = 4
#: Lengths in letters that end the bands of the calibration.
BANDS = (64, 512)
_K = np.uint64(0x9E3779B97F4A7C15)


def _symbols(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's letters and single spaces, after ORDER - 1 spaces; and where each text begins. Without letters: nothing after them."""
    points, start = codepoints(data, at)
    low = letters_only(points)
    text = np.repeat(np.arange(len(at) - 1), np.diff(start))
    keep = low != 32
    keep[:-1] |= (low[1:] != 32) & (text[1:] == text[:-1])  # a space counts only right before a letter
    low, text = low[keep], text[keep]
    n = np.bincount(text, minlength=len(at) - 1)
    begin = np.concatenate(([0], np.cumsum(n + ORDER - 1)))
    out = np.full(begin[-1], 32, np.uint32)
    out[np.arange(len(low)) + (text + 1) * (ORDER - 1)] = low
    return out, begin


def _hashes(columns: list[np.ndarray]) -> np.ndarray:
    h = columns[0].astype(np.uint64) + np.uint64(1)
    for c in columns[1:]:
        h = h * _K + c + np.uint64(1)
    h *= _K
    return h ^ (h >> np.uint64(31))


@dataclass
class Level:
    """n-grams of one order: sorted hashes and log P for each language; contexts: sorted hashes and log weights."""

    keys: np.ndarray
    logp: np.ndarray
    context_keys: np.ndarray = field(default_factory=lambda: np.zeros(0, np.uint64))
    context_logw: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.float32))


def _find(keys: np.ndarray, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.searchsorted(keys, h)
    at[at == len(keys)] = 0
    return at, (keys[at] == h) if len(keys) else np.zeros(len(h), bool)


@dataclass
class LanguageModels:
    languages: list[str]
    levels: list[Level]  # by order, from 1
    unseen: np.ndarray  # log P of a character that no language has seen
    alphabet: int = 1
    letters: np.ndarray = field(default_factory=lambda: np.array([32], np.uint32))
    mean: np.ndarray | None = None
    limit: np.ndarray | None = None  # by language and length band

    def logp(self, grams: list[np.ndarray]) -> np.ndarray:
        """Log P of the last of each n characters after those before, for each language."""
        level = self.levels[len(grams) - 1]
        at, hit = _find(level.keys, _hashes(grams))
        out = level.logp[at] if len(level.keys) else np.zeros((len(at), len(self.languages)), np.float32)
        if not hit.all():
            miss = np.flatnonzero(~hit)
            rest = [g[miss] for g in grams]
            if len(grams) == 1:
                out[miss] = self.unseen
            else:
                c, known = _find(level.context_keys, _hashes(rest[:-1]))
                weight = np.where(known[:, None], level.context_logw[c] if len(level.context_keys) else 0, 0)
                out[miss] = weight + self.logp(rest[1:])
        return out

    def judged(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(best language, nats per character, score, number of characters, rejected) of each text."""
        e, n, strange = self.entropies(data, at)
        best = e.argmin(axis=1)
        low = e[np.arange(len(n)), best]
        p = np.where(n > 0, (1 - strange) / np.exp(10 * (low[:, None] - e)).sum(axis=1), 0)
        over = strange > 0.5
        if self.mean is not None:
            over |= np.nan_to_num((low - self.mean[best]) * _scale(n)) > self.limit[best, np.searchsorted(BANDS, n)]
        return best, low, p, n, (n == 0) | over

    def entropies(self, data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(nats per character for each text and language, number of characters, share of them that no language has seen)."""
        sym, begin = _symbols(data, at)
        n = np.diff(begin) - (ORDER - 1)
        total, strange = np.zeros((len(n), len(self.languages))), np.zeros(len(n))
        if len(sym) >= ORDER:
            logp = self.logp([sym[i : len(sym) - ORDER + 1 + i] for i in range(ORDER)])
            some = np.flatnonzero(n > 0)
            if len(some):
                # the ORDER - 1 sums after each text's last character belong to the padding of the next
                edges = np.column_stack((begin[some], begin[some] + n[some])).ravel()
                edges = edges[:-1] if edges[-1] >= len(logp) else edges
                total[some] = np.add.reduceat(logp, edges, axis=0)[::2]
            known = np.zeros(1 << 16, bool)
            known[self.letters[self.letters < 1 << 16]] = True
            new = np.flatnonzero(~np.where(sym < 1 << 16, known[np.minimum(sym, 0xFFFF)], np.isin(sym, self.letters)))
            strange = np.bincount(np.searchsorted(begin, new, "right") - 1, minlength=len(n)) / np.maximum(n, 1)
        return -total / np.maximum(n, 1)[:, None], n, strange


def _discount(counts: np.ndarray) -> float:
    n1, n2 = (counts == 1).sum(), (counts == 2).sum()
    return float(n1 / (n1 + 2 * n2)) if n1 and n2 else 0.5


def _kneser_ney(grams: dict[str, tuple[np.ndarray, np.ndarray]]) -> LanguageModels:
    """grams: by language, n-grams of ORDER as rows of code points, and their counts."""
    languages = sorted(grams)
    by_order: list[dict[str, tuple[np.ndarray, np.ndarray]]] = []
    for order in range(ORDER, 0, -1):
        if order < ORDER:  # how many different characters stand before each shorter n-gram
            grams = {k: tuple(np.unique(g[:, 1:], axis=0, return_counts=True)) for k, (g, _) in grams.items()}
        by_order.insert(0, grams)
    letters = np.unique(np.concatenate([g for g, _ in by_order[0].values()]).ravel())
    alphabet = len(letters) + 1
    models = LanguageModels(languages, [], np.zeros(len(languages), np.float32), alphabet, np.union1d(letters, [32]).astype(np.uint32))
    for order in range(1, ORDER + 1):
        union = np.unique(np.concatenate([g for g, _ in by_order[order - 1].values()]), axis=0)
        keys = _hashes(list(union.T))
        sort = np.argsort(keys)
        union, keys = union[sort], keys[sort]
        if order == 1:
            lower, ctx_keys = np.full((len(union), len(languages)), 1 / alphabet), np.zeros(0, np.uint64)
        else:
            lower = np.exp(models.logp(list(union[:, 1:].T)).astype(float))
            ctx = np.unique(union[:, :-1], axis=0)
            ctx_keys = np.sort(_hashes(list(ctx.T)))
        p, weights = np.empty_like(lower), np.zeros((len(ctx_keys), len(languages)), np.float32)
        for k, language in enumerate(languages):
            g, c = by_order[order - 1][language]
            c, d = c.astype(float), _discount(c)
            own = np.zeros(len(union))
            own[np.searchsorted(keys, _hashes(list(g.T)))] = c
            discounted = np.maximum(own - d, 0)
            if order == 1:
                p[:, k] = (discounted + d * len(c) * lower[:, k]) / c.sum()
                models.unseen[k] = np.log(d * len(c) / alphabet / c.sum())
                continue
            h, inverse = np.unique(_hashes(list(g[:, :-1].T)), return_inverse=True)
            total, kinds = np.bincount(inverse, c), np.bincount(inverse)
            weights[np.searchsorted(ctx_keys, h), k] = np.log(d * kinds / total)
            at, known = _find(h, _hashes(list(union[:, :-1].T)))
            # after a context that this language has not seen, the shorter n-gram stands alone
            p[:, k] = np.where(known, (discounted + d * kinds[at] * lower[:, k]) / total[at], lower[:, k])
        models.levels.append(Level(keys, np.log(p).astype(np.float32), ctx_keys, weights))
    return models


def _count_grams(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        langs = np.array([x or "" for x in batch.column(0).to_pylist()], object)
        data, at = utf8(batch.column(1))
        for i, j in slices(at, 1 << 18):
            for language in np.unique(langs[i:j]):
                mine = np.flatnonzero(langs[i:j] == language) + i
                sym, begin = _symbols(np.concatenate([data[at[k] : at[k + 1]] for k in mine]), np.concatenate(([0], np.cumsum(at[mine + 1] - at[mine]))))
                if len(sym) < ORDER:
                    continue
                rows = np.column_stack([sym[k : len(sym) - ORDER + 1 + k] for k in range(ORDER)])
                inside = np.ones(len(rows), bool)
                for k in range(1, ORDER):  # windows that reach into the next text's padding
                    inside[begin[1:-1] - k] = False
                grams, n = np.unique(rows[inside], axis=0, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array([language] * len(n), pa.string()), *(pa.array(grams[:, k].astype(np.int64)) for k in range(ORDER)), pa.array(n.astype(np.int64))], names=["lang", "c0", "c1", "c2", "c3", "n"])


def fit(labelled: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = 1500, languages: int = 256, reject: float = 0.001, margin: float = 3.0) -> LanguageModels | None:
    """Models of the `languages` most common languages in `labelled`, from at most `sample` texts of each; None if there are none."""
    own = labelled.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).cast("string").alias("text")).where("id is not null and lang is not null and text is not null")
    h = F.xxhash64("id")
    # a language's rows are thinned by hash before they are dealt, so a common one brings no more rows than a rare one
    thin = own.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(languages).select("lang", (F.lit(1.2 * sample) / F.col("n") * (1 << 20) + 1).alias("most"))
    few = own.select("id", "lang", h.alias("h")).join(F.broadcast(thin), "lang").where(F.pmod("h", F.lit(1 << 20)) < F.col("most"))
    # ids may be repeated, so some hashes may be very common: the least rows of each part first
    part = few.withColumn("part", F.pmod(F.xxhash64("h", F.monotonically_increasing_id()), F.lit(16)))
    rank = lambda *by: F.row_number().over(Window.partitionBy(*by).orderBy("h", "id"))
    part = part.withColumn("r", rank("lang", "part")).where(F.col("r") <= sample)
    chosen = part.withColumn("r", rank("lang")).where(F.col("r") <= sample).select("id", "lang", (F.col("r") % 5 == 0).alias("calibrates")).dropDuplicates(["id", "lang"])
    # bounded by `sample` rows for each of `languages`
    texts = bounded(own.join(F.broadcast(chosen), ["id", "lang"]))
    counts = texts.where(~F.col("calibrates")).select("lang", "text").mapInArrow(_count_grams, "lang string, c0 long, c1 long, c2 long, c3 long, n long").groupBy("lang", "c0", "c1", "c2", "c3").agg(F.sum("n").alias("n")).toArrow()
    if not counts.num_rows:
        return None
    table = counts.to_pandas()
    models = _kneser_ney({k: (g[["c0", "c1", "c2", "c3"]].to_numpy(np.uint32), g["n"].to_numpy()) for k, g in table.groupby("lang")})
    held = _entropies_of(texts.where("calibrates"), models).query("lang == lang_pred")
    every = (held if len(held) else _entropies_of(texts, models))["entropy"].median()
    models.mean, models.limit = np.zeros(len(models.languages)), np.zeros((len(models.languages), len(BANDS) + 1))
    for k, language in enumerate(models.languages):
        _calibrate(models, k, held[held["lang"] == language], every, reject, margin)
    return models


def _calibrate(models: LanguageModels, k: int, held: pd.DataFrame, every: float, reject: float, margin: float) -> None:
    """Set the middle and the limits of language k from its held texts."""
    entropy, n = held["entropy"].to_numpy(), held["n_symbols"].to_numpy()
    few = len(held) < 20
    mean = max(every, held["entropy"].quantile(0.5, "lower") if len(held) else every) if few else float(np.median(entropy))
    noise = 2 / 3 * max(np.log(models.alphabet) - mean, 0) * _scale(np.array([400]))[0]
    models.mean[k], models.limit[k] = mean, noise
    far, band = (entropy - mean) * _scale(n), np.searchsorted(BANDS, n)
    calm = far <= noise
    if few or calm.sum() < 20:
        return
    for b in range(len(BANDS) + 1):
        own = far[calm & (band == b)]
        own = np.sort(own if len(own) >= 20 else far[calm])
        models.limit[k, b] = min(noise, margin * max(own[min(len(own), int(np.ceil((len(own) + 1) * (1 - reject)))) - 1], 0))


def _entropies_of(texts: DataFrame, models: LanguageModels) -> pd.DataFrame:
    """lang, lang_pred, entropy, n_symbols of the texts with letters: no more than the sample."""
    return score(texts, models, id_col="id", text_col="text", keep=["lang"]).where("n_symbols > 0").select("lang", "lang_pred", "entropy", "n_symbols").toArrow().to_pandas()


def _scale(n: np.ndarray) -> np.ndarray:
    return np.sqrt(np.clip(n, 1, 400))


def score(docs: DataFrame, models: LanguageModels | None, *, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """id, the columns in `keep`, lang_pred, score (0 to 1), entropy (nats per symbol), n_symbols, rejected for every row."""
    keep = keep or []
    shared = docs.sparkSession.sparkContext.broadcast(models)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(id_col, *keep).schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            data, at = utf8(batch.column(batch.num_columns - 1))
            rows = len(at) - 1
            pred, p, ent, count, rejected = np.full(rows, "und", object), np.zeros(rows), np.full(rows, np.nan), np.zeros(rows, np.int64), np.ones(rows, bool)
            for i, j in slices(at, 1 << 18) if m else []:
                best, low, p[i:j], n, rejected[i:j] = m.judged(data[at[i] : at[j]], at[i : j + 1] - at[i])
                some = n > 0
                pred[i:j][some] = np.array(m.languages, object)[best[some]]
                ent[i:j], count[i:j] = np.where(some, low, np.nan), n
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in range(1 + len(keep))), pa.array(pred, pa.string()), pa.array(p), pa.array(ent, pa.float64(), from_pandas=True), pa.array(count), pa.array(rejected)], names=[id_col, *keep, "lang_pred", "score", "entropy", "n_symbols", "rejected"])

    narrow = docs.select(id_col, *keep, F.col(text_col).cast("string").alias("_text"))
    return bounded(narrow).mapInArrow(run, f"{kinds}, lang_pred string, score double, entropy double, n_symbols long, rejected boolean")


def keep_known(docs: DataFrame, models: LanguageModels | None, *, text_col: str = "text") -> DataFrame:
    """The rows of docs that are not rejected, with their columns. Extra columns pass through."""
    shared = docs.sparkSession.sparkContext.broadcast(models)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in batches:
            data, at = utf8(batch.column(batch.schema.get_field_index(text_col)))
            kept = np.ones(len(at) - 1, bool)
            for i, j in slices(at, 1 << 18) if m else []:
                kept[i:j] = ~m.judged(data[at[i] : at[j]], at[i : j + 1] - at[i])[4]
            yield batch.filter(pa.array(kept))

    return bounded(docs).mapInArrow(run, docs.schema)


def crc_mod(id_col: Column, m: int) -> Column:
    return F.crc32(id_col.cast("string")) % m


__all__ = ["LanguageModels", "crc_mod", "fit", "keep_known", "score"]
