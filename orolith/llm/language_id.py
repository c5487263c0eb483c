"""Hierarchical language identification (operator 8).

A text becomes the relative frequencies of its byte trigrams, A-Z lower-cased, hashed to `buckets`
features. A linear classifier (one against the rest, squared hinge) predicts the language family;
within it, one-versus-one linear support vector machines vote between the family's languages. All
of them are linear in the frequencies, so a whole text is scored in one pass, a lookup a byte.

Training reads at most `per_lang` different texts of each language (default 600), those of the smallest
hash, of the rows that the caller calls labelled; everything else covers all rows. Families are
fixed facts below; a language that is not listed is a family of its own.

Defined results: a text that is null or has no letter is `und` with score 0, and so is every text
if no labelled row exists; with one learned language all others are predicted as that one; ties go
to the name that sorts first; repeated rows come back as often as given; a null id is not held out
and is not learned from; an empty table gives an empty result; other columns stay, but those named
lang_pred or score are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from orolith.llm import common

#: Language families by ISO 639-1 code.
FAMILIES = {
    "germanic": ["af", "da", "de", "en", "is", "nb", "nl", "nn", "no", "sv"],
    "romance": ["ca", "es", "fr", "gl", "it", "oc", "pt", "ro"],
    "slavic": ["be", "bg", "bs", "cs", "hr", "mk", "pl", "ru", "sk", "sl", "sr", "uk"],
    "uralic": ["et", "fi", "hu"],
    "baltic": ["lt", "lv"],
    "turkic": ["az", "kk", "tr", "uz"],
    "semitic": ["am", "ar", "he", "mt"],
    "indic": ["bn", "gu", "hi", "mr", "ne", "pa", "ur"],
    "sinitic": ["yue", "zh"],
    "austronesian": ["id", "ms", "tl"],
}
FAMILY_OF = {lang: family for family, langs in FAMILIES.items() for lang in langs}
#: Bytes of a text, and rows of a batch, that are worked on at a time.
PIECE, SLICE = 1 << 20, 512


def family_of(lang: str) -> str:
    return FAMILY_OF.get(lang, f"only {lang}")


def codes_of(data: np.ndarray, buckets: int) -> np.ndarray:
    """The feature of each byte: its trigram with the two bytes before it."""
    low = data + np.uint8(32) * ((data >= 65) & (data <= 90))
    c = low.astype(np.uint32) * np.uint32(2654435761)
    c[1:] += low[:-1] * np.uint32(2246822519)
    c[2:] += low[:-2] * np.uint32(3266489917)
    c ^= c >> np.uint32(15)
    c *= np.uint32(668265263)
    return (c >> np.uint32(8)) & np.uint32(buckets - 1)


def texts_of(column: pa.Array) -> Iterator[np.ndarray]:
    """Each text in turn as bytes between spaces, so that its ends are features too; null is empty."""
    for t in column.cast(pa.binary()):
        yield np.frombuffer(b" " + (t.as_py() or b"") + b" ", np.uint8)


def fit_svm(x: np.ndarray, y: np.ndarray, c: float = 10.0, rounds: int = 60) -> np.ndarray:
    """Squared-hinge linear SVM by accelerated gradient steps; x has a bias column, y is -1 or 1."""
    weight = np.where(y > 0, 0.5 / max(1, (y > 0).sum()), 0.5 / max(1, (y < 0).sum()))
    weight, y = weight.astype(x.dtype), y.astype(x.dtype)
    step = float(1.0 / (1.0 / c + 2.0 * np.einsum("i,ij,ij->", weight, x, x, dtype=np.float64)))
    w = v = np.zeros(x.shape[1], x.dtype)
    for k in range(rounds):
        slack = np.maximum(0, 1 - y * (x @ v))
        new = v - step * (v / c - 2 * x.T @ (weight * y * slack))
        v, w = new + k / (k + 3) * (new - w), new
    return w


@dataclass(frozen=True)
class Model:
    """weights: a column a classifier; plan: families and their languages with column numbers."""

    buckets: int
    weights: np.ndarray
    families: list[str]
    langs: dict[str, list[str]]
    pairs: dict[str, list[tuple[int, int, int]]]

    def predict(self, sums: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Languages and scores for rows of classifier values."""
        n = len(sums)
        k = len(self.families)
        fam = sums[:, :k].argmax(1) if k else np.zeros(n, int)
        rest = np.sort(sums[:, :k], 1)
        margin = (rest[:, -1] - rest[:, -2]) / 2 if k > 1 else np.full(n, 9.0)
        score = 1 / (1 + np.exp(-np.clip(4 * margin, 0, 30)))
        lang = np.full(n, "und", object)
        for f, name in enumerate(self.families):
            at = np.flatnonzero(fam == f)
            votes, least = np.zeros((len(at), len(self.langs[name]))), np.full((len(at), len(self.langs[name])), 9.0)
            for a, b, col in self.pairs[name]:
                s = sums[at, col]
                for i, won in ((a, s >= 0), (b, s < 0)):
                    votes[:, i] += won
                    least[:, i] = np.where(won, np.minimum(least[:, i], np.abs(s)), least[:, i])
            best = votes.argmax(1)
            lang[at] = np.array(self.langs[name], object)[best]
            score[at] *= 1 / (1 + np.exp(-np.clip(4 * least[np.arange(len(at)), best], 0, 30)))
        return lang, np.clip(score, 0, 1)


def training_rows(labelled: DataFrame, per_lang: int) -> DataFrame:
    """(text, lang): the per_lang texts of each language with the smallest hashes, each once however
    many copies it has. A language meets in one task with about 4 * per_lang hashes, however many it has."""
    hashed = labelled.select("text", "lang", F.xxhash64("text", F.lit(3)).alias("h"))
    texts = common.stored(hashed.select("lang", "h").distinct(), "language-texts")
    # Hashes are even over their range, so those under 4 * per_lang / n of it hold the smallest per_lang.
    share = F.lit(4.0 * per_lang) / F.col("n")
    bound = F.when(share < 1, (F.lit(-(2.0**63)) + share * F.lit(2.0**64)).cast("long")).otherwise(F.lit((1 << 63) - 1))
    bounds = texts.groupBy("lang").agg(F.count("*").alias("n")).select("lang", bound.alias("bound"))
    few = texts.join(common.sized(bounds), "lang").where(F.col("h") <= F.col("bound"))
    order = F.row_number().over(Window.partitionBy("lang").orderBy("h"))
    least = few.withColumn("n", order).where(F.col("n") <= per_lang).select("lang", "h")
    return hashed.join(common.sized(least), ["lang", "h"], "left_semi").dropDuplicates(["lang", "h"]).select("text", "lang")


def learn(labelled: DataFrame, per_lang: int = 600, buckets: int = 1 << 12, per_family: int = 1200) -> Model:
    """labelled: text and lang, neither null. Frequencies are made in tasks; the bounded sample of
    them (per_lang rows of `buckets` half floats a language) comes to the driver, where families are
    fitted on at most per_family rows each and languages two at a time, in single precision."""

    def features(batches):
        for batch in batches:
            rows = []
            for t in texts_of(batch.column(0)):
                n = np.bincount(codes_of(t, buckets), minlength=buckets)
                rows.append((n / n.sum()).astype(np.float16).tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(rows, pa.binary()), batch.column(1)], names=["f", "lang"])

    rows = training_rows(labelled.select("text", "lang"), per_lang).mapInArrow(features, "f binary, lang string").collect()
    rows.sort(key=lambda r: (r.lang, bytes(r.f)))
    known = sorted({r.lang for r in rows})
    if not known:
        return Model(buckets, np.zeros((buckets, 0), np.float32), [], {}, {})
    raw = np.stack([np.frombuffer(r.f, np.float16) for r in rows])
    lang = np.array([r.lang for r in rows])
    families = sorted({family_of(a) for a in known})
    langs = {f: [a for a in known if family_of(a) == f] for f in families}
    of = np.array([family_of(a) for a in lang])
    # families are told apart by as many rows each, spread over their languages
    told = [np.flatnonzero(of == f) for f in families]
    told = np.concatenate([at[np.linspace(0, len(at) - 1, min(len(at), per_family)).astype(int)] for at in told])
    sample = raw[told].astype(np.float32)
    scale = (1 / np.sqrt(np.maximum(sample.var(0, dtype=np.float64), 1e-9) * buckets)).astype(np.float32)

    def frequencies(at: np.ndarray) -> np.ndarray:
        return np.hstack([raw[at].astype(np.float32) * scale, np.ones((len(at), 1), np.float32)])

    x = frequencies(told)
    ws = [fit_svm(x, np.where(of[told] == f, 1.0, -1.0)) if len(families) > 1 else np.zeros(x.shape[1]) for f in families]
    pairs = {}
    for f in families:
        pairs[f] = []
        for a, b in combinations(range(len(langs[f])), 2):
            at = np.flatnonzero(np.isin(lang, [langs[f][a], langs[f][b]]))
            pairs[f].append((a, b, len(ws)))
            ws.append(fit_svm(frequencies(at), np.where(lang[at] == langs[f][a], 1.0, -1.0)))
    w = np.array(ws).T
    return Model(buckets, (w[:-1] * scale[:, None] + w[-1]).astype(np.float32), families, langs, pairs)


def predict(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score. Only the text and the row's other columns as they are go in."""
    docs = docs.select(*common.others(docs, "lang_pred", "score"))
    names = docs.columns
    letters = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    sent = docs.select(*[F.col(f"`{c}`") for c in names], letters.alias("__letters"))
    at_text = [c.lower() for c in names].index(text_col.lower())
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema.fields)

    def run(batches):
        width = model.weights.shape[1]
        for whole in batches:
            for first in range(0, whole.num_rows, SLICE):  # so that a large batch is not held several times
                batch = whole.slice(first, SLICE)
                sums = np.zeros((batch.num_rows, width))
                for i, t in enumerate(texts_of(batch.column(at_text))):
                    for at in range(0, len(t), PIECE):
                        codes = codes_of(t[max(0, at - 2) : at + PIECE], model.buckets)[min(2, at) :]
                        if len(codes) > 2 * model.buckets:
                            sums[i] += np.bincount(codes, minlength=model.buckets) @ model.weights
                        else:
                            sums[i] += model.weights[codes].sum(0, dtype=np.float64)
                    sums[i] /= len(t)
                lang, score = model.predict(sums)
                none = ~batch.column(len(names)).to_numpy(zero_copy_only=False) | (lang == "und")
                lang[none], score[none] = "und", 0.0
                yield pa.RecordBatch.from_arrays([*batch.columns[: len(names)], pa.array(lang, pa.string()), pa.array(score, pa.float64())], names=[*names, "lang_pred", "score"])

    return sent.mapInArrow(run, f"{schema}, lang_pred string, score double")


def held_out(id_col: str = "doc_id") -> Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def learned_from(docs: DataFrame) -> DataFrame:
    """Text and language of the rows that may be learned from."""
    return docs.where(~held_out() & F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").isNotNull()).select("text", "lang")


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score), learned from the rows of docs that are not held out."""
    model = learn(learned_from(docs))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")
