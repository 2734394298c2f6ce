"""Language identification as a mixture over words, estimated for each document by expectation-maximisation.

Training counts hashed byte trigrams of all labelled rows by language, in one aggregation whose result is bounded by
languages times 2**GRAM_BITS. A document is a mixture of languages over its words: a word's likelihood under a language
is the product of its trigrams' smoothed frequencies, and EM estimates the proportions. Of the sets of its most probable
languages, one to all, the one with the best likelihood less half a log of the number of words for each language is taken.

Defined cases: null texts and texts without a letter are UND with score 0; with nothing to learn from, every text is; rows
with a null id are predicted and never learned from; a null lang isn't learned from; repeated rows count each; a very long
text is predicted whole, which takes memory in proportion to it; an empty table gives no rows; other columns stay but for
those of the result, which are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from kvstrata.llm.memo import slices, tidy
from kvstrata.sources.shipping import ship_package

UND = "und"
GRAM_BITS = 15
SMOOTHING = 0.5
ROUNDS = 12
#: Bytes of text (or one longer text) that a task works on at a time.
SLICE = 1 << 18
#: Floors lie so many deviations below the mean, and as many of a mean over letters of which RUN vary together.
FLOOR_SIGMAS = 3.0
RUN = 16
_LETTER = np.zeros(256, bool)
_LETTER[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True
_FOLD = np.where(_LETTER, np.arange(256), 32).astype(np.uint8)
_FOLD[65:91] += 32


def text_bytes(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of a string column without nulls, and the n + 1 offsets of its rows in them."""
    column = column.cast(pa.large_string())
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data is not None else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of all letter bytes, and the code of the trigram about each; other bytes and the ends of texts are spaces in it."""
    c = _FOLD[data]
    accented = np.flatnonzero(data[:-1] == 0xC3) + 1  # capitals of the Latin-1 block are 32 below the small letters
    c[accented[(data[accented] >= 0x80) & (data[accented] <= 0x9E) & (data[accented] != 0x97)]] += 32
    at = np.flatnonzero(c != 32)
    left, right = np.full(len(c), 32, np.uint8), np.full(len(c), 32, np.uint8)
    left[1:], right[:-1] = c[:-1], c[1:]
    inner = offsets[(offsets > 0) & (offsets < len(c))]
    left[inner], right[inner - 1] = 32, 32
    code = left[at].astype(np.uint32) << 16 | c[at].astype(np.uint32) << 8 | right[at]
    return at, (code * np.uint32(2654435761)) >> np.uint32(32 - GRAM_BITS)


def gram_counts(docs: DataFrame) -> DataFrame:
    """(lang, gram, n) of all rows of (text, lang)."""
    ship_package(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, np.ndarray] = {}
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                data, offsets = text_bytes(part.column("text"))
                at, codes = grams(data, offsets)
                bound = np.searchsorted(at, offsets)
                langs = part.column("lang").to_pylist()
                for lang in sorted(set(langs)):
                    mine = np.repeat(np.array([x == lang for x in langs]), np.diff(bound))
                    n = np.bincount(codes[mine], minlength=1 << GRAM_BITS)
                    total[lang] = total.get(lang, 0) + n
        for lang, n in total.items():
            k = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(k), pa.string()), pa.array(k.astype(np.int32)), pa.array(n[k])], names=["lang", "gram", "n"])

    counted = docs.select("text", "lang").mapInArrow(tidy(run), "lang string, gram int, n bigint")
    return counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Model:
    """Log frequencies of trigrams by language."""

    def __init__(self, langs: list[str], counts: np.ndarray):
        self.langs = langs
        smooth = counts + SMOOTHING
        self.letter, self.document = np.full((2, 2, len(langs)), [[-np.inf], [0.0]])
        self.log = np.log(smooth / smooth.sum(1, keepdims=True)).T.astype(np.float32).copy() if langs else np.zeros((1 << GRAM_BITS, 0), np.float32)

    def learn_floors(self, counts: np.ndarray, documents: np.ndarray) -> None:
        """Mean and deviation of a letter's log likelihood by language over all training rows' trigrams, and of a document's
        mean over its letters, from (number, sum, sum of squares) by language."""
        share = counts / counts.sum(1, keepdims=True)
        n = np.maximum(documents[:, :1], 1)
        for at, (mean, square) in ((self.letter, ((share * self.log.T).sum(1), (share * self.log.T.astype(np.float64) ** 2).sum(1))), (self.document, (documents[:, 1:] / n).T)):
            at[:] = mean, np.sqrt(np.maximum(0, square - mean**2))

    def floor(self, letters: np.ndarray) -> np.ndarray:
        """For texts of so many letters and each language the mean log likelihood of a letter below which they aren't of it:
        below what both letters and documents of the training rows show, with more room for short texts."""
        wide = FLOOR_SIGMAS * (1 + np.sqrt(RUN / np.maximum(letters, 1)))[:, None]
        return np.minimum(self.letter[0] - wide * self.letter[1], self.document[0] - wide * self.document[1])

    def predict(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """For each text the index of its main language, -1 without a letter byte, that language's share, the shares of all
        languages, which are above 0 for those of the chosen set only, and whether its penalised likelihood a letter reaches
        the floor of a language of the set."""
        n, k = len(offsets) - 1, len(self.langs)
        at, codes = grams(data, offsets)
        if not k or not len(at):
            return np.full(n, -1), np.zeros(n), np.zeros((n, k)), np.zeros(n, bool)
        bound = np.searchsorted(at, offsets)
        start = np.ones(len(at), bool)
        start[1:] = np.diff(at) > 1
        start[bound[:-1][bound[:-1] < len(at)]] = True
        first = np.flatnonzero(start)
        like = np.add.reduceat(self.log[codes], first, axis=0)
        words = np.searchsorted(first, bound)
        has = np.diff(words) > 0
        count = np.diff(words)[has]
        doc = np.repeat(np.arange(len(count)), count)
        begin = words[:-1][has]
        top = like.max(1, keepdims=True)
        rel = np.exp(like - top)
        share = self.mix(rel, doc, begin, count, np.full((len(count), k), 1 / k, np.float32))
        order = np.argsort(-share, axis=1, kind="stable")
        best = np.full(len(count), -np.inf)
        shares = np.zeros_like(share)
        for size in range(1, k + 1):
            # likelihoods relative to each word's best language are 1 at most, so others can't gain from this size or a larger one
            live = np.flatnonzero(best < -0.5 * size * np.log(count + 1))
            if not len(live):
                break
            mine = np.zeros(len(count), bool)
            mine[live] = True
            words_of, doc_of = rel[mine[doc]], np.repeat(np.arange(len(live)), count[live])
            start_of = np.cumsum(count[live]) - count[live]
            allowed = np.zeros_like(share[live])
            np.put_along_axis(allowed, order[live, :size], 1, axis=1)
            some = np.maximum(share[live], 1e-3) * allowed
            some /= some.sum(1, keepdims=True)
            if size > 1:
                some = self.mix(words_of, doc_of, start_of, count[live], some, ROUNDS // 2)
            seen = np.log(np.maximum((words_of * some[doc_of]).sum(1), 1e-30))
            value = np.add.reduceat(seen.astype(np.float64), start_of) - 0.5 * size * np.log(count[live] + 1)
            better = value > best[live]
            best[live[better]] = value[better]
            shares[live[better]] = np.maximum(some, 1e-30)[better] * allowed[better]
        out, value, sets = np.full(n, -1), np.zeros(n), np.zeros((n, k))
        out[has], value[has], sets[has] = shares.argmax(1), np.clip(shares.max(1), 0, 1), shares
        letters = np.diff(bound)[has]
        # the training documents' means have no penalty, so that of one language isn't counted; 1e-3 is for single precision
        reached = ((np.add.reduceat(top[:, 0].astype(np.float64), begin) + best + 0.5 * np.log(count + 1)) / letters)[:, None] + 1e-3
        fits = np.zeros(n, bool)
        fits[has] = ((reached >= self.floor(letters)) & (shares > 0)).any(1)
        return out, value, sets, fits

    @staticmethod
    def mix(rel: np.ndarray, doc: np.ndarray, begin: np.ndarray, count: np.ndarray, share: np.ndarray, rounds: int = ROUNDS) -> np.ndarray:
        for _ in range(rounds):
            part = rel * share[doc]
            part /= np.maximum(part.sum(1, keepdims=True), 1e-30)
            share = np.add.reduceat(part, begin, axis=0) / count[:, None]
        return share


def learn(labelled: DataFrame, floors: bool = False) -> Model:
    """A model of all rows of (text, lang) that have both; `floors`: with what tells texts of no learned language."""
    labelled = labelled.where("text IS NOT NULL AND lang IS NOT NULL")
    found = gram_counts(labelled).toPandas()
    langs = sorted(found["lang"].unique().tolist())
    counts = np.zeros((len(langs), 1 << GRAM_BITS))
    counts[np.searchsorted(langs, found["lang"].to_numpy(dtype=object)) if langs else [], found["gram"].to_numpy()] = found["n"]
    model = Model(langs, counts)
    if floors and langs:
        documents = np.zeros((len(langs), 3))
        for lang, *sums in document_sums(labelled, model).collect():
            documents[langs.index(lang)] = sums
        model.learn_floors(counts, documents)
    return model


def document_sums(labelled: DataFrame, model: Model) -> DataFrame:
    """(lang, n, total, squares) of the mean log likelihood of a letter under the label, over all rows of (text, lang) with letters."""
    shared = labelled.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        total = np.zeros((len(model.langs), 3))
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                data, offsets = text_bytes(part.column("text"))
                at, codes = grams(data, offsets)
                bound = np.searchsorted(at, offsets)
                has = np.diff(bound) > 0
                if not has.any():
                    continue
                place = {lang: k for k, lang in enumerate(model.langs)}
                label = np.array([place.get(x, -1) for x in part.column("lang").to_pylist()])[has]
                letters = np.diff(bound)[has]
                mean = np.add.reduceat(model.log[codes, np.repeat(label, letters)].astype(np.float64), bound[:-1][has]) / letters
                np.add.at(total, label, np.stack([np.ones(len(mean)), mean, mean**2], 1))
        yield pa.RecordBatch.from_arrays([pa.array(model.langs, pa.string()), *map(pa.array, total.T.copy())], names=["lang", "n", "total", "squares"])

    each = labelled.select("text", "lang").mapInArrow(tidy(run), "lang string, n double, total double, squares double")
    return each.groupBy("lang").agg(F.sum("n"), F.sum("total"), F.sum("squares"))


def identify(docs: DataFrame, model: Model) -> DataFrame:
    """The frame's columns with lang_pred and score, and the chosen set of languages with their shares, largest first, as
    lang_set and lang_shares, empty for UND, and lang_fits, false for UND and for texts too unlikely for any language of a
    model that has floors; columns of these names are replaced."""
    spark = docs.sparkSession
    ship_package(spark)
    docs = docs.drop("lang_pred", "score", "lang_set", "lang_shares", "lang_fits")
    shared = spark.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            for part in slices(batch, "text", SLICE):
                text = part.column("text").fill_null("")
                data, offsets = text_bytes(text)
                which, score, shares, fits = model.predict(data, offsets)
                plain = np.add.reduceat(np.concatenate([_LETTER[data] & (data < 128), [False]]), offsets[:-1]) * (np.diff(offsets) > 0) > 0
                for i in np.flatnonzero(~plain & (which >= 0)):
                    if not any(map(str.isalpha, text[int(i)].as_py())):
                        which[i], score[i], shares[i], fits[i] = -1, 0, 0, False
                names = pa.array([UND if k < 0 else model.langs[k] for k in which], pa.string())
                line = np.argsort(-shares, axis=1, kind="stable")
                ranked = np.take_along_axis(shares, line, 1)
                ends = pa.array(np.concatenate([[0], np.cumsum((ranked > 0).sum(1))]).astype(np.int32))
                langs = pa.ListArray.from_arrays(ends, pa.array(np.array(model.langs, object)[line[ranked > 0]], pa.string()))
                parts = pa.ListArray.from_arrays(ends, pa.array(ranked[ranked > 0], pa.float64()))
                yield pa.RecordBatch.from_arrays([*part.columns, names, pa.array(score, pa.float64()), langs, parts, pa.array(fits)], names=[*part.schema.names, "lang_pred", "score", "lang_set", "lang_shares", "lang_fits"])

    added = [("lang_pred", T.StringType()), ("score", T.DoubleType()), ("lang_set", T.ArrayType(T.StringType())), ("lang_shares", T.ArrayType(T.DoubleType())), ("lang_fits", T.BooleanType())]
    schema = T.StructType([*docs.schema.fields, *(T.StructField(*x) for x in added)])
    return docs.mapInArrow(tidy(run), schema)


def held_out(id_col: str = "doc_id"):
    """Whether crc32 of the id's text leaves 1 by 3; null for a null id."""
    return F.crc32(F.col(id_col).cast("string").cast("binary")) % 3 == 1


def identify_held_out(docs: DataFrame) -> DataFrame:
    """Learns from the labelled documents that aren't held out and predicts all: doc_id, held_out, lang_pred, score."""
    model = learn(docs.where(~held_out()).select("text", "lang"))
    found = identify(docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), F.coalesce(held_out(), F.lit(False)).alias("held_out"), "text"), model)
    return found.select("doc_id", "held_out", "lang_pred", "score")
