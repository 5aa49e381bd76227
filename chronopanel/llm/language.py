"""Language identification, word first: log frequencies of known words, and ever shorter character n-grams for the others.

The model is fitted on a bounded sample of labelled rows: of each language the SAMPLE_DOCS different texts that come first by md5 of
their id, of longer ones a window of SAMPLE_CHARS characters at a place that a hash chooses; more than SAMPLE_TOTAL / SAMPLE_DOCS languages share SAMPLE_TOTAL texts evenly, and more than
MOST_LANGUAGES raise. One task builds it. It holds for each language the log frequency of each word of the sample, and of the
character n-grams of words (with their ends marked) for n from 5 down to 1. A word that the sample had scores by its own frequencies, any other by the mean over
those of its n-grams that are known, for the largest n for which some are. A text's language is the one with the largest
sum over all its words, which are read WORDS_TOGETHER at a time.

Nulls, ties, and so on: a null text, or one without a letter, is ``und`` with score 0; rows with a null language or id teach
nothing, and a null id isn't held out; ties go to the language that is first by name; letters are what Unicode calls so, not numerals like ½; where nothing can be learned,
all texts are ``und``; repeated rows are scored each, and teach once; a very long text is read to its end; an empty table gives an empty result; other columns don't matter,
whatever their names.
"""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from chronopanel.llm.shared import sampled

LETTERS = regex.compile(r"\p{L}+")
ORDERS = (5, 4, 3, 2, 1)
SAMPLE_DOCS = 1500
SAMPLE_CHARS = 20_000
SAMPLE_TOTAL, MOST_LANGUAGES = 24_000, 1000
WORDS_TOGETHER = 200_000
#: Words whose scores a worker keeps, and scores of them altogether; bytes of a model in one row on its way to the driver.
CACHED, CACHED_SCORES = 300_000, 32_000_000
PIECE = 16_000_000
#: Languages up to which rows are held whole.
WHOLE_ROWS = 16


def words_of(text: str | None) -> list[str]:
    return LETTERS.findall(text.lower()) if text else []


def word_lists(text: str | None) -> Iterator[list[str]]:
    """The words of a text, WORDS_TOGETHER at a time."""
    if not text or len(text) < WORDS_TOGETHER:
        yield words_of(text)
        return
    found = (m[0] for m in LETTERS.finditer(text.lower()))
    while part := list(islice(found, WORDS_TOGETHER)):
        yield part


def grams(word: str, n: int) -> list[str]:
    marked = f"<{word}>"
    return [marked[i : i + n] for i in range(len(marked) - n + 1)] if n > 1 else list(word)


class Table:
    """Log frequencies of entries by language, of which only those are held where a language has the entry; all others have the language's own.

    With few languages whole rows take no more room, and are read faster.
    """

    def __init__(self, counts: list[Counter]):
        self.known = {w: i for i, w in enumerate(dict.fromkeys(w for x in counts for w in x))}
        totals = np.array([x.total() for x in counts]) + 0.5 * (len(self.known) + 1)
        self.absent = np.log(0.5 / totals)
        entry, language, count = (np.fromiter((v[i] for j, x in enumerate(counts) for v in ((self.known[w], j, n) for w, n in x.items())), kind) for i, kind in enumerate((np.int64, np.uint16, np.int64)))
        order = np.argsort(entry, kind="stable")
        self.starts = np.searchsorted(entry[order], np.arange(len(self.known) + 1))
        self.language, self.more = language[order], np.log((count[order] + 0.5) / 0.5).astype(np.float32)
        self.whole = None
        if len(counts) <= WHOLE_ROWS:
            self.whole = np.tile(self.absent.astype(np.float32), (len(self.known), 1))
            self.whole[entry[order], self.language] += self.more

    def mean(self, entries: list[int]) -> np.ndarray:
        """The mean over entries of their rows."""
        if self.whole is not None:
            return self.whole[entries].mean(0)
        out = np.zeros(len(self.absent))
        for i in entries:
            at = slice(self.starts[i], self.starts[i + 1])
            out[self.language[at]] += self.more[at]
        return self.absent + out / len(entries)

    def __getitem__(self, entry: int) -> np.ndarray:
        return self.whole[entry] if self.whole is not None else self.mean([entry])


class Model:
    """Log frequencies by language for words and n-grams."""

    def __init__(self, sample: list[tuple[str, str]]):
        self.languages = sorted({lang for lang, _ in sample})
        words = {lang: Counter() for lang in self.languages}
        for lang, text in sample:
            words[lang].update(words_of(text))
        words = list(words.values())
        self.words = self._logs(words)
        self.grams = {}
        for n in ORDERS:
            counts = [Counter() for _ in self.languages]
            for of, own in zip(counts, words, strict=True):
                for word, k in own.items():
                    for g in grams(word, n):
                        of[g] += k
            self.grams[n] = self._logs(counts)

    @staticmethod
    def _logs(counts: list[Counter]) -> tuple[dict[str, int], Table]:
        """The row of each entry, and the rows."""
        table = Table(counts)
        return table.known, table

    def word(self, word: str) -> np.ndarray:
        rows, table = self.words
        if (known := rows.get(word)) is not None:
            return table[known]
        for n in ORDERS:
            rows, table = self.grams[n]
            if found := [rows[g] for g in grams(word, n) if g in rows]:
                return table.mean(found)
        return np.zeros(len(self.languages))


class _Rows(dict):
    """The row of each word in a matrix of scores, made when first asked for."""

    def __init__(self, model: Model):
        super().__init__()
        self.model, self.matrix = model, np.empty((1024, len(model.languages)))

    def __missing__(self, word: str) -> int:
        self[word] = at = len(self)
        if at == len(self.matrix):
            self.matrix = np.concatenate([self.matrix, np.empty_like(self.matrix)])
        self.matrix[at] = self.model.word(word)
        return at

    def of(self, words: list[str]) -> np.ndarray:
        """The sum of the words' scores."""
        if len(self) > min(CACHED, CACHED_SCORES // len(self.model.languages)):
            self.clear()
        rows = np.fromiter(map(self.__getitem__, words), np.int64, len(words))
        return self.matrix[rows].sum(0)


def predict(model: Model, texts: list[str | None], rows: _Rows) -> tuple[list[str], list[float]]:
    """The language and its share of certainty, of each text."""
    if not model.languages:
        return ["und"] * len(texts), [0.0] * len(texts)
    sums, sizes = np.zeros((len(texts), len(model.languages))), np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        for words in word_lists(text):
            sums[i] += rows.of(words)
            sizes[i] += len(words)
    sums -= sums.max(1, keepdims=True)
    shares = np.exp(sums / np.sqrt(np.maximum(1, sizes))[:, None])
    shares /= shares.sum(1, keepdims=True)
    best = sums.argmax(1)
    return (
        [model.languages[b] if n else "und" for b, n in zip(best, sizes, strict=True)],
        [float(s[b]) if n else 0.0 for s, b, n in zip(shares, best, sizes, strict=True)],
    )


def fit(docs: DataFrame, learnable, id_col: str, text_col: str, lang_col: str) -> Model:
    """The model from the rows for which learnable holds."""
    text, lang = F.col(text_col), F.col(lang_col)
    rows = docs.where(learnable & lang.isNotNull() & F.col(id_col).isNotNull() & text.isNotNull())
    own = rows.select(lang.alias("lang"), F.md5(F.col(id_col).cast("string")).alias("key"), F.md5(text).alias("hash"))
    languages = own.select("lang").distinct().count()
    if languages > MOST_LANGUAGES:
        raise ValueError(f"{languages} languages; at most {MOST_LANGUAGES} can be learned")
    chosen = sampled(own.distinct(), "lang", min(SAMPLE_DOCS, SAMPLE_TOTAL // max(1, languages)))  # SAMPLE_TOTAL rows at most
    window = F.substring(text, (F.pmod(F.xxhash64(text), F.greatest(F.lit(1), F.length(text) - SAMPLE_CHARS + 1)) + 1).cast("int"), F.lit(SAMPLE_CHARS))
    full = rows.select(lang.alias("lang"), F.md5(F.col(id_col).cast("string")).alias("key"), F.md5(text).alias("hash"), window.alias("text"))
    taken = full.join(F.broadcast(chosen), ["lang", "key", "hash"]).groupBy("lang", "key", "hash").agg(F.first("text").alias("text"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = sorted(x for b in batches for x in zip(*[b.column(c).to_pylist() for c in ("lang", "key", "hash", "text")], strict=True))
        whole = pickle.dumps(Model([(x[0], x[3]) for x in found]), protocol=5)
        for at in range(0, len(whole), PIECE):
            yield pa.RecordBatch.from_arrays([pa.array([at], pa.int64()), pa.array([whole[at : at + PIECE]], pa.binary())], ["at", "piece"])

    # one task has the sample; without any rows it makes a model of no language
    pieces = taken.repartition(1).mapInArrow(build, "at long, piece binary").collect()
    return pickle.loads(b"".join(r["piece"] for r in sorted(pieces, key=lambda r: r["at"]))) if pieces else Model([])


def identify(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", folds: int = 4, held: int = 2) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score. Learns from the documents whose crc32 of the id isn't ``held`` modulo ``folds``."""
    held_out = F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == held, F.lit(False))
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, ~held_out, id_col, text_col, lang_col))
    id_type = docs.schema[id_col].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = _Rows(model.value)
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                batch = whole.slice(at, 500)
                langs, scores = predict(model.value, batch.column("text").to_pylist(), rows)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    slim = docs.select(F.col(id_col).alias("doc_id"), held_out.alias("held_out"), F.col(text_col).alias("text"))
    return slim.mapInArrow(run, f"doc_id {id_type}, held_out boolean, lang_pred string, score double")


def op7_language(spark, sf_dir: str) -> DataFrame:
    """The language of every document."""
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang"))
