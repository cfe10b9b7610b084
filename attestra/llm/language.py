"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts are summed by Spark, for predictions from a bounded sample of labelled rows, for the pipeline from all; the matrix of
log probabilities (languages x buckets) is broadcast; texts are scored in batches with numpy: the
n-grams of many texts are one sparse matrix, multiplied by that one. Each text counts whole. More
languages than a broadcast may hold are taken in blocks, one pass over the texts each: what a text
has of its best language so far, and the sum over all, is carried on.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce
from math import exp
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from attestra.llm.common import discard, materialize, sliced

BUCKETS = 1 << 15
#: Lengths of the n-grams, in characters.
GRAMS = (2, 3)
#: Labelled rows that the model is fitted on, at most (about; drawn by a hash of the id).
TRAIN_ROWS = 20_000
#: Languages with fewer characters than this in the sample still count; a bucket never seen has this count.
SMOOTHING = 0.5
#: Cells of the broadcast matrix at most, 8 bytes each: 512 languages.
MATRIX_CELLS = 1 << 24
#: Languages that a task counts at once, 256 KB each.
COUNTED_LANGS = 256
#: Characters scored at once; longer texts are taken in pieces.
AT_ONCE = 1 << 18
OVERLAP = GRAMS[-1] - 1
#: Labelled rows below the bound that fit is held against, as a share, and how far below them it is, in parts of their distance to the median. Steps of fit that rows are told apart by, which bounds what is gathered for a bound.
CLEAN_SHARE, MARGIN, FIT_STEPS = 0.001, 0.5, 1000
LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"


def pieces(text: str) -> list[tuple[str, bool]]:
    """The text in lower case, line ends as blanks, with a blank on either side, in pieces of AT_ONCE characters that overlap by what an n-gram needs; whether a piece continues another."""
    padded = f" {text.lower()} ".replace("\n", " ")
    return [(padded[i : i + AT_ONCE + OVERLAP], i > 0) for i in range(0, max(1, len(padded) - OVERLAP), AT_ONCE)]


def hashed(parts: list[tuple[str, bool]], buckets: int = BUCKETS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each length of n-grams: the bucket of the one at each character of all pieces, and where each piece begins. ``buckets`` itself stands where there is none, or the piece before has it."""
    ends = np.cumsum([len(x) for x, _ in parts])
    begins = ends - [len(x) for x, _ in parts]
    more = begins[[c for _, c in parts]]
    c = np.frombuffer("".join(x for x, _ in parts).encode("utf-32-le", "surrogatepass"), np.uint32)
    for n in GRAMS:
        h = np.full(len(c) - n + 1, n, np.uint32)
        for i in range(n):
            h = (h ^ c[i : i + len(h)]) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        out = np.full(len(c), buckets, np.int32)
        out[: len(h)] = h % buckets
        for i in range(1, n):
            out[ends - i] = buckets
        for i in range(OVERLAP - n + 1):
            out[more + i] = buckets
        yield out, begins


def gram_buckets(text: str, buckets: int = BUCKETS) -> Iterator[np.ndarray]:
    """Buckets of the text's n-grams."""
    for part in pieces(text):
        for h, _ in hashed([part], buckets):
            yield h[h < buckets]


def in_batches(texts: list[str]) -> Iterator[tuple[np.ndarray, list[tuple[str, bool]]]]:
    """(text of each piece, pieces), about AT_ONCE characters at a time."""
    at, parts, n = [], [], 0
    for i, text in enumerate(texts):
        for part in pieces(text):
            at.append(i)
            parts.append(part)
            n += len(part[0])
            if n >= AT_ONCE:
                yield np.array(at), parts
                at, parts, n = [], [], 0
    if parts:
        yield np.array(at), parts


def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a partition: lang, bucket, n; in several parts where it has many languages."""
    counts: dict[str, np.ndarray] = {}

    def told() -> Iterator[pa.RecordBatch]:
        for lang, own in counts.items():
            (at,) = own[:-1].nonzero()
            yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at), pa.string()), "bucket": at.astype(np.int32), "n": own[at]})

    for batch in sliced(batches):
        langs, texts = batch.column("lang").to_pylist(), batch.column("text").to_pylist()
        for lang in set(langs):
            if lang not in counts and len(counts) >= COUNTED_LANGS:
                yield from told()
                counts.clear()
            own = counts.setdefault(lang, np.zeros(BUCKETS + 1, np.int64))
            for _, parts in in_batches([t for x, t in zip(langs, texts, strict=True) if x == lang]):
                for h, _ in hashed(parts):
                    own += np.bincount(h, minlength=BUCKETS + 1)
    yield from told()


class Sums(NamedTuple):
    """What a text has so far: its best language, the log probability of its n-grams there, the sum over languages of their probability in parts of that, and how many n-grams."""

    lang: str | None
    top: float
    rest: float
    n: int


NOTHING = Sums(None, float("-inf"), 0.0, 0)


def better(a: Sums, b: Sums) -> Sums:
    """Both together; of equals, the first."""
    if a.lang is None or b.lang is None:
        return b if a.lang is None else a
    a, b = (b, a) if b.top > a.top else (a, b)
    return a._replace(rest=a.rest + b.rest * exp(b.top - a.top))


class LanguageModel:
    """langs in order; logs: log probabilities, languages x buckets, and a last column of zeros. Languages are weighed alike."""

    def __init__(self, langs: list[str], counts: np.ndarray) -> None:
        smooth = counts + SMOOTHING
        self.langs, self.buckets = langs, counts.shape[1]
        self.totals = smooth.sum(axis=1)
        self.logs = np.zeros((len(langs), self.buckets + 1))
        self.logs[:, :-1] = np.log(smooth / self.totals[:, None])

    def judged(self, text: str | None) -> tuple[str, float]:
        """The likeliest language and its posterior. A text without a letter, or null, is unknown, at 0."""
        return self.explained([text])[0][:2]

    def explained(self, texts: list[str | None]) -> list[tuple[str, float, float]]:
        """Of each text: the likeliest language, its posterior, and the mean log probability of an n-gram in it (-inf for unknown)."""
        return [(UNKNOWN, 0.0, float("-inf")) if lang is None else (lang, 1 / rest, top / n) for lang, top, rest, n in self.sums(texts)]

    def sums(self, texts: list[str | None]) -> list[Sums]:
        out: list[Sums] = [NOTHING] * len(texts)
        some = [i for i, t in enumerate(texts) if self.langs and t and LETTER.search(t)]
        total, n = np.zeros((len(self.langs), len(some))), np.zeros(len(some), np.int64)
        for at, parts in in_batches([texts[i] for i in some]):
            for h, begins in hashed(parts, self.buckets):
                np.add.at(n, at, np.add.reduceat(h < self.buckets, begins, dtype=np.int64))
                for lang, logs in zip(total, self.logs, strict=True):
                    np.add.at(lang, at, np.add.reduceat(logs[h], begins))
        for j, i in enumerate(some):
            own = total[:, j]
            best = int(own.argmax())
            out[i] = Sums(self.langs[best], float(own[best]), float(np.exp(own - own[best]).sum()), int(n[j]))
        return out

    def fit_to_others(self, text: str, own: str) -> float:
        """The mean log probability of an n-gram of a text that was counted for a language (of this model or another), once its counts are taken out; -inf without a letter."""
        if not LETTER.search(text):
            return float("-inf")
        seen = sum(np.bincount(h, minlength=self.buckets) for h in gram_buckets(text, self.buckets))
        (at,) = seen.nonzero()
        seen, n = seen[at], int(seen.sum())
        total = self.logs[:, at] @ seen
        if own in self.langs:
            i = self.langs.index(own)
            others = np.maximum(np.exp(self.logs[i, at]) * self.totals[i] - seen, SMOOTHING)
            total[i] = seen @ np.log(others / max(self.totals[i] - n, SMOOTHING))
        return float(total.max() / n)


class LanguageModels:
    """A model of any number of languages, in blocks of as many as a broadcast may hold. counts: lang, bucket, n, written before. The driver holds one block at a time."""

    def __init__(self, counts: DataFrame) -> None:
        self.counts, self.buckets = counts, BUCKETS
        self.langs = sorted(r.lang for r in counts.select("lang").distinct().collect())
        self.each = max(1, MATRIX_CELLS // BUCKETS)

    def blocks(self) -> Iterator[LanguageModel]:
        """At least one, which may know no language."""
        for begin in range(0, max(1, len(self.langs)), self.each):
            langs = self.langs[begin : begin + self.each]
            table = self.counts.where(F.col("lang").between(langs[0], langs[-1])).toArrow() if langs else None
            matrix = np.zeros((len(langs), BUCKETS))
            if table is not None:
                of = {x: i for i, x in enumerate(langs)}
                matrix[[of[x] for x in table.column("lang").to_pylist()], table.column("bucket").to_numpy()] = table.column("n").to_numpy()
            yield LanguageModel(langs, matrix)

    def judged(self, text: str | None) -> tuple[str, float]:
        """As LanguageModel.judged, over all blocks."""
        found = reduce(better, (m.sums([text])[0] for m in self.blocks()))
        return (UNKNOWN, 0.0) if found.lang is None else (found.lang, 1 / found.rest)


def held_out(id_col: Column) -> Column:
    """Whether crc32 of the id as text leaves 2 when divided by 4. A null id counts as an empty text."""
    return F.crc32(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")) % 4 == 2


def training_sample(labelled: DataFrame, rows: int = TRAIN_ROWS) -> DataFrame:
    """labelled: doc_id, text, lang. About ``rows`` of those that have text and language."""
    labelled = labelled.where("text IS NOT NULL AND lang IS NOT NULL")
    share = rows / max(1, labelled.count())
    return labelled.where(F.pmod(F.xxhash64(F.coalesce("doc_id", F.lit(0)), F.lit(7)), F.lit(1 << 30)) < int(min(1, share) * (1 << 30)))


def train(labelled: DataFrame, rows: int = TRAIN_ROWS) -> LanguageModels:
    """labelled: doc_id, text, lang. Rows without text or language are passed over; without any, the model knows no language. One row per (language, bucket) of a block reaches the driver at once."""
    return fitted(training_sample(labelled, rows))


def fitted(sample: DataFrame) -> LanguageModels:
    counts = sample.select("lang", "text").mapInArrow(counted, "lang string, bucket int, n bigint").groupBy("lang", "bucket").agg(F.sum("n").alias("n"))
    return LanguageModels(materialize(counts, "grams"))


def least_fits(models: LanguageModels, labelled: DataFrame) -> tuple[dict[str, float], float]:
    """The fit under which a text isn't in a language, for each, and for any other: below all but CLEAN_SHARE of the rows it was learned from, each scored without its own counts, by MARGIN of their distance to the median.

    No language is held to more than the rows of all are: one that few rows have explains less of a text, and by the others' rows would never be known.
    """
    rows = labelled.select("lang", "text", F.lit(float("-inf")).alias("fit"))
    written = None
    for model in models.blocks():
        shared = labelled.sparkSession.sparkContext.broadcast(model)

        def score(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches):
                found = [max(fit, shared.value.fit_to_others(t, x)) for x, t, fit in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
                yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(found, pa.float64())], ["lang", "text", "fit"])

        if not model.langs:
            break
        rows = rows.mapInArrow(score, "lang string, text string, fit double")
        if len(models.langs) > models.each:  # or all blocks would be in memory together
            rows, before = materialize(rows, "fits"), written
            if before is not None:
                discard(before)
            written = rows
    stepped = F.floor(F.col("fit") * FIT_STEPS) / FIT_STEPS
    found = rows.where(F.col("fit") > float("-inf")).rollup("lang").agg(F.percentile(stepped, [CLEAN_SHARE, 0.5]).alias("at")).collect()
    bounds = {r.lang: r["at"][0] - MARGIN * (r["at"][1] - r["at"][0]) for r in found if r["at"]}
    overall = bounds.pop(None, float("-inf"))
    return {lang: min(bound, overall) for lang, bound in bounds.items()}, overall


def scored(rows: DataFrame, models: LanguageModels, at: int) -> DataFrame:
    """rows, in their columns, with what the models make of the text in column number ``at``: own_lang (null: unknown), own_top, own_rest, own_n."""
    out = rows.select("*", F.lit(None).cast("string").alias("own_lang"), F.lit(float("-inf")).alias("own_top"), F.lit(0.0).alias("own_rest"), F.lit(0).cast("long").alias("own_n"))
    schema = out.schema
    types = (pa.string(), pa.float64(), pa.float64(), pa.int64())
    for model in models.blocks():
        shared = rows.sparkSession.sparkContext.broadcast(model)

        def add(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches):
                before = map(Sums._make, zip(*(c.to_pylist() for c in batch.columns[-4:]), strict=True))
                found = [better(a, b) for a, b in zip(before, shared.value.sums(batch.column(at).to_pylist()), strict=True)]
                columns = zip(*found, strict=True) if found else [()] * 4
                yield pa.RecordBatch.from_arrays([*batch.columns[:-4], *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], batch.schema.names)

        out = out.mapInArrow(add, schema)
        if model.langs and model.langs[-1] != models.langs[-1]:  # or all blocks would be in memory together
            out = materialize(out, "languages")
    return out


def identify(docs: DataFrame, models: LanguageModels, text_col: str = "text", keep: tuple[str, ...] = ()) -> DataFrame:
    """lang_pred and score of every row's whole text, after the columns in keep."""
    found = scored(docs.select(*keep, F.col(text_col).alias("text_to_judge")), models, len(keep))
    score = F.when(F.col("own_lang").isNull(), 0.0).otherwise(1 / F.col("own_rest"))
    return found.select(*keep, F.coalesce("own_lang", F.lit(UNKNOWN)).alias("lang_pred"), score.alias("score"))


def predicted_languages(docs: DataFrame) -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score.

    Fitted on text and lang of rows that are not held out; lang, source and id are no input of a prediction.
    ``und`` (score 0) for a text that is null or has no letter, and for all if no row can be learned from. Ties
    go to the first language by code point. Other columns are not looked at.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang").withColumn("held_out", held_out(F.col("doc_id")))
    model = train(docs.where("NOT held_out").select("doc_id", "text", "lang"))
    return identify(docs, model, keep=("doc_id", "held_out"))


def in_known_language(docs: DataFrame, least: float = 0.5) -> DataFrame:
    """docs, in their columns, without those that the model rejects: no letter, no language with a posterior of ``least``, or none that explains the text's n-grams (``least_fits``). A declared language plays no part in that.

    The model is fitted on all labelled rows that aren't held out, and the bounds are from all of them: a language that few rows have is known too.
    """
    labelled = docs.where(~held_out(F.col("doc_id"))).select("text", "lang").where("text IS NOT NULL AND lang IS NOT NULL")
    models = fitted(labelled)
    bounds, overall = least_fits(models, labelled)
    plain = docs.toDF(*(f"c{i}" for i in range(len(docs.columns))))  # other names may have dots, which mapInArrow takes for fields
    known = scored(plain, models, docs.columns.index("text"))
    known = known.where(F.col("own_lang").isNotNull() & (1 / F.greatest("own_rest", F.lit(1.0)) >= least))
    lower = docs.sparkSession.createDataFrame([(x, b) for x, b in bounds.items() if b < overall], "own_lang string, bound double")  # at most one row a language, as the model has
    known = known.join(F.broadcast(lower), "own_lang", "left").where(F.try_divide("own_top", "own_n") >= F.coalesce("bound", F.lit(overall)))
    return known.select(*plain.columns).toDF(*docs.columns)
