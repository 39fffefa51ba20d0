"""Language identification by error-correcting output codes over character n-grams.

Every language has a codeword; a binary classifier on hashed byte n-grams predicts each bit.  A text's
logits decode to the codeword with the least loss, weighted by how well each bit classifier did on rows it
was not fitted on.  The margin to the second codeword gives the score and flags ambiguous texts.

The classifiers are fitted on a sample of at most FIT_ROWS labelled rows a language (the documented bound);
its n-gram counts are made on the executors, over whole texts, and reach the driver as sparse rows.
Prediction reads every whole text, in blocks of BLOCK_BYTES, so that a text of any length needs few arrays.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tracelake.llm.common import TEXT_ROWS, arrow_rows, frugal, mix, slices, text_bytes

#: Labelled rows a language that are fitted, at most.
FIT_ROWS = 200
BUCKET_BITS = 13
#: Hash buckets of each n-gram order, and the orders in bytes.
BUCKETS, ORDERS = 1 << BUCKET_BITS, (1, 2, 3, 4)
#: Bytes whose n-grams are looked up at once.
BLOCK_BYTES = 1 << 17
#: Share of each language's sampled rows that only weighs the bits.
WEIGHED = 0.2
#: Below this score a prediction counts as ambiguous.
AMBIGUOUS = 0.55
UNKNOWN = "und"
_LETTER = regex.compile(r"\p{L}")
_ODD = np.uint64(0x9E3779B97F4A7C15)


# ---------------------------------------------------------------- codewords
def codewords(n: int, seed: int = 7) -> np.ndarray:
    """n codewords of -1/+1: all distinct splits up to six languages, else the widest of random codes."""
    if n < 2:
        return np.ones((n, 1), np.int8)
    if n <= 6:
        cuts = range(1, 1 << (n - 1))
        return np.array([[1 if n - 1 == i or not c >> i & 1 else -1 for c in cuts] for i in range(n)], np.int8)
    rng, length, best, width = np.random.Generator(np.random.PCG64(seed)), max(15, int(10 * np.log2(n))), None, -1
    for _ in range(500):
        code = rng.choice(np.array([-1, 1], np.int8), (n, length))
        apart = (length - code.astype(int) @ code.T.astype(int)) // 2 + length * np.eye(n, dtype=int)
        if not (np.abs(code.sum(axis=0)) == n).any() and apart.min() > width:
            best, width = code, int(apart.min())
    return best


# ---------------------------------------------------------------- n-grams
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[48:58] = 48
_FOLD[9:14] = 32


def gram_places(data: np.ndarray, offsets: np.ndarray, block: int = BLOCK_BYTES) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, row) of each n-gram, block by block and in it one order after the other, rows ascending.

    ASCII capitals count as small letters; digits fall together, and so does white space of one byte, so that
    layout says little.  A block reads over its end by what its last n-grams need, within the same text.
    """
    for a in range(0, data.size, block):
        b = min(a + block, data.size)
        part = _FOLD[data[a : b + max(ORDERS) - 1]].astype(np.uint64)
        first, last = (int(np.searchsorted(offsets, x, "right")) - 1 for x in (a, b - 1))
        inner = np.clip(offsets[first : last + 2], a, b) - a
        row = np.repeat(np.arange(first, last + 1), np.diff(inner))
        room = offsets[row + 1] - np.arange(a, b)  # bytes left in the text
        h = np.zeros(b - a, np.uint64)
        for order in ORDERS:
            n = min(b - a, part.size - order + 1)
            if n <= 0:
                break
            h = h[:n] * _ODD + part[order - 1 : order - 1 + n] + np.uint64(1)
            inside = room[:n] >= order
            place = (mix(h) >> np.uint64(64 - BUCKET_BITS)).astype(np.int64) + (order - 1) * BUCKETS
            yield place[inside], row[:n][inside]


def has_letter(data: np.ndarray, offsets: np.ndarray, block: int = BLOCK_BYTES) -> np.ndarray:
    """Which texts have a letter; a long text is read in pieces, and no further than its first letter."""
    found = np.zeros(offsets.size - 1, bool)
    for i, (lo, hi) in enumerate(zip(offsets.tolist(), offsets[1:].tolist())):
        at = lo
        while at < hi and not found[i]:  # pieces overlap by the bytes of a character that may be cut
            found[i] = _LETTER.search(data[at : min(hi, at + block + 3)].tobytes().decode(errors="ignore")) is not None
            at += block
    return found


DIMENSIONS = BUCKETS * len(ORDERS)


@dataclass
class Model:
    """Everything a prediction needs; a few hundred KB."""

    languages: list[str]
    code: np.ndarray  # [languages, bits]
    weight: np.ndarray  # [bits]
    coefficients: np.ndarray  # [DIMENSIONS, bits]
    bias: np.ndarray  # [bits]

    def logits(self, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Logits of each text's bits, from its UTF-8 bytes."""
        total = np.zeros((offsets.size - 1, self.bias.size), np.float64)
        count = np.zeros(offsets.size - 1)
        for place, row in gram_places(data, offsets):
            if place.size:
                starts = np.flatnonzero(np.concatenate(([True], row[1:] != row[:-1])))
                ends = np.append(starts[1:], row.size)
                found, ones = self.coefficients.take(place, axis=0), np.ones(place.size, np.float32)
                total[row[starts]] += [ones[a:b] @ found[a:b] for a, b in zip(starts.tolist(), ends.tolist())]  # adds up rows
                count[row[starts]] += ends - starts
        return total / np.maximum(count, 1)[:, None] + self.bias

    def decode(self, logits: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(language number, score): softmax over the negative weighted logistic losses, 0 to 1."""
        loss = np.logaddexp(0.0, -logits[:, None, :] * self.code[None]) @ self.weight
        loss -= loss.min(axis=1, keepdims=True)
        chance = np.exp(-loss)
        chance /= chance.sum(axis=1, keepdims=True)
        return chance.argmax(axis=1), chance.max(axis=1)


def weighing(group: np.ndarray) -> np.ndarray:
    """Which rows only weigh the bits: the last of every 1 / WEIGHED rows of each group; small groups are fitted whole."""
    rank = np.zeros(group.size, int)
    for g in np.unique(group):
        rank[group == g] = np.arange((group == g).sum())
    every = round(1 / WEIGHED)
    return rank % every == every - 1


def fit(counts: list[tuple[np.ndarray, np.ndarray]], labels: list[str], steps: int = 100) -> Model | None:
    """Logistic bit classifiers by gradient steps on n-gram shares, each on some rows of every language.

    ``counts`` has the n-grams (place, times) of each row, the languages by turns; rows stay sparse.
    """
    languages = sorted(set(labels))
    if not languages:
        return None
    code = codewords(len(languages))
    y = code[[languages.index(x) for x in labels]].astype(np.float64)
    rows = [(place, (times / max(1, times.sum())).astype(np.float32)) for place, times in counts]
    squares = np.zeros(DIMENSIONS)
    for place, value in rows:
        squares[place] += value.astype(np.float64) ** 2
    scale = (1.0 / np.sqrt(np.maximum(squares / len(labels), 1e-12) * (DIMENSIONS / 8))).astype(np.float32)
    rows = [(place, (value * scale[place])[:, None]) for place, value in rows]  # frequent and rare n-grams weigh alike
    group = np.array([languages.index(z) for z in labels])
    held = weighing(group)
    even = 1 / (np.bincount(group[~held], minlength=len(languages))[group] * len(set(group[~held].tolist())))  # every language weighs alike
    w, b = np.zeros((DIMENSIONS, code.shape[1]), np.float32), np.zeros(code.shape[1])
    step_w, step_b = np.zeros_like(w), np.zeros_like(b)

    def answer(i: int) -> np.ndarray:
        place, value = rows[i]
        return (w.take(place, axis=0) * value).sum(axis=0) + b

    parts = np.array_split(np.flatnonzero(~held), max(1, len(labels) // (10 * len(languages))))
    for n in range(steps if len(languages) > 1 else 0):
        step_w = 0.9 * step_w - 1e-4 * w
        step_b = 0.9 * step_b
        for i in parts[n % len(parts)].tolist():
            place, value = rows[i]
            pull = y[i] * even[i] * len(parts) / (1.0 + np.exp(np.clip(y[i] * answer(i), -30, 30)))
            step_w[place] += value * pull.astype(np.float32)
            step_b += pull
        w, b = w + 0.5 * step_w, b + 0.5 * step_b
    right = np.array([answer(i) * y[i] > 0 for i in np.flatnonzero(held).tolist()]).reshape(-1, code.shape[1])
    weight = np.clip(2 * (right.mean(axis=0) if len(right) else np.ones(code.shape[1])) - 1, 0.05, 1.0)
    return Model(languages, code.astype(np.float64), weight, w * scale[:, None], b)


# ---------------------------------------------------------------- Spark
def train(labelled: DataFrame, fit_rows: int = FIT_ROWS) -> Model | None:
    """A model of the non-null languages in ``labelled`` (doc_id, text, lang); None without any.

    The rows fitted are those with the smallest hash of their id and text in each language; Spark keeps
    only so many a language before it shuffles.
    """
    order = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", "text"), "doc_id")
    known = labelled.where("lang is not null and text is not null").select("doc_id", "text", "lang")
    sample = known.withColumn("n", F.row_number().over(order)).where(F.col("n") <= fit_rows)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            data, offsets = text_bytes(batch.column("text"))
            places, times = [], []
            for lo, hi in zip(offsets.tolist(), offsets[1:].tolist()):
                total = np.zeros(DIMENSIONS, np.int64)
                for place, _ in gram_places(data[lo:hi], np.array([0, hi - lo])):
                    total += np.bincount(place, minlength=DIMENSIONS)
                found = np.flatnonzero(total)
                places.append(found.astype("<u2").tobytes())
                times.append(total[found].astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("n"), pa.array(places, pa.binary()), pa.array(times, pa.binary())], names=["lang", "n", "place", "times"])

    with arrow_rows(labelled.sparkSession, TEXT_ROWS):
        rows = sample.mapInArrow(frugal(count), "lang string, n int, place binary, times binary").collect()  # fit_rows a language, sparse
    rows.sort(key=lambda r: (r.n, r.lang))
    return fit([(np.frombuffer(r.place, "<u2"), np.frombuffer(r.times, "<u4")) for r in rows], [r.lang for r in rows])


_NEW = T.StructType([T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())])


def _judged(docs: DataFrame, model: Model | None, result: Callable, schema: Callable[[list], list]) -> DataFrame:
    """``result`` of each batch of ``docs`` with its languages, scores and ambiguity.

    Columns go by their place, c0, c1 and so on, so that none can clash; each row is sent once.
    ``schema`` turns the fields of those columns into the fields of the result.
    """
    text = f"c{docs.columns.index('text')}"
    plain = docs.toDF(*[f"c{i}" for i in range(len(docs.columns))])
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for batch in slices(batches, text):
            data, offsets = text_bytes(batch.column(text))
            if m is None:
                best, score, letters = np.zeros(batch.num_rows, int), np.zeros(batch.num_rows), np.zeros(batch.num_rows, bool)
            else:
                letters = has_letter(data, offsets)
                best, score = m.decode(m.logits(data, offsets))
            said = np.array([m.languages[i] if ok else UNKNOWN for i, ok in zip(best.tolist(), letters.tolist())], object)
            score = np.where(letters, score, 0.0)
            yield result(batch, said, score, letters & (score < AMBIGUOUS))

    return plain.mapInArrow(frugal(run), T.StructType(schema(plain.schema.fields)))


def predict(docs: DataFrame, model: Model | None) -> DataFrame:
    """``docs`` with lang_pred, score and ambiguous.

    lang_pred is ``und``, with score 0, for a null text and one without any letter, and for all texts if
    no language was learned; so an empty table stays empty.  Only text is looked at: repeated rows get equal
    answers, and equal losses decode to the language that comes first by code point.  A text of any length is
    read whole.  Further columns pass through; of those that have a result's name, the result's stays.
    """
    names = [c for c in docs.columns if c not in ("lang_pred", "score", "ambiguous")]

    def added(batch, said, score, ambiguous):
        new = [pa.array(said, pa.string()), pa.array(score), pa.array(ambiguous)]
        return pa.RecordBatch.from_arrays([*batch.columns, *new], names=[*batch.schema.names, "lang_pred", "score", "ambiguous"])

    found = _judged(docs.select(*names), model, added, lambda fields: [*fields, *_NEW])
    return found.toDF(*names, "lang_pred", "score", "ambiguous")


def is_held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 5, is 0; false for a null id."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fitted(docs: DataFrame) -> Model | None:
    return train(docs.where(~is_held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))


def known_language(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` whose language is found without ambiguity, with their own columns.

    Null and empty texts, and those without a letter, go.  Repeated rows stay or go together; a null doc_id
    makes no difference.  Columns of any further name pass unchanged.
    """

    def kept(batch, said, score, ambiguous):
        return batch.filter(pa.array((said != UNKNOWN) & ~ambiguous))

    return _judged(docs, fitted(docs), kept, lambda fields: fields).toDF(*docs.columns)


def predictions(docs: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, lang_pred, score, ambiguous): as ``predict``, without sending the texts back."""

    def answered(batch, said, score, ambiguous):
        return pa.RecordBatch.from_arrays([batch.column("c0"), pa.array(said, pa.string()), pa.array(score), pa.array(ambiguous)], names=["doc_id", *_NEW.names])

    rows = docs.select(F.col("doc_id").cast("long"), "text")
    return _judged(rows, model, answered, lambda _: [T.StructField("doc_id", T.LongType()), *_NEW])


def op5_language_id(spark, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    found = predictions(docs, fitted(docs))
    return found.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous")
