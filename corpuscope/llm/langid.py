"""Language identification with error-correcting output codes over byte n-grams."""

from __future__ import annotations

import itertools
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpuscope.llm.learning import bounded_sample, held_out, logistic
from corpuscope.llm.registry import query, table
from corpuscope.llm.textbytes import CHUNK, flat, row_groups
from corpuscope.session import stored

#: Labelled documents that the model is fitted on, shared evenly by the languages.
FIT_ROWS = 2000
#: Slots of hashed bigrams and trigrams.
SLOTS = 4096
#: A text is ambiguous if the best language's probability is below this.
SURE = 0.5
#: The prediction for texts without letters.
UNKNOWN = "und"

# letters keep their (lower-case) byte, all else is one separator
_LETTERS = np.zeros(256, dtype=np.uint8)
_LETTERS[128:] = np.arange(128, 256)
for _upper, _lower in zip(range(65, 91), range(97, 123), strict=True):
    _LETTERS[_upper] = _LETTERS[_lower] = _lower


@dataclass
class LanguageModel:
    """Languages, their codewords (a row of signs each) and the weights of the bit classifiers."""

    languages: list[str]
    codes: np.ndarray
    weights: np.ndarray


def code_matrix(languages: int) -> np.ndarray:
    """Codewords as rows of signs: all splits of up to 6 languages, random ones of more.

    Random codewords are drawn again until any two differ in a quarter of their bits.
    """
    if languages <= 6:
        splits = [(1, *rest) for rest in itertools.product((1, -1), repeat=max(0, languages - 1))]
        columns = [c for c in splits if -1 in c]
        return np.array(columns, dtype=float).T.reshape(languages, -1)
    random = np.random.default_rng(languages)
    bits = 10 * int(languages).bit_length()
    codes = random.choice((-1.0, 1.0), (languages, bits))
    for row in range(languages):
        while row and (codes[row] * codes[:row] < 0).sum(axis=1).min() < bits / 4:
            codes[row] = random.choice((-1.0, 1.0), bits)
    return codes[:, np.abs(codes.sum(axis=0)) < languages]


def _counts(text: np.ndarray) -> np.ndarray:
    """Counts of the hashed bigrams and trigrams of one text, taken in stretches of bounded size."""
    counts = np.zeros(SLOTS, dtype=np.int64)
    for at in range(0, max(1, len(text) - 1), CHUNK):
        letters = _LETTERS[text[at : at + CHUNK + 2]].astype(np.uint32)
        own = min(CHUNK, len(letters))
        two = letters[:-1] * np.uint32(257) + letters[1:]
        use = two > 0
        slots = (two * np.uint32(2654435761)) >> np.uint32(21)
        counts += np.bincount(slots[:own][use[:own]], minlength=SLOTS)  # the lower half
        three = two[:-1] * np.uint32(8191) + letters[2:] + np.uint32(1)
        use = (two[:-1] > 0) & (letters[2:] + letters[1:-1] > 0)
        slots = ((three * np.uint32(2246822519)) >> np.uint32(21)) + np.uint32(2048)
        counts += np.bincount(slots[:own][use[:own]], minlength=SLOTS)
    return counts


def _features(data: np.ndarray, offsets: np.ndarray, first: int, last: int) -> np.ndarray:
    rows = np.zeros((last - first, SLOTS), dtype=np.float32)
    for row in range(first, last):
        rows[row - first] = _counts(data[offsets[row] : offsets[row + 1]])
    rows = np.sqrt(rows)
    return rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)


def _slices(offsets: np.ndarray) -> Iterator[tuple[int, int]]:
    for first, last in row_groups(offsets):
        for at in range(first, last, 256):
            yield at, min(last, at + 256)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = flat(batch.column(1))
        for first, last in _slices(offsets):
            rows = [row.tobytes() for row in _features(data, offsets, first, last)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).slice(first, last - first), pa.array(rows, pa.binary())], names=["lang", "features"]
            )


def fit_languages(docs: DataFrame, most: int = FIT_ROWS) -> LanguageModel:
    """Fit one classifier for each bit of the codewords, on ``most`` labelled documents and one for each language at most.

    Learns from ``text`` and ``lang`` of rows that are not held out and have both; which rows is
    decided by a hash of id and text, and equal rows count once. The sample's n-gram features are all
    that reaches the driver, 16 KB a row, in one array.
    """
    learnable = docs.select("doc_id", "lang", "text").filter(
        ~held_out(F.col("doc_id")) & F.col("lang").isNotNull() & F.col("text").isNotNull()
    )
    sample = bounded_sample(learnable, "lang", ("doc_id", "text"), most, even=True).select("lang", "text")
    labels, x = _gathered(stored(sample.mapInArrow(_featured, "lang string, features binary"), "features"))
    languages = sorted(set(labels))
    codes = code_matrix(len(languages)) if languages else np.zeros((0, 0))
    if codes.size == 0:
        return LanguageModel(languages, codes, np.zeros((SLOTS, codes.shape[1] if codes.ndim == 2 else 0)))
    number = {language: i for i, language in enumerate(languages)}
    y = codes[[number[label] for label in labels]]
    return LanguageModel(languages, codes, logistic(x, y, 1e-4, 120))


def _gathered(rows: DataFrame) -> tuple[list[str], np.ndarray]:
    """Labels and features of stored rows, filled into one array row by row, in an order of their own."""
    x = np.empty((rows.count(), SLOTS), dtype=np.float32)
    labels = []
    ordered = rows.orderBy("lang", "features")  # the same sums whatever order the rows came in
    for number, row in enumerate(ordered.toLocalIterator()):
        labels.append(row.lang)
        x[number] = np.frombuffer(row.features, dtype=np.float32)
    return labels, x


def _has_letter(text: str | None) -> bool:
    return bool(text) and any(map(str.isalpha, text))


def _losses(margins: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """The sum of logistic losses of each row against each codeword.

    log(1 + exp(-m c)) is the mean of its values for both signs of c, less c m / 2, so codewords are
    compared by one product of matrices whatever their number.
    """
    margins = margins.astype(np.float64)
    both = (np.logaddexp(0, -margins) + np.logaddexp(0, margins)).sum(axis=1, keepdims=True) / 2
    return both - margins @ codes.T / 2


def _predict(model: LanguageModel):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = flat(batch.column(1))
            text = batch.column(1)
            ascii_letter = np.zeros(256, dtype=np.int64)
            ascii_letter[65:91] = ascii_letter[97:123] = 1
            for first, last in _slices(offsets):
                x = _features(data, offsets, first, last)
                margins = x @ model.weights
                # loss-weighted decoding: the codeword with the least sum of logistic losses
                losses = _losses(margins, model.codes)
                odds = np.exp(losses.min(axis=1, keepdims=True) - losses) if len(model.languages) else losses
                best = losses.argmin(axis=1) if len(model.languages) else np.zeros(last - first, dtype=int)
                named, scores = [], []
                for row in range(first, last):
                    stretch = data[offsets[row] : offsets[row + 1]]
                    known = bool(ascii_letter[stretch].any()) or _has_letter(text[row].as_py())
                    known = known and bool(model.languages)
                    named.append(model.languages[best[row - first]] if known else UNKNOWN)
                    chance = odds[row - first]
                    scores.append(float(chance[best[row - first]] / chance.sum()) if known else 0.0)
                yield pa.RecordBatch.from_arrays(
                    [
                        batch.column(0).slice(first, last - first),
                        pa.array(named, pa.string()),
                        pa.array(scores, pa.float64()),
                        pa.array([score < SURE for score in scores]),
                        *(batch.column(i).slice(first, last - first) for i in range(2, batch.num_columns)),
                    ],
                    names=["doc_id", "lang_pred", "score", "ambiguous", *batch.schema.names[2:]],
                )

    return run


def identify(docs: DataFrame, model: LanguageModel, extra: tuple[str, ...] = ()) -> DataFrame:
    """The language of every whole text: ``doc_id``, ``lang_pred``, ``score``, ``ambiguous``, then ``extra`` columns.

    Bit classifiers score the n-grams of the whole text; the codeword with the least
    loss names the language, ``score`` is its share of exp(-loss), and below one half
    the text is ambiguous. A null text or one without a letter is ``und`` with score 0;
    so is every text if no language was learned. Each row is judged alone: repeated
    rows get the same answer, null ids and extra columns do no harm.
    """
    kinds = {f.name: f.dataType.simpleString() for f in docs.schema.fields}
    schema = f"doc_id {kinds['doc_id']}, lang_pred string, score double, ambiguous boolean"
    schema = ", ".join([schema, *(f"`{c}` {kinds[c]}" for c in extra)])
    return docs.select("doc_id", "text", *extra).mapInArrow(_predict(model), schema)


@query("op6_language_codes")
def op6_language_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every document, learned from those whose id is not held out."""
    docs = table(spark, sf_dir, "documents")
    return identify(docs, fit_languages(docs)).select(
        "doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score", "ambiguous"
    )
