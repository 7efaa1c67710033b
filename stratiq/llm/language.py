"""Language identification: multinomial naive Bayes over hashed character n-grams.

Training counts the hashed 1-, 2- and 3-grams of a bounded sample of labelled
rows for each language, in tasks that send one partial count matrix each.  The
log-probability matrix, buckets by languages, is broadcast; ``fit`` checks its
size.  Scoring hashes many texts at once: their n-grams are the rows of a sparse
matrix of counts, whose product with the broadcast matrix is one sum for each
run of n-grams in numpy.

The sample holds about ``per_language`` rows of each language, chosen by a hash
of id and text (rows without id also by their place in the table): the only bound, and one on fitting alone.  Every text is scored
whole.  The prior of a language is its share of all labelled rows.

Defined results
---------------
* Null text, or text without a letter (Unicode category L): language ``und``, score 0.
* Rows without a language do not train.  If no row trains, every text is ``und``.
* Equal posteriors go to the language first in code point order.
* Repeated rows train as often as they occur and give equal results; an empty
  table gives an empty result.
* Further columns are ignored by ``fit`` and kept by ``annotate``; ValueError is
  raised if the input already has a column named like an output.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import drawn, own_place

BITS = 16
MULT = np.uint32(2654435761)
STEP = np.uint32(0x9E3779B1)
#: Characters hashed in one go.
BLOCK = 1 << 16
#: Bytes of the matrix at most.
MOST_BYTES = 256 << 20


def has_letter(text: str) -> bool:
    return any(map(str.isalpha, text))


def grams(texts: list[str], bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Buckets of all 1-, 2- and 3-grams of the lower-cased texts, and the text of each; a block of characters at a time.

    No n-gram crosses texts.
    """
    coded = [np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), np.uint32) for t in texts]
    codes, owners = np.concatenate([*coded, np.zeros(0, np.uint32)]), np.repeat(np.arange(len(texts)), [len(c) for c in coded])
    shift = np.uint32(32 - bits)
    for start in range(0, len(codes), BLOCK):
        back = min(2, start)  # characters of the block before, for the grams that end in this one
        owner = owners[start - back : start + BLOCK]
        one = (codes[start - back : start + BLOCK] + np.uint32(1)) * MULT
        two = (one[:-1] ^ (one[:-1] >> np.uint32(15))) * STEP + one[1:]
        three = (two[:-1] ^ (two[:-1] >> np.uint32(13))) * STEP + one[2:]
        two, three = two * MULT, three * MULT
        for width, hashed in ((1, one), (2, two), (3, three)):
            skip = max(0, back - width + 1)
            first, last = owner[: len(hashed)][skip:], owner[width - 1 :][skip:]
            yield hashed[skip:][first == last] >> shift, last[first == last]


@dataclass(frozen=True)
class Model:
    languages: list[str]
    #: float32, buckets by languages.
    logs: np.ndarray
    #: Of each language: the logarithm of its share of the labelled rows.
    prior: np.ndarray

    def score(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        """Languages and posteriors of a batch of texts."""
        spoken = [i for i, t in enumerate(texts) if t and has_letter(t)] if self.languages else []
        names, scores = ["und"] * len(texts), np.zeros(len(texts))
        if not spoken:
            return names, scores
        sums = np.tile(self.prior, (len(spoken), 1))
        for bucket, owner in grams([texts[i] for i in spoken], int(len(self.logs)).bit_length() - 1):
            new = np.flatnonzero(np.diff(owner, prepend=-1))
            if len(new):
                rows = self.logs[bucket]
                for k in range(len(self.languages)):
                    sums[owner[new], k] += np.add.reduceat(rows[:, k], new, dtype=np.float64)
        best = sums.argmax(axis=1)
        scores[spoken] = 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)
        for i, k in zip(spoken, best, strict=True):
            names[i] = self.languages[k]
        return names, scores


def fit(rows: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", per_language: int = 2000, bits: int = BITS) -> Model:
    """Learn from the labelled rows given; about ``per_language`` of each language."""
    labelled = rows.select(F.col(f"`{id_col}`").alias("_id"), F.col(f"`{text_col}`").alias("_text"), F.col(f"`{lang_col}`").alias("_lang")).filter("_lang is not null and _text is not null")
    most = MOST_BYTES >> (bits + 2)
    counts = {r[0]: r[1] for r in labelled.groupBy("_lang").count().limit(most + 1).collect()}
    languages = sorted(counts)
    if len(languages) > most:
        raise ValueError(f"more than {most} languages of {1 << bits} buckets make a matrix of over {MOST_BYTES >> 20} MB: lower bits")
    if not languages:
        return Model([], np.zeros((1 << bits, 0), np.float32), np.zeros(0))
    place = {x: i for i, x in enumerate(languages)}
    chosen = F.create_map(*[F.lit(x) for pair in counts.items() for x in (pair[0], per_language / pair[1])])
    sample = labelled.filter(drawn(own_place(F.col("_id"), F.col("_text")), "language", F.element_at(chosen, F.col("_lang")))).select("_lang", "_text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, seen = np.zeros((len(languages), 1 << bits), np.int64), False
        for batch in batches:
            spoken = np.array([place[x] for x in batch.column(0).to_pylist()], np.int64)
            for bucket, owner in grams(batch.column(1).to_pylist(), bits):
                seen = True
                np.add.at(total.reshape(-1), spoken[owner] << bits | bucket, 1)
        if seen:
            at, bucket = np.nonzero(total)
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), pa.array(bucket, pa.int32()), pa.array(total[at, bucket], pa.int64())], names=["lang", "bucket", "n"])

    summed = sample.mapInArrow(count, "lang int, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    table = np.full((1 << bits, len(languages)), 0.5)
    table[summed["bucket"].to_numpy(), summed["lang"].to_numpy()] += summed["n"].to_numpy()
    held = np.array([counts[x] for x in languages], float)
    return Model(languages, np.log(table / table.sum(axis=0)).astype(np.float32), np.log(held / held.sum()))


def annotate(docs: DataFrame, model: Model, text_col: str = "text", lang_out: str = "lang_pred", score_out: str = "score") -> DataFrame:
    """The input with the predicted language and its posterior."""
    if clash := {lang_out, score_out} & set(docs.columns):
        raise ValueError(f"the input already has {sorted(clash)}")
    shared = docs.sparkSession.sparkContext.broadcast(model)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for whole in batches:
            for start in range(0, whole.num_rows, 64):
                batch = whole.slice(start, 64)
                names, scores = model.score(batch.column(at).to_pylist())
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores, pa.float64())], names=[*batch.schema.names, lang_out, score_out])

    return docs.mapInArrow(run, T.StructType([*docs.schema.fields, T.StructField(lang_out, T.StringType()), T.StructField(score_out, T.DoubleType())]))
