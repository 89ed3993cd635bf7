"""Quality classifier by compression: zstandard dictionaries of good and of bad text.

Texts are compressed in pieces of ``PIECE`` bytes, so that a dictionary counts in long texts as in short ones. The score
rises with the size against the bad dictionary less the size against the good one, divided by the text's plain
compressed size; a logistic fit on labelled texts that the dictionaries have not seen makes it a probability.
The fit looks at no more than ``most`` labelled rows, at all pieces of each unless ``pieces_each`` bounds them; every text is scored whole.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brightloom.functions.runtime import materialise, ship_by_value
from brightloom.llm import labelled
from brightloom.llm.labelled import fold, logistic, probability, training_rows

ship_by_value(labelled.__name__)
ship_by_value(__name__)

PIECE, DICTIONARY, LEVEL = 2048, 1 << 16, 3
MOST_LABELLED = 6000
SCORES = "doc_id bigint, score double"


def pieces(text: str) -> list[bytes]:
    data = text.encode("utf-8", "replace")
    return [data[i : i + PIECE] for i in range(0, len(data), PIECE)]


def spread(found: list[bytes], most: int | None) -> list[bytes]:
    """All pieces, or ``most`` of them at even distances, the first and the last included (the last alone for one)."""
    if most is None or len(found) <= most:
        return found
    return [found[i] for i in np.linspace(len(found) - 1, 0, most).round().astype(int)[::-1]]


class Sizes:
    """Compressed sizes of a text against the good and the bad dictionary, and plain."""

    def __init__(self, good: bytes, bad: bytes):
        dictionaries = [zstandard.ZstdCompressionDict(d) if d else None for d in (good, bad)]
        for d in dictionaries:
            if d:
                d.precompute_compress(level=LEVEL)
        options = dict(level=LEVEL, write_content_size=False, write_checksum=False, write_dict_id=False)
        self.by = [zstandard.ZstdCompressor(dict_data=d, **options) if d else zstandard.ZstdCompressor(**options)
                   for d in (*dictionaries, None)]

    def features(self, text: str) -> tuple[float, float]:
        """The normalised difference, and the plain size against the length."""
        data = pieces(text)
        good, bad, plain = (sum(len(c.compress(p)) for p in data) for c in self.by)
        return ((bad - good) / plain if plain else 0.0, plain / max(1, sum(map(len, data))))


def _dictionary(samples: list[bytes]) -> bytes:
    """A trained dictionary; too few or too short samples are one as they stand."""
    raw = b"".join(samples)
    if len(samples) >= 20 and len(raw) >= 16 * 1024:
        try:
            return zstandard.train_dictionary(min(DICTIONARY, len(raw) // 8), samples, level=LEVEL).as_bytes()
        except zstandard.ZstdError:
            pass
    return raw[:DICTIONARY]


def _spread(x: np.ndarray) -> np.ndarray:
    """The difference and its products with how compressible the text is."""
    d, ratio = x[:, 0], x[:, 1]
    return np.column_stack([10 * d, 10 * d * ratio, 4 * ratio, 4 * ratio * ratio])


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", allowed=None, most: int = MOST_LABELLED,
        pieces_each: int | None = None):
    """(good dictionary, bad dictionary, weights), learned from one half of the labelled sample and calibrated on the other."""
    rows = materialise(training_rows(docs, labels, label, F.lit(True) if allowed is None else allowed, most), "labelled")

    def sample(batches):
        for batch in batches:
            out = []
            for text, y in zip(batch["text"].to_pylist(), batch["y"].to_pylist()):
                out += [(p, y) for p in spread(pieces(text), pieces_each)]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in out], pa.binary()), pa.array([y for _, y in out], pa.int32())], ["piece", "y"])

    learned = rows.where("half = 0").select("text", "y").mapInArrow(sample, "piece binary, y int").toArrow()
    found = sorted(zip(learned["piece"].to_pylist(), learned["y"].to_pylist()))
    good, bad = (_dictionary([bytes(p) for p, y in found if y == k]) for k in (1, 0))

    def measure(batches):
        sizes = Sizes(good, bad)
        for batch in batches:
            x = [sizes.features(t) for t in batch["text"].to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array([a for a, _ in x], pa.float64()), pa.array([b for _, b in x], pa.float64()), batch["y"]], ["d", "ratio", "y"])

    seen = rows.where("half = 1").select("text", "y").mapInArrow(measure, "d double, ratio double, y int").toArrow()
    x = np.column_stack([seen["d"].to_numpy(), seen["ratio"].to_numpy()]).reshape(-1, 2)
    return good, bad, logistic(_spread(x), seen["y"].to_numpy())


def score(docs: DataFrame, model) -> DataFrame:
    """doc_id and score (0 to 1, higher: good likelier) of every whole text; a NULL text is an empty one."""
    good, bad, weights = model

    def run(batches):
        sizes = Sizes(good, bad)
        for batch in batches:
            x = np.array([sizes.features(t or "") for t in batch["text"].to_pylist()]).reshape(-1, 2)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(probability(weights, _spread(x)))], ["doc_id", "score"])

    return docs.select("doc_id", "text").mapInArrow(run, SCORES)


def classify(docs: DataFrame, labels: DataFrame, parts: int = 3, kept_out: int = 1, most: int = MOST_LABELLED,
             pieces_each: int | None = None) -> DataFrame:
    """Per row of ``docs``: doc_id, held_out, score, predicted. Labels are learned only from the folds not kept out.

    Empty texts get the score of no difference; a NULL doc_id is never held out nor learned from; equal texts get equal
    scores; other columns, language and source among them, are not read. Without labels of both kinds every text gets the
    smoothed rate of the label.
    """
    model = fit(docs, labels, allowed=fold(parts) != kept_out, most=most, pieces_each=pieces_each)
    return score(docs, model).select(
        "doc_id", F.coalesce(fold(parts) == kept_out, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )
