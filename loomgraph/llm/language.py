"""Language identification by hyperdimensional profiles.

Each letter has a random vector of +1 and -1.  An n-gram's vector binds (multiplies) its letters'
vectors, each permuted (rolled) by its place; a document's vector bundles (adds) those of its n-grams;
a language's prototype bundles the unit vectors of sample documents.  A document gets the language of
the prototype with the largest cosine.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIMENSIONS = 512
ORDER = 3
#: Unit vectors are added as whole numbers of this scale, so sums do not depend on their order.
SCALE = 1 << 20
UNKNOWN = "und"
GAP = 32
#: A text with fewer distinct n-grams is too short to be told from chance, whose cosines are about 0.044.
FEW_GRAMS = 48

_alphabetic: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point whether it is a letter; made once in each worker."""
    if not _alphabetic:
        _alphabetic.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _alphabetic[0]


def _points(text: str) -> np.ndarray | None:
    """Code points of a text's letters and single gaps, with gaps around; None without a letter."""
    points = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = _letters()[points]
    if not letter.any():
        return None
    points = np.where(letter, points, GAP)
    keep = letter.copy()
    keep[1:] |= letter[:-1]  # the first gap after a letter stays
    return np.concatenate([[GAP], points[keep], [GAP] * (ORDER - 1)])


def distinct_grams(text: str) -> int:
    """How many different n-grams a text has."""
    points = _points(text)
    return 0 if points is None else len(np.unique(np.lib.stride_tricks.sliding_window_view(points, ORDER), axis=0))


@dataclass
class Encoder:
    """Document vectors; letters get their vectors from the seed and their code point alone."""

    seed: int = 5
    rows: dict[int, int] = field(default_factory=dict)
    index: np.ndarray = field(default_factory=lambda: np.full(0x110000, -1, np.int32))
    tables: list[np.ndarray] = field(default_factory=lambda: [np.zeros((0, DIMENSIONS), np.int8) for _ in range(ORDER)])

    def _add(self, points: np.ndarray) -> None:
        """Vectors of new letters; tables double when they are full, so each letter costs the same."""
        need, room = len(self.rows) + len(points), len(self.tables[0])
        if need > room:
            self.tables = [np.concatenate([t, np.zeros((max(need, 2 * room, 256) - room, DIMENSIONS), np.int8)]) for t in self.tables]
        for point in points.tolist():
            vector = np.random.default_rng([self.seed, point]).integers(0, 2, DIMENSIONS, dtype=np.int8) * 2 - 1
            at = self.index[point] = self.rows[point] = len(self.rows)
            for k, table in enumerate(self.tables):
                table[at] = np.roll(vector, ORDER - 1 - k)

    def vector(self, text: str) -> np.ndarray | None:
        """The bundle of a text's n-grams over letters and single gaps; None without a letter."""
        points = _points(text)
        if points is None:
            return None
        at = self.index[points]
        if (at < 0).any():
            self._add(np.unique(points[at < 0]))
            at = self.index[points]
        code = np.zeros(len(at) - ORDER + 1, np.int64)
        for k in range(ORDER):
            code = (code << 21) | at[k : len(at) - ORDER + 1 + k]
        grams, counts = np.unique(code, return_counts=True)
        out = np.zeros(DIMENSIONS, np.float64)
        for low in range(0, len(grams), 4096):
            part, bound = grams[low : low + 4096], None
            for k in range(ORDER):
                rows = self.tables[k][(part >> (21 * (ORDER - 1 - k))) & 0x1FFFFF]
                bound = rows if bound is None else bound * rows
            out += counts[low : low + 4096].astype(np.float32) @ bound.astype(np.float32)
        return out


def _bundles(seed: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, sums = Encoder(seed), {}
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                vector = encoder.vector(text.as_py() or "")
                size = 0.0 if vector is None else float(np.sqrt(vector @ vector))
                if size:
                    sums[lang] = sums.get(lang, 0) + np.rint(vector / size * SCALE).astype(np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.string()), pa.array([list(v) for v in sums.values()], pa.list_(pa.int64()))], ["lang", "total"])

    return run


@dataclass(frozen=True)
class Profiles:
    """Languages in order of name, and their unit prototypes."""

    languages: tuple[str, ...]
    prototypes: np.ndarray
    seed: int


def fit_profiles(labelled: DataFrame, per_language: int = 2000, seed: int = 5, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", most_languages: int = 1024) -> Profiles:
    """Prototypes from about ``per_language`` documents of each language, chosen by a hash of the id.

    The bounds are what keeps fitting cheap at any size: of more than ``most_languages`` labels the most
    frequent are learned, equal counts by name.  Rows with a null language or text do not count.  Only one
    vector for each language goes to the driver.
    """
    rows = labelled.select(F.col(id_col).alias("id"), F.col(lang_col).alias("lang"), F.col(text_col).alias("text")).where("lang IS NOT NULL")
    million = 1_000_000
    rates = rows.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(most_languages)
    rates = rates.select("lang", F.expr(f"LEAST({million}, ({per_language * million} + n - 1) div n)").alias("rate"))
    sample = rows.join(F.broadcast(rates), "lang").where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(million)) < F.col("rate")).select("lang", "text")
    sums = sample.mapInArrow(_bundles(seed), "lang string, total array<long>").select("lang", F.posexplode("total").alias("i", "v"))
    found = sums.groupBy("lang", "i").agg(F.sum("v").alias("v")).toArrow()
    languages = tuple(sorted(set(found.column("lang").to_pylist())))
    if not languages:
        return Profiles((), np.zeros((0, DIMENSIONS)), seed)
    places = {lang: k for k, lang in enumerate(languages)}
    prototypes = np.zeros((len(languages), DIMENSIONS))
    prototypes[[places[lang] for lang in found.column("lang").to_pylist()], found.column("i").to_numpy()] = found.column("v").to_numpy()
    return Profiles(languages, prototypes / np.sqrt((prototypes**2).sum(axis=1, keepdims=True)), seed)


def _predictions(profiles: Profiles) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(profiles.seed)
        for batch in batches:
            langs, scores = [], []
            for text in batch.column(1):
                vector = encoder.vector(text.as_py() or "") if len(profiles.languages) else None
                size = 0.0 if vector is None else float(np.sqrt(vector @ vector))
                if not size:
                    langs.append(UNKNOWN if vector is None else profiles.languages[0])
                    scores.append(0.0)
                    continue
                cosines = profiles.prototypes @ vector / size
                best = int(np.argmax(cosines))
                langs.append(profiles.languages[best])
                scores.append(float(min(1.0, max(0.0, cosines[best]))))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "lang_pred", "score"])

    return run


def predict_language(documents: DataFrame, profiles: Profiles, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) of every row; score is the largest cosine, 0 to 1.

    A text that is null or has no letter is ``und`` with score 0, and so is every text if nothing was
    learned.  Equal cosines go to the first language by name.  Null ids and repeated rows stay, other
    columns are ignored, an empty table gives an empty result.
    """
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_predictions(profiles), "doc_id long, lang_pred string, score double")


def held_out(id_col: str = "doc_id") -> Column:
    """Whether a row is kept out of learning: crc32 of its id as text leaves 2 when divided by 4.

    Rows without an id are never learned from.
    """
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 4 == 2, F.lit(True))


def keep_identified(documents: DataFrame, profiles: Profiles, least_score: float = 0.1, text_col: str = "text") -> DataFrame:
    """``documents`` without the rows whose text has no letter or is clearly foreign.

    Clearly foreign: the best cosine is below the least, and the text has ``FEW_GRAMS`` different
    n-grams or more, so that this is not for its length.  Columns stay as they are.  If nothing was learned, no row can be identified and none stays.
    """
    names, at = [f"c{i}" for i in range(len(documents.columns))], documents.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        predict = _predictions(profiles)
        for batch in batches:
            judged = next(predict(iter([pa.RecordBatch.from_arrays([batch.column(at), batch.column(at)], ["doc_id", "text"])])))
            judgements = zip(judged.column(1).to_pylist(), judged.column(2).to_pylist(), batch.column(at), strict=True)
            keep = [lang != UNKNOWN and (score >= least_score or distinct_grams(text.as_py()) < FEW_GRAMS) for lang, score, text in judgements]
            yield pa.RecordBatch.from_arrays(batch.columns, names).filter(pa.array(keep, pa.bool_()))

    plain = documents.toDF(*names)  # whatever characters the columns' names have
    return plain.mapInArrow(run, plain.schema).toDF(*documents.columns)
