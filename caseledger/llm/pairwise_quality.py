"""Operator 10: a quality classifier by Bradley-Terry pairwise ranking.

A document's score is a weighted sum of features of its whole text. The weights come from
preference pairs (a document labelled 1 before one labelled 0) by logistic loss on the difference
of their features; the cut between the classes is a quantile of the scores. Every labelled row and every
pair of a 1 and a 0 counts: the loss of a pair depends on two scores only, so the rows are summed up along
the scores, and pairs are formed between those sums.
"""

import math
from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators.skew import exact_percentiles
from .shared import as_bytes, fresh, stored
from .text_stats import SYMBOLS, code_points, count_any, numbered, repeated_words, word_chars

FEATURES = (
    "log_words", "word_length", "symbols", "bangs", "bars", "capitals", "repeats", "same_lines",
    "variety", "commas", "stops", "open_lines", "digits", "symbol_any", "bang_any", "repeat_half", "short",
)
_UPPER = bytes(range(65, 91))
_LETTERS = _UPPER + bytes(range(97, 123))


def features(data: bytes | None) -> list[float]:
    """Of a whole text, each within a few units. A text without words has zeros but for `short`."""
    data = data or b""
    words = data.split()
    n = len(words)
    if not n:
        return [0.0] * (len(FEATURES) - 1) + [1.0]
    lines = [x for x in data.split(b"\n") if x.strip()]
    ids = numbered(words)
    symbols, bangs, bars = count_any(data, SYMBOLS) / n, data.count(b"!!") / n, data.count(b"|") / n
    repeats = repeated_words(ids) / n
    ended = sum(x.rstrip().endswith((b".", b"!", b"?")) for x in lines)
    return [
        math.log1p(n) / 4,
        word_chars(data) / n / 6,
        min(symbols, 3.0),
        min(bangs, 1.0),
        min(bars, 1.0),
        count_any(data, _UPPER) / max(1, count_any(data, _LETTERS)),
        repeats,
        1 - len(set(lines)) / len(lines),
        (int(ids.max()) + 1) / n,
        min(data.count(b",") / n, 1.0),
        min(data.count(b".") / n, 1.0),
        1 - ended / len(lines),
        count_any(data, b"0123456789") / max(1, code_points(data)),
        min(symbols / 0.2, 1.0),
        min(bangs / 0.2, 1.0),
        float(repeats > 0.5),
        float(n < 50),
    ]


@dataclass(frozen=True)
class Ranking:
    mean: tuple[float, ...]
    scale: tuple[float, ...]
    weights: tuple[float, ...]
    cut: float
    threshold: float

    def total(self, values: Column) -> Column:
        total = F.lit(0.0)
        for i, (m, s, w) in enumerate(zip(self.mean, self.scale, self.weights, strict=True)):
            total = total + (values[i] - m) / s * w
        return total

    def score(self, values: Column) -> Column:
        return 1 / (1 + F.exp(-(self.total(values) - self.cut + math.log(self.threshold / (1 - self.threshold)))))


#: Sums are whole numbers of this unit, so that they do not depend on the order of rows.
_UNIT = float(1 << 24)
#: Scores are summed up at places this far apart, or further where they spread over more than so many places.
_WIDTH, _PLACES = 1 / 64, 4096


@dataclass(frozen=True)
class Moments:
    """Of the rows of one label: how many, the sums of the features, and those of their products."""

    n: int
    sums: np.ndarray
    products: np.ndarray


@dataclass(frozen=True)
class Along:
    """The rows of one label along their scores: the places, the rows at each, and the sums of their features.

    A row between two places belongs to both, to the nearer one more.
    """

    places: np.ndarray
    n: np.ndarray
    sums: np.ndarray


def _ranked(
    good: Moments, bad: Moments, along: Callable[[np.ndarray, np.ndarray, np.ndarray], tuple[Along, Along]], *, penalty: float, steps: int
) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Mean and scale of the features, and the weights by Newton steps on the mean logistic loss of all pairs.

    The gradient is that of all pairs, with the loss interpolated between places. The curvature takes the spread
    of the features around the sums of a place to be that of the label.
    """
    n = good.n + bad.n
    mean = (good.sums + bad.sums) / n
    middle = np.outer(mean, mean)
    square = np.diag((good.products + bad.products) / n - middle)
    scale = np.maximum(np.sqrt(np.maximum(square, 0)), 1e-6)

    def centred(m: Moments) -> np.ndarray:
        cross = np.outer(m.sums, mean)
        return (m.products - cross - cross.T + m.n * middle) / np.outer(scale, scale)

    spreads = centred(good), centred(bad)
    pairs, width = float(good.n) * bad.n, len(mean)
    weights = np.zeros(width)
    for _ in range(steps):
        up, down = along(mean, scale, weights)
        gradient, curve = np.zeros(width), np.zeros((width, width))
        over_down, over_up = np.zeros((2, len(down.n))), []
        for k in range(0, len(up.n), 256):
            part = slice(k, k + 256)
            p = 1 / (1 + np.exp(np.clip(up.places[part, None] - down.places[None, :], -500, 500)))
            bent = p * (1 - p)
            over_up.append(np.stack([p @ down.n, bent @ down.n]))
            over_down += np.stack([up.n[part] @ p, up.n[part] @ bent])
            crossed = up.sums[part].T @ bent @ down.sums
            curve -= crossed + crossed.T
        over_up = np.concatenate(over_up, axis=1)
        gradient = (over_up[0] @ up.sums - over_down[0] @ down.sums) / pairs - penalty * weights
        for rows, over, spread, m in ((up, over_up, spreads[0], good), (down, over_down, spreads[1], bad)):
            inside = (spread - (rows.sums / rows.n[:, None]).T @ rows.sums) / m.n
            curve += (rows.sums * (over[1] / rows.n)[:, None]).T @ rows.sums + inside * (over[1] @ rows.n)
        curve = curve / pairs + penalty * np.eye(width)
        step = np.linalg.solve(curve, gradient)
        weights = weights + step * min(1.0, 5.0 / max(1e-12, np.abs(step).max()))
        if np.abs(step).max() < 1e-4:
            break
    return mean, scale, weights


def fit(
    values: np.ndarray, labels: np.ndarray, *, threshold: float = 0.3, penalty: float = 1e-3, steps: int = 30,
) -> Ranking | None:
    """What `learn` finds, of rows at hand. None when a class is missing: there is nothing to prefer then."""
    good, bad = values[labels == 1], values[labels == 0]
    if not len(good) or not len(bad):
        return None

    def along(mean: np.ndarray, scale: np.ndarray, weights: np.ndarray) -> tuple[Along, Along]:
        sides = [(x - mean) / scale for x in (good, bad)]
        scores = [z @ weights for z in sides]
        width = _width(min(map(np.min, scores)), max(map(np.max, scores)))
        out = []
        for z, score in zip(sides, scores, strict=True):
            low = np.floor(score / width)
            part = score / width - low
            places, at = np.unique(np.concatenate([low, low + 1]), return_inverse=True)
            share = np.concatenate([1 - part, part])
            n, sums = np.zeros(len(places)), np.zeros((len(places), z.shape[1]))
            np.add.at(n, at, share)
            np.add.at(sums, at, share[:, None] * np.concatenate([z, z]))
            out.append(Along(places[n > 0] * width, n[n > 0], sums[n > 0]))
        return out[0], out[1]

    mean, scale, weights = _ranked(
        *[Moments(len(x), x.sum(axis=0), x.T @ x) for x in (good, bad)], along, penalty=penalty, steps=steps
    )
    cut = float(np.quantile((values - mean) / scale @ weights, len(bad) / len(values), method="midpoint"))
    return Ranking(*[tuple(map(float, x)) for x in (mean, scale, weights)], cut, threshold)


def _width(low: float, high: float) -> float:
    return max(_WIDTH, (high - low) / _PLACES)


def held_out(doc_id: Column) -> Column:
    """Rows that are never learned from: crc32 of the id as text divides by five. A null id is one."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def featured(docs: DataFrame, *, text_col: str = "text") -> tuple[DataFrame, str]:
    """The table with one more column, whose name comes second: the features of the text."""
    name = fresh(docs, "features")

    @F.arrow_udf("array<double>")
    def of(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for texts in batches:
            yield pa.array([features(t) for t in as_bytes(texts)], pa.list_(pa.float64()))

    # A filter on the score must not be pushed below it: each text would be read twice.
    return docs.withColumn(name, of.asNondeterministic()(F.col(text_col).cast("string"))), name


def usable_labels(labels: DataFrame, *, id_col: str = "doc_id", label_col: str = "quality") -> DataFrame:
    """id and label of the rows that may be learned from: held-out rows, null labels and labels other than 0 and 1 are
    left out; repeated labels count once."""
    return (
        labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
        .filter(F.col("label").isin(0, 1) & ~held_out(F.col("id")))
        .distinct()
    )


def _moments(rows: DataFrame) -> dict[int, Moments]:
    """Per label, summed up in each task."""
    size = len(FEATURES) + 1

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = batch["features"].flatten().to_numpy(zero_copy_only=False).reshape(-1, size - 1)
            x, labels = np.column_stack([np.ones(len(x)), x]), batch["label"].to_numpy()
            for label in np.unique(labels):
                mine = x[labels == label]
                found = np.rint(mine[:, :, None] * mine[:, None, :] * _UNIT).astype(np.int64).sum(axis=0)
                total[int(label)] = total.get(int(label), 0) + found
        yield pa.RecordBatch.from_pydict(
            {"label": pa.array(list(total), pa.int32()), "sums": pa.array([v.ravel().tolist() for v in total.values()], pa.list_(pa.int64()))}
        )

    found: dict[int, np.ndarray] = {}
    # At most two rows of each task.
    for r in rows.select("label", "features").mapInArrow(of, "label int, sums array<long>").toLocalIterator():
        found[r["label"]] = found.get(r["label"], 0) + np.array(r["sums"], np.int64).astype(object)
    out = {}
    for label, sums in found.items():
        whole = sums.astype(np.float64).reshape(size, size) / _UNIT
        out[label] = Moments(round(whole[0, 0]), whole[0, 1:], whole[1:, 1:])
    return out


def _summed_along(rows: DataFrame, mean: np.ndarray, scale: np.ndarray, weights: np.ndarray) -> tuple[Along, Along]:
    """The rows of label 1 and those of label 0 along their scores; a row per label and place comes to the driver."""
    values = [(F.col("features")[i] - float(m)) / float(s) for i, (m, s) in enumerate(zip(mean, scale, strict=True))]
    names = [f"x{i}" for i in range(len(values))]
    scored = rows.select("label", *[v.alias(n) for v, n in zip(values, names, strict=True)])
    total = F.lit(0.0)
    for name, w in zip(names, weights, strict=True):
        total = total + F.col(name) * float(w)
    scored = scored.withColumn("score", total)
    width = _width(*scored.agg(F.min("score"), F.max("score")).first())
    low = F.floor(F.col("score") / width)
    beside = scored.withColumn("low", low).withColumn("part", F.col("score") / width - F.col("low")).withColumn("at", F.explode(F.array(
        F.struct(F.col("low").alias("place"), (1 - F.col("part")).alias("share")),
        F.struct((F.col("low") + 1).alias("place"), F.col("part").alias("share")),
    ))).select("label", "at.place", "at.share", *names)
    units = lambda c: F.sum(F.rint(c * _UNIT).cast("long"))
    sums = beside.groupBy("label", "place").agg(units(F.col("share")).alias("n"), *[units(F.col("share") * F.col(n)).alias(n) for n in names])
    table = sums.filter("n > 0").orderBy("label", "place").toArrow()
    label = table["label"].to_numpy()
    columns = np.column_stack([table[c].to_numpy() for c in ("place", "n", *names)]).astype(np.float64)
    sides = [columns[label == k] for k in (1, 0)]
    return tuple(Along(x[:, 0] * width, x[:, 1] / _UNIT, x[:, 2:] / _UNIT) for x in sides)


def learn(
    known: DataFrame, usable: DataFrame, *, id_col: str = "doc_id", threshold: float = 0.3, penalty: float = 1e-3, steps: int = 30,
) -> Ranking | None:
    """Fit on all labelled rows and all pairs of a 1 and a 0 among them. None when a class is missing.

    `known` has the id and `features`, `usable` is what `usable_labels` gives. A step reads the labelled rows once or twice and brings
    at most about 8,000 sums to the driver, however many rows there are. The cut is the score quantile at the share of label 0, where the score
    becomes `threshold`.
    """
    rows = stored(known.select(F.col(id_col).alias("id"), "features").join(usable, "id").select("label", "features"), "labelled")
    moments = _moments(rows)
    if set(moments) != {0, 1}:
        return None
    good, bad = moments[1], moments[0]
    mean, scale, weights = _ranked(good, bad, lambda *at: _summed_along(rows, *at), penalty=penalty, steps=steps)
    plain = Ranking(*[tuple(map(float, x)) for x in (mean, scale, weights)], 0.0, threshold)
    scores = rows.select(F.lit(0).alias("all"), plain.total(F.col("features")).alias("score"))
    # Halfway between the two scores around the rank, as they may lie far apart where the classes part.
    last = good.n + bad.n - 1
    rank = bad.n / (good.n + bad.n) * last
    around = exact_percentiles(
        scores, ["all"], "score", {"low": math.floor(rank) / last, "high": math.ceil(rank) / last}, width=_WIDTH
    ).first()
    return replace(plain, cut=(around["low"] + around["high"]) / 2)


def quality_scores(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "quality", threshold: float = 0.3,
) -> DataFrame:
    """id, held_out, score (0 to 1, higher: label 1 likelier) and predicted (score >= threshold) per row.

    The classes are learned from all labelled rows and all preference pairs among them; every row is scored.
    Null and empty texts have features too and so a score. Without rows of both labels there is nothing to
    learn and every score is 0.5. Repeated rows score alike. Other columns are not read.
    """
    plain = docs.select(F.col(id_col), F.col(text_col))
    with_features, name = featured(plain, text_col=text_col)
    known = stored(with_features.select(id_col, F.col(name).alias("features")), "features")
    usable = usable_labels(labels, id_col=id_col, label_col=label_col)
    ranking = learn(known, usable, id_col=id_col, threshold=threshold)
    score = ranking.score(F.col("features")) if ranking else F.lit(0.5)
    return known.select(
        id_col, held_out(F.col(id_col)).alias("held_out"), score.cast("double").alias("score")
    ).withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def good_only(
    docs: DataFrame, labels: DataFrame, *, id_col: str = "doc_id", text_col: str = "text",
    label_col: str = "quality", threshold: float = 0.3,
) -> DataFrame:
    """The documents that are predicted to be label 1, with all their columns.

    The classes are learned in a pass before the one that judges all. That pass works out the features of all documents too, as these
    meet their labels in far less room than the texts would. Null
    ids and repeated rows are judged like others; without rows of both labels all documents stay.
    """
    usable = stored(usable_labels(labels, id_col=id_col, label_col=label_col), "labels")
    plain = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    of_all, name = featured(plain)
    known = of_all.select("id", F.col(name).alias("features"))
    ranking = learn(known, usable, id_col="id", threshold=threshold)
    if ranking is None:
        return docs
    with_features, name = featured(docs, text_col=text_col)
    return with_features.filter(ranking.score(F.col(name)) >= threshold).drop(name)
