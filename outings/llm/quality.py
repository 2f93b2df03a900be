"""Quality by ordinal regression: one set of hashed-text weights and ordered thresholds between the grades."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from outings.llm.common import SMALL_SLICE_BYTES, free_name, id_and_text, lowered, mixed, prepared, slices, token_hashes
from outings.llm.language import held_out


@dataclass(frozen=True)
class Plan:
    """Sizes of the model. ``sample`` bounds the labelled documents that are learned from; ``l1`` is, about, the number
    of misjudged documents that a feature needs to get a weight."""

    bits: int = 17
    sample: int = 12_000
    batch: int = 256
    epochs: int = 32
    rate: float = 0.5
    l1: float = 1.0
    seed: int = 11


# Classes of bytes: space, letter (with all bytes of non-ASCII characters), digit, other.
_CLASS = np.full(256, 3, np.int8)
_CLASS[[32, 9, 10, 11, 12, 13]] = 0
_CLASS[65:91] = _CLASS[97:123] = 1
_CLASS[128:] = 1
_CLASS[48:58] = 2


def features(texts: list[bytes], bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashed features of every text: (ends, buckets).

    Tokens are runs of letters, digits or other signs, in lower case. The shape of a text adds features of its own: the
    shares, in tenths, of sign runs, of capital letters, of tokens equal to the one before, and the logarithm of its size.
    """
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    # A line break after every text keeps tokens apart.
    raw = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
    ends = np.cumsum(size + 1)
    low = lowered(raw)
    starts, hashes, kind = token_hashes(low, _CLASS)
    owner = np.searchsorted(ends, starts, side="right")
    mask = np.uint64((1 << bits) - 1)
    n = len(texts)
    count = np.bincount(owner, minlength=n)
    total = np.maximum(1, count)
    same = np.zeros(len(hashes), bool)
    same[1:] = (hashes[1:] == hashes[:-1]) & (owner[1:] == owner[:-1])
    capital = np.concatenate(([0], np.cumsum((raw >= 65) & (raw <= 90))))
    letters = np.concatenate(([0], np.cumsum(_CLASS[raw] == 1)))
    begins = ends - size - 1
    shares = [np.bincount(owner, weights=kind == 3, minlength=n) / total,
              (capital[ends] - capital[begins]) / np.maximum(1, letters[ends] - letters[begins]),
              np.bincount(owner, weights=same, minlength=n) / total]
    shape = [np.ceil(10 * s).astype(np.int64) for s in shares] + [np.log2(1 + count).astype(np.int64)]
    shape_hash = [mixed((v + 64 * (i + 1)).astype(np.uint64), salt=99) for i, v in enumerate(shape)]
    owners = np.concatenate([owner] + [np.arange(n)] * len(shape))
    buckets = np.concatenate([hashes] + shape_hash) & mask
    keys = np.unique((owners.astype(np.uint64) << np.uint64(bits)) | buckets)
    counts = np.bincount((keys >> np.uint64(bits)).astype(np.int64), minlength=n)
    return np.cumsum(counts), (keys & mask).astype(np.int32)


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 0.5 * (1 + np.tanh(0.5 * x))


@dataclass
class Model:
    """P(grade >= grades[j]) = sigmoid(score - thresholds[j - 1]) for j >= 1; thresholds ascend."""

    grades: list[int]
    weights: np.ndarray
    thresholds: np.ndarray
    bits: int

    def tails(self, texts: list[bytes]) -> np.ndarray:
        """P(grade >= g) for every text and every grade but the least."""
        ends, buckets = features(texts, self.bits)
        total = np.concatenate(([0.0], np.cumsum(self.weights[buckets], dtype=np.float64)))
        scores = total[ends] - total[np.concatenate(([0], ends[:-1]))]
        return sigmoid(scores[:, None] - self.thresholds)

    def expected(self, tails: np.ndarray) -> np.ndarray:
        return self.grades[0] + tails @ np.diff(self.grades).astype(float)


def fit_arrays(ends: np.ndarray, buckets: np.ndarray, grade: np.ndarray, plan: Plan) -> Model:
    """Ordered logit by mini-batches: per-weight rates and an L1 pull to zero (follow the regularised leader), so that a rare
    telling word gets its weight and the many others keep none."""
    grades = sorted(set(grade.tolist()))
    y = np.searchsorted(grades, grade)
    size, k = 1 << plan.bits, len(grades) - 1
    z, n = np.zeros(size), np.zeros(size)
    weights = np.zeros(size)
    # Thresholds: the first, then positive steps; they start at the sample's own shares.
    share = np.clip([(y >= j).mean() for j in range(1, k + 1)], 1e-3, 1 - 1e-3)
    cuts = np.maximum.accumulate(-np.log(share / (1 - share)) + np.arange(k) * 1e-3)
    steps = np.concatenate((cuts[:1], np.log(np.maximum(1e-3, np.diff(cuts)))))
    grown = np.full(k, 1e-6)
    rng = np.random.default_rng(plan.seed)
    begins = np.concatenate(([0], ends[:-1]))
    for _ in range(plan.epochs if k else 0):
        order = rng.permutation(len(y))
        for at in range(0, len(order), plan.batch):
            own = order[at:at + plan.batch]
            counts = (ends - begins)[own]
            which = np.repeat(begins[own] - (np.cumsum(counts) - counts), counts) + np.arange(counts.sum())
            rows, cols = np.repeat(np.arange(len(own)), counts), buckets[which]
            scores = np.bincount(rows, weights=weights[cols], minlength=len(own))
            theta = np.cumsum(np.concatenate((steps[:1], np.exp(steps[1:]))))
            bounds = np.concatenate(([-np.inf], theta, [np.inf]))
            with np.errstate(over="ignore"):
                a, b = sigmoid(scores - bounds[y[own]]), sigmoid(scores - bounds[y[own] + 1])
            slope = (a + b - 1) / len(own)
            p = np.maximum(1e-9, a - b)
            d_theta = (np.bincount(y[own], weights=a * (1 - a) / p, minlength=k + 1)[1:]
                       - np.bincount(y[own] + 1, weights=b * (1 - b) / p, minlength=k + 2)[1:k + 1]) / len(own)
            d_steps = np.cumsum(d_theta[::-1])[::-1] * np.concatenate((np.ones(1), np.exp(steps[1:])))
            grown += d_steps ** 2
            steps -= 0.1 * d_steps / np.sqrt(grown)
            touched, at_col = np.unique(cols, return_inverse=True)
            g = np.bincount(at_col, weights=slope[rows], minlength=len(touched))
            old = n[touched]
            n[touched] = old + g * g
            z[touched] += g - (np.sqrt(n[touched]) - np.sqrt(old)) / plan.rate * weights[touched]
            pull = np.sign(z[touched]) * np.maximum(0, np.abs(z[touched]) - plan.l1 * plan.epochs / plan.batch)
            weights[touched] = -pull / ((0.01 + np.sqrt(n[touched])) / plan.rate)
    theta = np.cumsum(np.concatenate((steps[:1], np.exp(steps[1:])))) if k else np.zeros(0)
    return Model(grades, weights, theta, plan.bits)


def graded(labels: DataFrame) -> DataFrame:
    """doc_id and grade 0 to 2: one point for quality, one for not being toxic; rows with a null are left out."""
    return labels.select("doc_id", (F.col("quality") + 1 - F.col("toxic")).cast("int").alias("grade")) \
        .where("doc_id is not null and grade is not null")


def fit(docs: DataFrame, ratings: DataFrame, plan: Plan = Plan(), id_col: str = "doc_id", text_col: str = "text") -> Model | None:
    """Learn from the ``sample`` rated documents outside the held-out fold with the smallest id hashes; None without any.

    The sample is drawn from the ratings alone and is bounded, so it is sent to the scan of the documents; what comes
    back are bucket numbers, of one row per id: the one whose text has the least hash.
    """
    chosen = (ratings.where(~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("grade").alias("grade"))
              .orderBy(F.xxhash64(F.col("doc_id").cast("string")), "doc_id").limit(plan.sample))
    df = id_and_text(docs, id_col, text_col).join(F.broadcast(chosen), "doc_id").select("doc_id", "grade", F.xxhash64("text").alias("h"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, budget=SMALL_SLICE_BYTES):
                ends, buckets = features([t or b"" for t in part.column("text").to_pylist()], plan.bits)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], ends)), pa.int32()), pa.array(buckets))
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("grade"), part.column("h"), lists],
                                                 names=["doc_id", "grade", "h", "buckets"])

    found = df.mapInArrow(run, f"doc_id {dict(df.dtypes)['doc_id']}, grade int, h long, buckets array<int>")
    one = found.groupBy("doc_id").agg(F.min(F.struct("h", "grade", "buckets")).alias("one"))
    rows = one.select("doc_id", "one.grade", "one.buckets").toArrow()
    if not rows.num_rows:
        return None
    rows = rows.sort_by("doc_id").combine_chunks()
    lists = rows.column("buckets").combine_chunks()
    counts = pa.compute.list_value_length(lists).to_numpy()
    return fit_arrays(np.cumsum(counts), lists.flatten().to_numpy(), rows.column("grade").to_numpy(), plan)


def _tails(model: Model | None, texts: list[bytes | None]) -> tuple[list, list]:
    if model is None:
        return [None] * len(texts), [None] * len(texts)
    tails = model.tails([t or b"" for t in texts])
    last = tails[:, -1] if tails.shape[1] else np.ones(len(texts))
    return model.expected(tails).tolist(), last.tolist()


def grade_documents(docs: DataFrame, model: Model | None, least: float = 0.5, id_col: str = "doc_id",
                    text_col: str = "text") -> DataFrame:
    """doc_id, held_out, expected_grade, tail_probability (of the best grade) and kept (that is ``least`` or more).

    Every whole text is read in one pass, nothing is shuffled. Defined cases: a null text is graded as the empty text;
    without any ratings grade and probability are null and every document is kept; repeated rows are graded each; extra
    columns are ignored.
    """
    df = id_and_text(docs, id_col, text_col)
    df = df.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, budget=SMALL_SLICE_BYTES):
                expected, tail = _tails(model, part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("held_out"), pa.array(expected, pa.float64()),
                     pa.array(tail, pa.float64()), pa.array([t is None or t >= least for t in tail], pa.bool_())],
                    names=["doc_id", "held_out", "expected_grade", "tail_probability", "kept"])

    return df.mapInArrow(run, f"doc_id {dict(df.dtypes)['doc_id']}, held_out boolean, expected_grade double, "
                              "tail_probability double, kept boolean")


def keep_good(docs: DataFrame, model: Model | None, least: float = 0.5, text_col: str = "text") -> DataFrame:
    """The documents that ``grade_documents`` keeps, with all their columns.

    Defined cases: a null text is graded as the empty text; without a model every document stays; repeated rows and rows
    without id are graded each; no rows give no rows; a column may have any name.
    """
    name = free_name(docs, "graded")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for part in slices(batch.select([name]), name, SMALL_SLICE_BYTES):
                _, tail = _tails(model, part.column(name).to_pylist())
                keep += [t is None or t >= least for t in tail]
            yield batch.drop_columns([name]).filter(pa.array(keep, pa.bool_()))

    return prepared(docs).withColumn(name, docs[text_col].cast("binary")).mapInArrow(run, docs.schema)
