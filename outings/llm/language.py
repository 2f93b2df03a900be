"""Language identification: a bidirectional gated recurrent network over bytes, trained by backpropagation through time."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from outings.llm.common import as_text, free_name, id_and_text, prepared, slices

LETTER = regex.compile(r"\p{L}")
UNDETERMINED = "und"


@dataclass(frozen=True)
class Plan:
    """Sizes of the network and of its training. Texts are read in windows of ``window`` bytes, every byte in one of
    them. The training sample is bounded: ``per_language`` documents of each language, ``per_document`` windows of each;
    there are about ``updates`` batches, whatever the size of the sample. ``background`` is the share of windows of no learned language
    that are made for training (of the windows of an average language); without it, any text is some learned language."""

    window: int = 64
    hidden: int = 8
    per_language: int = 160
    per_document: int = 8
    batch: int = 256
    updates: int = 240
    background: float = 1.0
    rate: float = 0.02
    seed: int = 7


def windows_of(texts: list[bytes], window: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Byte matrix (windows, window) padded with zeros, valid bytes of every window, and the text it belongs to."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    counts = -(-sizes // window)
    owner = np.repeat(np.arange(len(texts)), counts)
    number = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    lengths = np.minimum(window, sizes[owner] - number * window)
    data = np.frombuffer(b"".join(texts) + bytes(window), np.uint8)
    starts = (np.cumsum(sizes) - sizes)[owner] + number * window
    matrix = data[starts[:, None] + np.arange(window)]
    matrix = np.where(np.arange(window) < lengths[:, None], matrix, 0)
    return matrix, lengths, owner


# Blocks of letters (fixed values, first and last code point): Greek, Cyrillic, Armenian, Hebrew, Arabic, Devanagari, Bengali, Tamil, Thai,
# Georgian, Hiragana and Katakana, CJK, Hangul.
BLOCKS = ((0x391, 0x3C9), (0x410, 0x44F), (0x531, 0x586), (0x5D0, 0x5EA), (0x620, 0x64A), (0x905, 0x939), (0x985, 0x9B9), (0xB85, 0xBB9),
          (0xE01, 0xE30), (0x10D0, 0x10FA), (0x3041, 0x30FA), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3))


def background_windows(windows: list[bytes], count: int, size: int, seed: int) -> list[bytes]:
    """Windows of no learned language: half are learned windows whose letters have been exchanged for one another, so that word
    lengths and signs stay and the spelling is no language's; half are words of blocks of letters that no learned window uses."""
    rng = np.random.default_rng(seed)
    letters = sorted({c for w in windows for c in as_text(w).lower() if c.isalpha() and c != "\ufffd"})
    seen = {ord(c) for c in letters}
    foreign = [(a, b) for a, b in BLOCKS if not any(a <= c <= b for c in seen)]
    out = []
    for n in range(count):
        if n % 2 or not foreign:
            table = dict(zip(letters, (letters[i] for i in rng.permutation(len(letters)))))
            text = "".join(table.get(c, c) for c in as_text(windows[int(rng.integers(len(windows)))]).lower())
        else:
            first, last = foreign[int(rng.integers(len(foreign)))]
            own = rng.integers(first, last + 1, 40)
            text = " ".join("".join(chr(own[i]) for i in rng.integers(0, 40, rng.integers(1, 10))) for _ in range(size // 4))
        out.append(text.encode()[:size])
    return [w for w in out if w]


class Network:
    """Two GRUs, one in each direction, and a softmax over both states at every byte. Parameters are float32 arrays.

    A cell computes z, r = sigmoid(x + h U), n = tanh(x + r (h U + c)), h' = n + z (h - n); the rows of the input table
    hold x for each of the 256 bytes.
    """

    def __init__(self, classes: int, hidden: int, seed: int):
        rng = np.random.default_rng(seed)
        self.hidden = hidden
        self.p = {}
        for d in ("f", "b"):
            self.p[d + "E"] = rng.normal(0, 0.5, (256, 3 * hidden))
            self.p[d + "U"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 3 * hidden))
            self.p[d + "c"] = np.zeros(hidden)
            self.p[d + "W"] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, classes))
        self.p["o"] = np.zeros(classes)
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}

    def run(self, d: str, data: np.ndarray, mask: np.ndarray, keep: list | None = None) -> np.ndarray:
        """States (window, n, hidden) in direction ``d``; the state is zero where the mask is."""
        steps, n, k = data.shape[1], len(data), self.hidden
        table, u, c = self.p[d + "E"], self.p[d + "U"], self.p[d + "c"]
        # sigmoid(a) = (1 + tanh(a / 2)) / 2: halving the columns of both gates leaves one tanh for them.
        half = np.concatenate((np.full(2 * k, 0.5, np.float32), np.ones(k, np.float32)))
        table, u = table * half, u * half
        states = np.zeros((steps, n, k), np.float32)
        h = np.zeros((n, k), np.float32)
        for t in (range(steps) if d == "f" else range(steps - 1, -1, -1)):
            x, g = table[data[:, t]], h @ u
            gates = np.tanh(x[:, :2 * k] + g[:, :2 * k])
            gates += 1
            gates *= 0.5
            z, r = gates[:, :k], gates[:, k:]
            gn = g[:, 2 * k:] + c
            new = np.tanh(x[:, 2 * k:] + r * gn)
            if keep is not None:
                keep.append((t, h, z, r, new, gn))
            h = (new + z * (h - new)) * mask[t][:, None]
            states[t] = h
        return states

    def probabilities(self, data: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """(window, n, classes); rows of padding are zero."""
        mask = (np.arange(data.shape[1])[:, None] < lengths).astype(np.float32)
        scores = self.run("f", data, mask) @ self.p["fW"] + self.run("b", data, mask) @ self.p["bW"] + self.p["o"]
        scores -= scores.max(axis=2, keepdims=True)
        np.exp(scores, out=scores)
        scores *= (mask / scores.sum(axis=2))[:, :, None]
        return scores

    def gradients(self, data: np.ndarray, lengths: np.ndarray, labels: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        """Mean cross-entropy over all valid bytes, and its gradient by backpropagation through time."""
        steps, n, k = data.shape[1], len(data), self.hidden
        mask = (np.arange(steps)[:, None] < lengths).astype(np.float32)
        kept = {"f": [], "b": []}
        states = {d: self.run(d, data, mask, kept[d]) for d in ("f", "b")}
        scores = states["f"] @ self.p["fW"] + states["b"] @ self.p["bW"] + self.p["o"]
        scores -= scores.max(axis=2, keepdims=True)
        probs = np.exp(scores)
        probs /= probs.sum(axis=2, keepdims=True)
        total = mask.sum()
        loss = float(-(np.log(probs[:, np.arange(n), labels] + 1e-9) * mask).sum() / total)
        err = probs
        err[:, np.arange(n), labels] -= 1
        err *= (mask / total)[:, :, None]
        grads = {"o": err.sum(axis=(0, 1))}
        for d in ("f", "b"):
            grads[d + "W"] = np.einsum("tnk,tnc->kc", states[d], err, optimize=True)
            out = err @ self.p[d + "W"].T
            du, dc, dx = np.zeros_like(self.p[d + "U"]), np.zeros_like(self.p[d + "c"]), np.zeros((steps, n, 3 * k), np.float32)
            back = np.zeros((n, k), np.float32)
            for t, h, z, r, new, gn in reversed(kept[d]):
                dh = (back + out[t]) * mask[t][:, None]
                dn = dh * (1 - z) * (1 - new * new)
                dz, dr, dgn = dh * (h - new) * z * (1 - z), dn * gn * r * (1 - r), dn * r
                dg = np.concatenate((dz, dr, dgn), axis=1)
                dx[t, :, :2 * k], dx[t, :, 2 * k:] = dg[:, :2 * k], dn
                du += h.T @ dg
                dc += dgn.sum(axis=0)
                back = dh * z + dg @ self.p[d + "U"].T
            flat, rows = data.T.ravel(), dx.reshape(-1, 3 * k)
            order = np.argsort(flat, kind="stable")
            seen, starts = np.unique(flat[order], return_index=True)
            de = np.zeros_like(self.p[d + "E"])
            de[seen] = np.add.reduceat(rows[order], starts, axis=0)
            grads |= {d + "U": du, d + "c": dc, d + "E": de}
        return loss, grads

    def train(self, data: np.ndarray, lengths: np.ndarray, labels: np.ndarray, plan: Plan) -> list[float]:
        """Adam over shuffled batches; returns the loss of every batch."""
        rng, losses, step = np.random.default_rng(plan.seed), [], 0
        first = {k: np.zeros_like(v) for k, v in self.p.items()}
        second = {k: np.zeros_like(v) for k, v in self.p.items()}
        epochs = -(-plan.updates * plan.batch // len(data))
        total = epochs * -(-len(data) // plan.batch)
        for _ in range(epochs):
            order = rng.permutation(len(data))
            for at in range(0, len(order), plan.batch):
                own = order[at:at + plan.batch]
                loss, grads = self.gradients(data[own], lengths[own], labels[own])
                norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
                losses.append(loss)
                step += 1
                rate = plan.rate * (1 - step / (total + 1)) / (1 if norm < 1 else norm)
                for name, g in grads.items():
                    first[name] += 0.1 * (g - first[name])
                    second[name] += 0.01 * (g * g - second[name])
                    grown = first[name] / (1 - 0.9 ** step), second[name] / (1 - 0.99 ** step)
                    self.p[name] -= (rate * grown[0] / (np.sqrt(grown[1]) + 1e-8)).astype(np.float32)
        return losses


@dataclass
class Model:
    languages: list[str]
    network: Network | None
    window: int

    def score(self, texts: list[bytes], chunk: int = 2048) -> np.ndarray:
        """Mean probability of every language over all bytes of every text; empty texts have zeros. What is missing to 1 belongs to the
        background."""
        data, lengths, owner = windows_of(texts, self.window)
        out = np.zeros((len(texts), len(self.languages)))
        for at in range(0, len(data), chunk):
            probs = self.network.probabilities(data[at:at + chunk], lengths[at:at + chunk]).sum(axis=0, dtype=np.float64)
            np.add.at(out, owner[at:at + chunk], probs[:, :len(self.languages)])
        return out / np.maximum(1, np.fromiter(map(len, texts), np.int64, len(texts)))[:, None]

    def labels(self, text: bytes) -> np.ndarray:
        """The language number of every byte; the number after the last language is the background."""
        data, lengths, _ = windows_of([text], self.window)
        best = self.network.probabilities(data, lengths).argmax(axis=2).T
        return best[np.arange(self.window) < lengths[:, None]]


def held_out(id_col: Column) -> Column:
    """The fold that is never learned from; a null id belongs to no fold."""
    return F.coalesce(F.crc32(id_col.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def sample_windows(docs: DataFrame, plan: Plan, id_col: str, text_col: str, lang_col: str) -> DataFrame:
    """lang, data: windows of at most ``per_language`` learnable documents of every language.

    Documents are dealt to ``per_language`` bins of their language by a hash of id and text, and each bin gives the one with
    the smallest hash: an aggregation of numbers. The chosen hashes, as bounded as the classes of the model, are broadcast
    to the scan. Repeated rows have one hash, and only one of them gives its windows; no text is shuffled.
    """
    fold = docs[id_col].isNotNull() & ~held_out(docs[id_col])
    df = docs.select(docs[id_col].cast("string").alias("id"), docs[text_col].cast("binary").alias("text"),
                     docs[lang_col].cast("string").alias("lang")).where(fold & docs[lang_col].isNotNull())
    df = df.where("text is not null and length(text) > 0").withColumn("h", F.xxhash64("id", "text"))
    bins = df.select("lang", "h").groupBy("lang", F.pmod("h", F.lit(plan.per_language)).alias("bin")).agg(F.min("h").alias("h"))
    chosen = df.join(F.broadcast(bins.select("lang", "h")), ["lang", "h"]).select("lang", "text", "h")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            langs, hashes, numbers, data = [], [], [], []
            for lang, text, h in zip(*(batch.column(c).to_pylist() for c in ("lang", "text", "h"))):
                count = -(-len(text) // plan.window)
                rng = np.random.default_rng(h & 0xFFFFFFFF)
                for i in sorted(rng.permutation(count)[:plan.per_document].tolist()):
                    langs.append(lang)
                    hashes.append(h)
                    numbers.append(i)
                    data.append(text[i * plan.window:(i + 1) * plan.window])
            yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(hashes, pa.int64()), pa.array(numbers, pa.int64()),
                                              pa.array(data, pa.binary())], names=["lang", "h", "number", "data"])

    return chosen.mapInArrow(run, "lang string, h long, number long, data binary").distinct().select("lang", "data")


def fit(docs: DataFrame, plan: Plan = Plan(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> Model:
    """Learn from text and language of the documents outside the held-out fold; without any, the model knows no language."""
    rows = sample_windows(prepared(docs), plan, id_col, text_col, lang_col).collect()
    languages = sorted({r["lang"] for r in rows})
    if not languages:
        return Model([], None, plan.window)
    rows = sorted(rows, key=lambda r: (r["lang"], bytes(r["data"])))
    windows, labels = [bytes(r["data"]) for r in rows], [languages.index(r["lang"]) for r in rows]
    others = background_windows(windows, round(plan.background * len(windows) / len(languages)), plan.window, plan.seed)
    data, lengths, _ = windows_of(windows + others, plan.window)
    network = Network(len(languages) + (1 if others else 0), plan.hidden, plan.seed)
    network.train(data, lengths, np.array(labels + [len(languages)] * len(others)), plan)
    return Model(languages, network, plan.window)


def _verdicts(model: Model, raw: list[bytes | None]) -> tuple[list[str], list[float]]:
    known = [t is not None and bool(LETTER.search(as_text(t))) for t in raw]
    names, scores = [UNDETERMINED] * len(raw), [0.0] * len(raw)
    which = [i for i, k in enumerate(known) if k] if model.languages else []
    if which:
        probs = model.score([raw[i] for i in which])
        for i, p in zip(which, probs):
            best = int(p.argmax())
            names[i], scores[i] = model.languages[best], min(1.0, float(p[best]))
    return names, scores


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, held_out, lang_pred, score of every whole text; one pass, nothing is shuffled.

    The score is the mean probability of the language over all bytes; a text of no learned language has a low one. Defined cases: ``und`` with score 0 for a null
    text, a text without a letter, or a model without languages; ties go to the language that sorts first; repeated rows
    are judged each; a null doc_id is not held out and never learned from; other columns are not read.
    """
    df = id_and_text(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, budget=1 << 20):
                names, scores = _verdicts(model, part.column("text").to_pylist())
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("held_out"), pa.array(names, pa.string()),
                                                  pa.array(scores, pa.float64())],
                                                 names=["doc_id", "held_out", "lang_pred", "score"])

    df = df.select("doc_id", "text", held_out(F.col("doc_id")).alias("held_out"))
    return df.mapInArrow(run, f"doc_id {dict(df.dtypes)['doc_id']}, held_out boolean, lang_pred string, score double")


def spans_by_language(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Runs of bytes with the same label: doc_id, start, length, lang (``und`` for the background). Null and empty texts have none."""
    df = id_and_text(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, budget=1 << 20):
                ids, starts, lengths, names = [], [], [], []
                for doc_id, text in zip(part.column("doc_id").to_pylist(), part.column("text").to_pylist()):
                    if not text or not model.languages:
                        continue
                    label = model.labels(text)
                    at = np.flatnonzero(np.concatenate(([True], label[1:] != label[:-1])))
                    ids += [doc_id] * len(at)
                    starts += at.tolist()
                    lengths += np.diff(np.append(at, len(label))).tolist()
                    names += [(*model.languages, UNDETERMINED)[i] for i in label[at]]
                yield pa.RecordBatch.from_arrays([pa.array(ids, part.schema.field("doc_id").type), pa.array(starts, pa.int64()),
                                                  pa.array(lengths, pa.int64()), pa.array(names, pa.string())],
                                                 names=["doc_id", "start", "length", "lang"])

    return df.mapInArrow(run, f"doc_id {dict(df.dtypes)['doc_id']}, start long, length long, lang string")


def keep_identified(docs: DataFrame, model: Model, least: float = 0.3, text_col: str = "text") -> DataFrame:
    """The documents whose language is determined with a score of ``least`` or more, with all their columns.

    Defined cases: null texts and texts without a letter go; a model without languages can judge nothing, and every document
    stays; repeated rows and rows without id are judged each; no rows give no rows; a column may have any name.
    """
    if not model.languages:
        return docs
    name = free_name(docs, "identified")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = []
            for part in slices(batch.select([name]), name, 1 << 20):
                names, scores = _verdicts(model, part.column(name).to_pylist())
                keep += [n != UNDETERMINED and s >= least for n, s in zip(names, scores)]
            yield batch.drop_columns([name]).filter(pa.array(keep, pa.bool_()))

    return prepared(docs).withColumn(name, docs[text_col].cast("binary")).mapInArrow(run, docs.schema)
