"""Packing into training sequences: vector bin packing by dot products under limits on tokens, segments and loss tokens."""

from __future__ import annotations

import functools
import json
import os
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import compress

import numpy as np
import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame

from outings.llm.common import Segments, as_text, byte_symbols, id_and_text, prepared, slices, spans
from outings.llm.merges import Merger

# Local sequence numbers of a partition stand in the lower bits of a sequence id, the partition in the upper ones.
LOCAL_BITS = 36


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 64
    loss_tokens: int = 2048


@dataclass
class Item:
    """What is left of an example: tokens from ``start`` on. ``loss`` has the loss-bearing tokens before every position,
    None where all tokens bear loss."""

    key: int
    start: int
    length: int
    loss: np.ndarray | None = None

    def loss_of(self, length: int) -> int:
        return length if self.loss is None else int(self.loss[self.start + length] - self.loss[self.start])

    def longest(self, tokens: int, loss_tokens: int) -> int:
        """The longest beginning within both limits."""
        most = min(tokens, self.length)
        if self.loss is None:
            return min(most, loss_tokens)
        reach = int(np.searchsorted(self.loss, self.loss[self.start] + loss_tokens, side="right")) - 1 - self.start
        return min(most, reach)


class Packer:
    """Fills one sequence after the other from a window of waiting items.

    Each step places the item that fits in all dimensions and has the largest dot product with what is left of the
    sequence, every dimension as a share of its limit. When nothing fits any more and cuts are allowed, the longest item
    gives a beginning that fills the gap. The window bounds the memory; it drops nothing, as it is emptied at the end.
    Placements are (key, start, length, sequence, offset).
    """

    def __init__(self, limits: Limits = Limits(), window: int = 128, cuts: bool = True):
        self.limits, self.window, self.cuts = limits, window, cuts
        self.items: list[Item] = []
        self.sequence = 0
        self.out: list[tuple[int, int, int, int, int]] = []

    def add(self, key: int, length: int, loss: np.ndarray | None = None) -> None:
        item = Item(key, 0, length, loss)
        if self.cuts:
            while (n := item.longest(self.limits.tokens, self.limits.loss_tokens)) < item.length or n == self.limits.tokens:
                if n < self.limits.tokens:
                    break
                self._close([(item, n)])
        if item.length:
            self.items.append(item)
        while len(self.items) >= self.window:
            self._fill()

    def finish(self) -> None:
        while self.items:
            self._fill()

    def taken(self) -> list[tuple[int, int, int, int, int]]:
        out, self.out = self.out, []
        return out

    def waiting(self) -> set[int]:
        return {i.key for i in self.items}

    def _close(self, parts: list[tuple[Item, int]]) -> None:
        offset = 0
        for item, n in parts:
            self.out.append((item.key, item.start, n, self.sequence, offset))
            item.start, item.length, offset = item.start + n, item.length - n, offset + n
        self.sequence += 1

    def _fill(self) -> None:
        tokens, segments, loss = self.limits.tokens, self.limits.segments, self.limits.loss_tokens
        length = np.array([i.length for i in self.items], np.int64)
        bears = np.array([i.loss_of(i.length) for i in self.items], np.int64)
        open_, parts = np.ones(len(length), bool), []
        left, places, left_loss = tokens, segments, loss
        while left and places:
            fits = open_ & (length <= left) & (bears <= left_loss)
            if self.cuts and places == 1 and len(length) and not (fits & (length == left)).any() and (open_ & (length > left)).any():
                break
            if not fits.any():
                break
            dot = length * (left / tokens ** 2) + bears * (left_loss / max(1, loss) ** 2) + places / segments ** 2
            best = int(np.argmax(np.where(fits, dot, -1.0)))
            parts.append((self.items[best], int(length[best])))
            open_[best] = False
            left, places, left_loss = left - int(length[best]), places - 1, left_loss - int(bears[best])
        if self.cuts and left and places and open_.any():
            longest = int(np.argmax(np.where(open_, length, -1)))
            n = self.items[longest].longest(left, left_loss)
            if n:
                parts.append((self.items[longest], n))
                left -= n
        if not parts:
            # Alone and still beyond a limit: given without a sequence.
            item = self.items.pop(int(np.argmax(np.maximum(length / tokens, bears / max(1, loss)))))
            self.out.append((item.key, item.start, item.length, -1, -1))
            return
        if self.cuts and left and (not places or not open_.any()):
            # No segment is left, or no item: what there is needs no padding at lengths that are powers of two.
            self._tail(parts)
        else:
            self._close(parts)
        self.items = [i for i in self.items if i.length]

    def _tail(self, parts: list[tuple[Item, int]]) -> None:
        """A sequence that stays short, cut into sequences whose lengths are powers of two: no padding."""
        total = sum(n for _, n in parts)
        for bit in reversed(range(total.bit_length())):
            need, own = total & (1 << bit), []
            while need:
                item, n = parts[0]
                take = min(n, need)
                own.append((item, take))
                need -= take
                parts[0] = (item, n - take)
                if n == take:
                    parts.pop(0)
            if own:
                self._close(own)


# Distinct words, and distinct parts of words, that a worker remembers. Forgotten ones are encoded again; a worker that also runs other
# stages has less memory for them.
KNOWN = 1_000_000
# Below this character, classes of characters and lower case are the same everywhere, and nothing is composed.
PLAIN = "\u0250"
# The pattern of the pre-tokenizer (a fixed value), and a space that stands between words.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class Words:
    """Ids of a text by the tokenizer file ``path``: BPE over bytes with word ends, lower case, white space dropped.

    The ids of a text are those of its words, so every distinct word is encoded once. Words in plain letters are cut by
    the tokenizer's own pattern, and the distinct parts are merged together in numpy; all other words, and those with a
    special token in them, go through the library.
    """

    def __init__(self, path: str, known: int = KNOWN):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model, steps = spec["model"], [n["type"] for n in spec["normalizer"]["normalizers"]]
        split = spec["pre_tokenizer"]["pretokenizers"][0]
        if (model["type"], model["end_of_word_suffix"], steps, split["pattern"]) != (
                "BPE", "</w>", ["NFC", "Replace", "Lowercase"], {"Regex": PATTERN}) or split["behavior"] != "Removed":
            raise ValueError("a lower-casing BPE with word ends that drops white space is needed")
        ids = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        left, right = ([ids[p[side]] for p in pairs] for side in (0, 1))
        self.merger = Merger(left, right, range(len(pairs)), [ids[a + b] for a, b in pairs])
        symbols = sorted(byte_symbols().items())
        self.inner = np.array([ids[c] for _, c in symbols], np.int64)
        self.last = np.array([ids[c + "</w>"] for _, c in symbols], np.int64)
        self.pattern = regex.compile(PATTERN + "| ")
        self.special = [t["content"] for t in spec["added_tokens"]]
        self.parts = Segments(self.of_parts, known)
        self.segments = Segments(self.of_words, known)

    def of_parts(self, parts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        raw = [p.encode() for p in parts]
        data = np.frombuffer(b"".join(raw), np.uint8)
        lengths = np.fromiter(map(len, raw), np.int64, len(raw))
        symbols = self.inner[data]
        ends = np.cumsum(lengths) - 1
        symbols[ends] = self.last[data[ends]]
        return self.merger.merge(symbols, lengths)

    def of_words(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        try:
            # Words hold no space, so they are decoded together.
            everything = b" ".join(words).decode("utf-8")
            texts = everything.split(" ")
        except UnicodeDecodeError:
            texts = [as_text(w) for w in words]
            everything = " ".join(texts)
        special = [s for s in self.special if s in everything]
        if everything.isascii() and not special:
            plain = np.ones(len(texts), bool)
        else:
            plain = np.array([(t.isascii() or max(t) < PLAIN) and not (special and any(s in t for s in special)) for t in texts], bool)
        out: dict[bool, tuple[np.ndarray, np.ndarray]] = {}
        found = self.pattern.findall(" ".join(compress(texts, plain.tolist())).lower())
        gap = np.fromiter((f == " " for f in found), bool, len(found))
        self.parts.begin()
        codes = self.parts.codes([f for f in found if f != " "])
        owner = np.cumsum(gap)[~gap]
        out[True] = (self.parts.gather(codes), np.bincount(owner, weights=self.parts.lengths[codes], minlength=int(plain.sum()))
                     .astype(np.int64))
        others = [t for t, p in zip(texts, plain) if not p]
        ids = [e.ids for e in self.tokenizer.encode_batch(others, add_special_tokens=False)] if others else []
        out[False] = (np.fromiter((i for word in ids for i in word), np.int64), np.fromiter(map(len, ids), np.int64, len(ids)))
        lengths = np.zeros(len(words), np.int64)
        for kind in out:
            lengths[plain == kind] = out[kind][1]
        starts, flat = np.cumsum(lengths) - lengths, np.zeros(int(lengths.sum()), np.int64)
        for kind, (own, counts) in out.items():
            flat[spans(starts[plain == kind], counts)] = own
        return flat, lengths

    def encode(self, texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and where each text ends."""
        self.segments.begin()
        words, stops = [], []
        for text in texts:
            words += (text or b"").split()
            stops.append(len(words))
        codes = self.segments.codes(words)
        total = np.concatenate(([0], np.cumsum(self.segments.lengths[codes])))
        return self.segments.gather(codes), total[np.array(stops, np.int64)]


@functools.lru_cache(maxsize=2)
def words(path: str, known: int = KNOWN) -> Words:
    return Words(path, known)


def _sequence_base() -> int:
    context = TaskContext.get()
    return (context.partitionId() if context else 0) << LOCAL_BITS


def pack_documents(docs: DataFrame, path: str, limits: Limits = Limits(), end_id: int = 1, window: int = 128,
                   id_col: str = "doc_id", text_col: str = "text", known: int = KNOWN) -> DataFrame:
    """Pieces of documents in sequences: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    Every task packs its own rows, so nothing is shuffled and no task holds more than a window of unplaced pieces. The
    only sequences that are not full are those at the end of a partition and those whose segments were used up by short documents; their
    lengths are powers of two. Sequence ids
    carry the partition, so they are unique, and a task that runs again gives the same rows as long as it reads the same
    rows. Defined cases: a null or empty text is the end id alone; a text beyond the limit is cut into full sequences and
    a rest; repeated rows are packed each; no rows give no rows; extra columns are ignored.
    """
    df = id_and_text(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, packer, base = words(path, known), Packer(limits, window), _sequence_base()
        held: dict[int, tuple] = {}
        key = 0

        def rows() -> pa.RecordBatch:
            placed = packer.taken()
            crc = [zlib.crc32(held[k][1][s:s + n].tobytes()) for k, s, n, _, _ in placed]
            flat = [pa.array([held[k][0] for k, *_ in placed], id_type)]
            flat += [pa.array([p[i] for p in placed], pa.int64()) for i in (1, 2)]
            flat += [pa.array(crc, pa.int64()), pa.array([len(held[k][1]) for k, *_ in placed], pa.int64())]
            flat += [pa.array([base + p[3] for p in placed], pa.int64()), pa.array([p[4] for p in placed], pa.int64())]
            return pa.RecordBatch.from_arrays(
                flat, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"])

        id_type = pa.int64()
        for batch in batches:
            id_type = batch.schema.field("doc_id").type
            for part in slices(batch, budget=2 << 20):
                ids, stops = encoder.encode(part.column("text").to_pylist())
                ids, start = ids.astype("<u4"), 0
                for doc_id, stop in zip(part.column("doc_id").to_pylist(), stops.tolist()):
                    own = np.append(ids[start:stop], np.uint32(end_id)).astype("<u4")
                    held[key], start = (doc_id, own), stop
                    packer.add(key, len(own))
                    key += 1
                yield rows()
                waiting = packer.waiting()
                held = {k: v for k, v in held.items() if k in waiting}
        packer.finish()
        yield rows()

    kind = dict(df.dtypes)["doc_id"]
    return df.mapInArrow(run, f"doc_id {kind}, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, "
                              "offset long")


def pack_examples(examples: DataFrame, limits: Limits, cuts: bool = False, window: int = 128, id_col: str = "id",
                  tokens_col: str = "n_tokens", loss_col: str = "n_loss") -> DataFrame:
    """Instruction examples with counts of tokens and loss-bearing tokens: id, start, length, sequence_id, offset.

    With ``cuts`` the loss-bearing tokens are taken to be an example's last ones. Without, examples stay whole; one that
    is beyond a limit by itself comes back with null sequence and offset. Null counts are read as 0, and an example
    without tokens takes no place and is given with length 0 and no sequence.
    """
    df = prepared(examples).select(examples[id_col].alias("id"), examples[tokens_col].cast("long").alias("n"),
                                   examples[loss_col].cast("long").alias("loss"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, base, names, key = Packer(limits, window, cuts), _sequence_base(), {}, 0

        def rows() -> pa.RecordBatch:
            placed = packer.taken()
            at = [None if p[3] < 0 else base + p[3] for p in placed]
            return pa.RecordBatch.from_arrays(
                [pa.array([names[p[0]] for p in placed], id_type), pa.array([p[1] for p in placed], pa.int64()),
                 pa.array([p[2] for p in placed], pa.int64()), pa.array(at, pa.int64()),
                 pa.array([None if p[4] < 0 else p[4] for p in placed], pa.int64())],
                names=["id", "start", "length", "sequence_id", "offset"])

        id_type = pa.int64()
        for batch in batches:
            id_type = batch.schema.field("id").type
            for name, n, loss in zip(*(batch.column(c).to_pylist() for c in ("id", "n", "loss"))):
                n, loss = max(0, n or 0), max(0, min(loss or 0, n or 0))
                names[key] = name
                if not n:
                    packer.out.append((key, 0, 0, -1, -1))
                else:
                    packer.add(key, n, np.maximum(0, np.arange(n + 1) - (n - loss)))
                key += 1
            yield rows()
            waiting = packer.waiting()
            names = {k: v for k, v in names.items() if k in waiting}
        packer.finish()
        yield rows()

    return df.mapInArrow(run, f"id {dict(df.dtypes)['id']}, start long, length long, sequence_id long, offset long")
