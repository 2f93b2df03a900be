"""SentencePiece BPE: encoding by vectorised merge rounds, and decoding."""

from __future__ import annotations

import functools
import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from outings.llm.common import Segments, Strings, as_text, id_and_text, slices, spans
from outings.llm.merges import Merger

SPACE = "\u2581"
# A run of spaces and what follows up to the next one.
SEGMENT = re.compile(f"{SPACE}+[^{SPACE}]*|[^{SPACE}]+")
# Types of a piece in the model file (fixed values).
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6


class Pieces:
    """Encoder and decoder for the model file ``path``: BPE with identity normaliser, dummy prefix and byte fallback.

    A text is cut before every run of spaces. That is exact where no piece has a space after another character, which
    is checked on the vocabulary; otherwise the text is one word. Distinct words are merged together, round by round.
    """

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor, sentencepiece_model_pb2

        spec = sentencepiece_model_pb2.ModelProto()
        spec.ParseFromString(SentencePieceProcessor(model_file=path).serialized_model_proto())
        norm, trainer = spec.normalizer_spec, spec.trainer_spec
        if (trainer.model_type != 2 or norm.name != "identity" or norm.remove_extra_whitespaces or not norm.add_dummy_prefix
                or not norm.escape_whitespaces or not trainer.byte_fallback or trainer.treat_whitespace_as_suffix):
            raise ValueError("a BPE model with identity normaliser, dummy prefix and byte fallback is needed")
        kinds = [p.type for p in spec.pieces]
        if not set(kinds) <= {NORMAL, UNKNOWN, CONTROL, BYTE}:
            raise ValueError("user-defined and unused pieces are not supported")
        self.end = trainer.eos_id
        texts = [p.piece for p in spec.pieces]
        normal = {t: i for i, (t, k) in enumerate(zip(texts, kinds)) if k == NORMAL}
        self.bytes_at = {int(t[3:5], 16): i for i, (t, k) in enumerate(zip(texts, kinds)) if k == BYTE}
        self.surface = [t.replace(SPACE, " ").encode() if k == NORMAL else bytes([int(t[3:5], 16)]) if k == BYTE
                        else trainer.unk_surface.encode() if k == UNKNOWN else b"" for t, k in zip(texts, kinds)]
        self.is_byte = np.array([k == BYTE for k in kinds])
        self.cuts = not any(re.search(f"[^{SPACE}]{SPACE}", t) for t in normal)
        # Characters that are no piece get ids behind the vocabulary; they may still be part of a longer piece.
        self.symbol = {t: i for t, i in normal.items() if len(t) == 1}
        self.plain = dict(normal)
        for t in normal:
            for c in t:
                if c not in self.plain:
                    self.symbol[c] = self.plain[c] = len(texts) + len(self.plain)
        scores = sorted({-spec.pieces[i].score for i in normal.values()})
        rank = {s: r for r, s in enumerate(scores)}
        left, right, ranks, merged = [], [], [], []
        for t, i in normal.items():
            for cut in range(1, len(t)):
                a, b = self.plain.get(t[:cut]), self.plain.get(t[cut:])
                if a is not None and b is not None:
                    left.append(a)
                    right.append(b)
                    ranks.append(rank[-spec.pieces[i].score])
                    merged.append(i)
        self.merger = Merger(left, right, ranks, merged)
        self.size = len(texts)
        self.spaced = {i for t, i in normal.items() if t[0] == SPACE}
        self.segments = Segments(self.of_words)
        # By code point: the id of a character, or for one without a piece the code point behind all ids.
        self.base = self.size + len(self.plain) + 1
        self.code_points = np.arange(self.base, self.base + 0x110000, dtype=np.int32)
        for c, i in self.symbol.items():
            self.code_points[ord(c)] = i
        self.name = Strings([b"%d " % i for i in range(self.size)])
        self.written = Strings(self.surface)

    def of_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of distinct words; characters without a piece become bytes."""
        points = np.frombuffer("".join(words).encode("utf-32-le"), np.uint32)
        ids, lengths = self.merger.merge(self.code_points[points], np.fromiter(map(len, words), np.int64, len(words)))
        unknown = np.flatnonzero(ids >= self.size)
        if not len(unknown):
            return ids, lengths
        names = {i: c for c, i in self.symbol.items() if i >= self.size}
        raw = [[self.bytes_at[b] for b in names.get(i, chr(max(0, i - self.base))).encode()] for i in ids[unknown].tolist()]
        counts = np.ones(len(ids), np.int64)
        counts[unknown] = [len(r) for r in raw]
        out = np.repeat(ids, counts)
        out[spans((np.cumsum(counts) - counts)[unknown], counts[unknown])] = [b for r in raw for b in r]
        total = np.concatenate(([0], np.cumsum(counts)))
        ends = np.cumsum(lengths)
        return out, total[ends] - total[ends - lengths]

    def cut(self, text: str) -> list[str]:
        if not text:
            return []
        text = SPACE + text.replace(" ", SPACE)
        if not self.cuts:
            return [text]
        if SPACE + SPACE in text:
            return SEGMENT.findall(text)
        return [SPACE + s for s in text[1:].split(SPACE)]

    def flat(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts, each with the end id, one after the other, and where each text ends."""
        self.segments.begin()
        words, owner = [], []
        for text in texts:
            before = len(words)
            words += self.cut(text)
            owner.append(len(words) - before)
        codes = self.segments.codes(words)
        total = np.concatenate(([0], np.cumsum(self.segments.lengths[codes])))
        stops = total[np.cumsum(owner)] if texts else np.zeros(0, np.int64)
        return np.insert(self.segments.gather(codes), stops, self.end), stops + np.arange(1, len(texts) + 1)

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of every text with the end id."""
        ids, stops = self.flat(texts)
        return np.split(ids, stops[:-1]) if texts else []

    def decode(self, ids) -> str:
        """Text of ids: the dummy space goes, control ids are silent, every run of byte pieces is read as UTF-8 with a
        replacement character for each byte that does not fit."""
        out, run, opening = [], bytearray(), True
        for i in map(int, ids):
            if self.is_byte[i]:
                run += self.surface[i]
                opening = False
                continue
            out.append(_read(run))
            run = bytearray()
            text = self.surface[i].decode()
            out.append(text[1:] if opening and i in self.spaced else text)
            opening = opening and not text
        return "".join(out) + _read(run)

    def digests(self, texts: list[str]) -> tuple[np.ndarray, list[str], list[str]]:
        """Number of ids, hash of the ids and hash of the decoded text of every text.

        Ids are written out and decoded in one go; ids that come from texts need no more than the dummy space taken off,
        as the bytes of a character always stand together.
        """
        ids, stops = self.flat(texts)
        names, name_ends = self.name.write(ids)
        plain, plain_ends = self.written.write(ids)
        n, p, hashes, decoded = 0, 0, [], []
        for name_end, plain_end in zip(name_ends[stops - 1].tolist(), plain_ends[stops - 1].tolist()):
            hashes.append(sha(names[n:name_end - 1]))
            decoded.append(sha(plain[p + plain.startswith(b" ", p, plain_end):plain_end]))
            n, p = name_end, plain_end
        return np.diff(stops, prepend=0), hashes, decoded


def _read(data: bytearray) -> str:
    """Bytes as UTF-8, one replacement character for every byte that does not fit."""
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        pass
    out, i = [], 0
    while i < len(data):
        for n in (1, 2, 3, 4):
            try:
                out.append(data[i:i + n].decode("utf-8"))
                i += n
                break
            except UnicodeDecodeError:
                continue
        else:
            out.append("\ufffd")
            i += 1
    return "".join(out)


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


@functools.lru_cache(maxsize=2)
def pieces(path: str) -> Pieces:
    return Pieces(path)


def encode_documents(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and ids (array of int, with the end id) of every whole text; null and empty texts have the end id only."""
    df = id_and_text(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in batches:
            for part in slices(batch):
                ids = model.encode([as_text(t) for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array([i.astype(np.int32) for i in ids], pa.list_(pa.int32()))],
                                                 names=["doc_id", "ids"])

    return df.mapInArrow(run, f"doc_id {dict(df.dtypes)['doc_id']}, ids array<int>")


def decode_documents(encoded: DataFrame, path: str, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and text of every list of ids; a null list gives a null text."""
    df = encoded.select(encoded[id_col].alias("doc_id"), encoded[ids_col].alias("ids"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in batches:
            texts = [None if i is None else model.decode(i) for i in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return df.mapInArrow(run, f"doc_id {dict(df.dtypes)['doc_id']}, text string")


def piece_digests(docs: DataFrame, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of every whole text; one pass, nothing is shuffled.

    Defined cases: a null or empty text has the end id only and decodes to the empty text; repeated rows are encoded
    each; extra columns are ignored; bytes that are no UTF-8 are replaced before encoding.
    """
    df = id_and_text(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = pieces(path)
        for batch in batches:
            for part in slices(batch):
                n, ids, plain = model.digests([as_text(t) for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(n), pa.array(ids, pa.string()), pa.array(plain, pa.string())],
                                                 names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return df.mapInArrow(run, f"doc_id {dict(df.dtypes)['doc_id']}, n_tokens long, ids_sha256 string, decoded_sha256 string")
