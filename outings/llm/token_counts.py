"""Token counts of a byte-level BPE vocabulary: strings that are provably one token are counted, only the rest is merged."""

from __future__ import annotations

import functools
import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from outings.llm.common import Segments, as_text, byte_symbols, id_and_text, slices
from outings.llm.merges import Merger

# A space next to white space on both sides: there a text must not be cut.
LONE_SPACE = re.compile(r"\s \s")
# Segments that can stand next to each other without changing their pre-tokens.
# Below this character, classes of characters are the same in every version of Unicode.
PLAIN = "\u0250"
# The pattern of byte-level pre-tokenizers (a fixed value).
PATTERN = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
JOINS = re.compile(r" \S(?s:.*)\S| \S")


class Counter:
    """Counts tokens as the library does for the tokenizer file ``path``.

    The merges are replayed once over every vocabulary string, alone: those that end as one symbol form the set
    ``whole``. A pre-token in it is one token without any merge. Pre-tokens come from the library's own pre-tokenizer.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        if model["type"] != "BPE" or spec.get("normalizer") or spec["pre_tokenizer"]["type"] != "ByteLevel":
            raise ValueError("a byte-level BPE without normaliser is needed")
        if model.get("unk_token") or model.get("end_of_word_suffix") or model.get("continuing_subword_prefix"):
            raise ValueError("unknown tokens and affixes are not supported")
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ids = model["vocab"]
        left, right = ([ids[p[side]] for p in pairs] for side in (0, 1))
        self.merger = Merger(left, right, range(len(pairs)), [ids[a + b] for a, b in pairs])
        alphabet = {c: b for b, c in byte_symbols().items()}
        self.byte_ids = np.array([ids[c] for _, c in sorted(byte_symbols().items())], np.int64)
        strings = [bytes(map(alphabet.__getitem__, t)) for t in ids]
        self.whole = frozenset(as_text(t) for t, n in zip(strings, self.merged(strings)) if n == 1)
        specials = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, specials))) if specials else None
        self.pre_tokens = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.segments = Segments(self.of_segments)

    def merged(self, words: list[bytes]) -> list[int]:
        """Symbols left of every pre-token when its pairs are merged."""
        if not words:
            return []
        symbols = self.byte_ids[np.frombuffer(b"".join(words), np.uint8)]
        return self.merger.merge(symbols, np.fromiter(map(len, words), np.int64, len(words)))[1].tolist()

    def of_segments(self, segments: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Tokens of every segment. Segments that begin with one space before a word and end in a word are put after
        each other and cut into pre-tokens in one call, which gives the same pre-tokens; of these, the ones in plain
        letters are cut with the pre-tokenizer's pattern, all others by the pre-tokenizer itself."""
        owners, words, groups = [], [], {True: [], False: []}
        for i, s in enumerate(segments):
            if JOINS.fullmatch(s):
                groups[s.isascii() or max(s) < PLAIN].append(i)
            else:
                found = [s[a:b] for _, (a, b) in self.pre_tokens(s)]
                words += found
                owners += [i] * len(found)
        for plain, chosen in groups.items():
            if chosen:
                joined = "".join(map(segments.__getitem__, chosen))
                found = PATTERN.findall(joined) if plain else [joined[a:b] for _, (a, b) in self.pre_tokens(joined)]
                lengths = np.fromiter(map(len, found), np.int64, len(found))
                ends = np.cumsum([len(segments[i]) for i in chosen])
                owners += np.array(chosen)[np.searchsorted(ends, np.cumsum(lengths) - lengths, side="right")].tolist()
                words += found
        whole = self.whole
        rest = [w for w in dict.fromkeys(words) if w not in whole]
        cost = dict(zip(rest, self.merged([w.encode() for w in rest])))
        get = cost.get
        total = np.bincount(np.array(owners, np.int64), weights=[get(w, 1) for w in words], minlength=len(segments))
        return total.astype(np.int64), np.ones(len(segments), np.int64)

    def cut(self, text: str) -> list[str]:
        """Segments whose pre-tokens are those of the text: cut before a space, unless white space is on both its sides."""
        if not text:
            return []
        if "  " in text or LONE_SPACE.search(text):
            return [s for part in re.split(r"(?<!\s)(?= )|(?= \S)", text) if (s := part)]
        first, *rest = text.split(" ")
        return ([first] if first else []) + [" " + s for s in rest]

    def count(self, texts: list[str]) -> np.ndarray:
        self.segments.begin()
        segments: list[str] = []
        owner, extra = [], np.zeros(len(texts), np.int64)
        for i, text in enumerate(texts):
            before = len(segments)
            if self.special and self.special.search(text):
                extra[i] = len(self.special.findall(text))
                for part in self.special.split(text):
                    segments += self.cut(part)
            else:
                segments += self.cut(text)
            owner.append(len(segments) - before)
        codes = self.segments.codes(segments)
        counts = self.segments.ids[self.segments.starts[codes]]
        ends = np.concatenate(([0], np.cumsum(counts)))
        stops = np.cumsum(owner)
        return ends[stops] - ends[stops - owner] + extra


@functools.lru_cache(maxsize=2)
def counter(path: str) -> Counter:
    return Counter(path)


def token_counts(docs: DataFrame, path: str, limit: int = 1024, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_bytes, n_tokens and over_limit (n_tokens > limit) of every whole text; one pass, nothing is shuffled.

    Defined cases: a null text counts as empty (0 bytes, 0 tokens); repeated rows are counted each; a null doc_id stays
    null; extra columns are ignored. A worker holds one slice of texts and a bounded table of segments.
    """
    df = id_and_text(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path).count
        for batch in batches:
            for part in slices(batch):
                raw = part.column("text").to_pylist()
                n = count([as_text(t) for t in raw])
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array([len(t or b"") for t in raw], pa.int64()), pa.array(n), pa.array(n > limit)],
                    names=["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return df.mapInArrow(run, f"doc_id {dict(df.dtypes)['doc_id']}, n_bytes long, n_tokens long, over_limit boolean")
