"""Token counts, piece digests and packing against the libraries they have to agree with."""

import hashlib
import random
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
from llm.conftest import AWKWARD
from pyspark.sql import functions as F
from sentencepiece import SentencePieceProcessor
from tokenizers import Tokenizer

from outings.llm.merges import Merger
from outings.llm.packing import Item, Limits, Packer, Words, pack_documents, pack_examples
from outings.llm.pieces import Pieces, decode_documents, encode_documents, piece_digests
from outings.llm.token_counts import Counter, token_counts

BYTES, WORDS, PIECES = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json", "piece_bpe_32k.model"))
PARTS = [" ", "  ", "\n", "\t", "a", "the", "Hello", "'s", "1", "23", "é", "中文", "<s>", "<|endoftext|>", "🙂", "▁", "\x85", "\x1c",
         "!!", "_", "\r\n", "x" * 50, " ab", "ﬁ", "\0", "aaaa", "ing", "ation", "ǅ", "ก", "Ⅷ"]


def strings(n=3000, seed=1):
    rnd = random.Random(seed)
    return ["".join(rnd.choice(PARTS) for _ in range(rnd.randint(0, 14))) for _ in range(n)]


def test_counts_equal_the_library(spark, awkward, nothing):
    library, counter = Tokenizer.from_file(BYTES), Counter(BYTES)
    for text in strings():
        assert counter.count([text])[0] == len(library.encode(text, add_special_tokens=False).ids), repr(text)
    got = token_counts(awkward, BYTES, limit=100)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"] and got.count() == len(AWKWARD)
    for r in got.collect():
        text = next(t for i, t, _ in AWKWARD if i == r.doc_id) or ""
        n = len(library.encode(text, add_special_tokens=False).ids)
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 100)
    assert token_counts(nothing, BYTES).count() == 0


def test_whole_tokens_are_proven():
    counter = Counter(BYTES)
    library = Tokenizer.from_file(BYTES).model
    for word in random.Random(2).sample(sorted(counter.whole), 300):
        mapped = "".join(map(dict(enumerate_bytes()).get, word.encode()))
        assert [t.value for t in library.tokenize(mapped)] == [mapped]


def enumerate_bytes():
    from outings.llm.common import byte_symbols
    return byte_symbols().items()


def test_bounded_table_gives_the_same_counts():
    counter = Counter(BYTES)
    before = [counter.count([t])[0] for t in strings(200)]
    counter.segments.limit = 3
    assert [counter.count([t])[0] for t in strings(200)] == before


@pytest.fixture(scope="module")
def model():
    return Pieces(PIECES), SentencePieceProcessor(model_file=PIECES)


def sha(data):
    return hashlib.sha256(data).hexdigest()


def test_pieces_equal_the_library(model):
    own, library = model
    for text in strings():
        ids = own.encode([text])[0].tolist()
        assert ids == library.encode(text) + [2], repr(text)
        assert own.decode(ids) == library.decode(ids)
    rnd = random.Random(3)
    for _ in range(2000):
        ids = [rnd.choice([0, 1, 2, 3, 131, 200, 255, 28705, 259, 1000, 264, 233]) for _ in range(rnd.randint(0, 8))]
        assert own.decode(ids) == library.decode(ids), ids
    long = "".join(rnd.choice("abcdefgh") for _ in range(20_000))
    assert own.encode([long])[0].tolist() == library.encode(long) + [2]


def test_digests(awkward, nothing, model):
    _, library = model
    rows = piece_digests(awkward, PIECES).collect()
    assert len(rows) == len(AWKWARD)
    for r in rows:
        text = next(t for i, t, _ in AWKWARD if i == r.doc_id) or ""
        ids = library.encode(text) + [2]
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha(" ".join(map(str, ids)).encode()))
        assert r.decoded_sha256 == sha(library.decode(ids).encode())
    assert piece_digests(nothing, PIECES).count() == 0


def test_round_trip(prose):
    back = decode_documents(encode_documents(prose, PIECES), PIECES)
    joined = prose.select("doc_id", "text").join(back.withColumnRenamed("text", "again"), "doc_id")
    assert joined.count() == prose.count() and joined.where("text <> again").count() == 0


def test_merges_equal_one_at_a_time():
    """Random tables in which a merged symbol may form a pair of a smaller rank."""
    rnd = random.Random(4)
    for _ in range(300):
        table = {}
        for rank in rnd.sample(range(40), 12):
            pair = (rnd.randrange(8), rnd.randrange(8))
            table.setdefault(pair, (rank, rnd.randrange(8)))
        pairs = list(table)
        merger = Merger([p[0] for p in pairs], [p[1] for p in pairs], [table[p][0] for p in pairs], [table[p][1] for p in pairs])
        words = [[rnd.randrange(8) for _ in range(rnd.randint(1, 12))] for _ in range(20)]
        flat, lengths = merger.merge(np.array(sum(words, [])), np.array(list(map(len, words))))
        got = [p.tolist() for p in np.split(flat, np.cumsum(lengths)[:-1])]
        for word, own in zip(words, got):
            while found := [(table[p][0], i, table[p][1]) for i, p in enumerate(zip(word, word[1:])) if p in table]:
                _, i, new = min(found)
                word[i:i + 2] = [new]
            assert own == word


def test_words_equal_the_library():
    library, own = Tokenizer.from_file(WORDS), Words(WORDS)
    extra = ["İstanbul", "ÀÉ", "don't WE'LL", "ß", "x²½", "e\u0301", "\u212b", "ΑΣ", "<|startoftext|>a", "\u0130\u0307", "1st 22nd"]
    for text in strings() + extra:
        ids, stops = own.encode([text.encode()])
        assert ids.tolist() == library.encode(text, add_special_tokens=False).ids and stops.tolist() == [len(ids)], repr(text)


def check_packing(rows, limits):
    by_doc, by_sequence = {}, {}
    for r in rows:
        by_doc.setdefault(r.doc_id, []).append(r)
        by_sequence.setdefault(r.sequence_id, []).append(r)
    padding = total = 0
    for own in by_sequence.values():
        at = 0
        for r in sorted(own, key=lambda r: r.offset):
            assert r.offset == at and r.length > 0
            at += r.length
        assert at <= limits.tokens and len(own) <= limits.segments
        total += at
        padding += 0 if at & (at - 1) == 0 else limits.tokens - at
    return by_doc, padding / max(1, total)


def test_packing(awkward, nothing, prose):
    library = Tokenizer.from_file(WORDS)
    rows = pack_documents(awkward, WORDS).collect()
    by_doc, padding = check_packing(rows, Limits())
    assert padding == 0 and set(by_doc) == {i for i, _, _ in AWKWARD}
    for doc_id, own in by_doc.items():
        text = next(t for i, t, _ in AWKWARD if i == doc_id) or ""
        ids = np.array(library.encode(text, add_special_tokens=False).ids + [1], "<u4")
        copies = sum(i == doc_id for i, _, _ in AWKWARD)
        assert sum(r.length for r in own) == copies * len(ids)
        for r in own:
            assert r.doc_tokens == len(ids) and r.ids_crc32 == zlib.crc32(ids[r.start:r.start + r.length].tobytes())
        if copies == 1:
            at = 0
            for r in sorted(own, key=lambda r: r.start):
                assert r.start == at
                at += r.length
    assert pack_documents(nothing, WORDS).count() == 0
    _, padding = check_packing(pack_documents(prose.repartition(2), WORDS, Limits(2048, 8, 2048)).collect(), Limits(2048, 8, 2048))
    assert padding < 0.1


def test_packer_keeps_every_limit():
    rnd = random.Random(5)
    for cuts in (True, False):
        limits, packer, given = Limits(100, 4, 40), Packer(Limits(100, 4, 40), 16, cuts), {}
        for key in range(500):
            n = rnd.randint(1, 160 if cuts else 110)
            loss = rnd.randint(0, n)
            given[key] = (n, np.maximum(0, np.arange(n + 1) - (n - loss)))
            packer.add(key, *given[key])
        packer.finish()
        out = packer.taken()
        sequences, pieces = {}, {}
        for key, start, length, sequence, offset in out:
            pieces.setdefault(key, []).append((start, length))
            if sequence >= 0:
                sequences.setdefault(sequence, []).append((offset, length, given[key][1][start + length] - given[key][1][start]))
            else:
                n, loss = given[key]
                assert n > limits.tokens or loss[-1] > limits.loss_tokens
        for own in sequences.values():
            assert sum(o[1] for o in own) <= 100 and len(own) <= 4 and sum(o[2] for o in own) <= 40
        for key, own in pieces.items():
            at = 0
            for start, length in sorted(own):
                assert start == at
                at += length
            assert at == given[key][0] and (cuts or len(own) == 1)
        assert set(pieces) == set(given)


def test_items_know_their_loss():
    item = Item(0, 2, 6, np.array([0, 0, 1, 1, 2, 3, 3, 4, 5]))
    assert item.loss_of(3) == 2 and item.longest(10, 1) == 2 and item.longest(10, 9) == 6 and item.longest(1, 9) == 1


def test_examples(spark):
    rows = [(i, 10 + i % 90, i % 10) for i in range(400)] + [(1000, 500, 1), (1001, None, None), (1002, 0, 3)]
    df = spark.createDataFrame(rows, "id long, n_tokens int, n_loss int").repartition(2)
    out = pack_examples(df, Limits(128, 3, 12)).collect()
    assert sorted(r.id for r in out) == sorted(r[0] for r in rows)
    assert {r.id for r in out if r.sequence_id is None} == {1000, 1001, 1002}
    given = {i: (n, m) for i, n, m in rows}
    for key in {r.sequence_id for r in out} - {None}:
        own = [given[r.id] for r in out if r.sequence_id == key]
        assert sum(o[0] for o in own) <= 128 and sum(o[1] for o in own) <= 12 and len(own) <= 3
    assert pack_examples(df.where(F.lit(False)), Limits()).count() == 0


@pytest.mark.parametrize("words", [(4, 4), (2, 19)])
def test_short_documents_need_little_padding(spark, words):
    """One partition of documents so short that the segments of a sequence are used up before its tokens."""
    rows = spark.range(0, 5000, 1, 1).selectExpr("id AS doc_id", f"trim(repeat('the ', CAST({words[0]} + id % {words[1] - words[0] + 1} AS int))) AS text")
    pieces = pack_documents(rows, WORDS).collect()
    sizes, segments = defaultdict(int), defaultdict(int)
    for p in pieces:
        sizes[p.sequence_id] += p.length
        segments[p.sequence_id] += 1
    padding = sum(0 if n & (n - 1) == 0 else 2048 - n for n in sizes.values())
    assert sum(sizes.values()) == sum(p.length for p in pieces) >= 25_000 and padding == 0 and max(sizes.values()) <= 2048
    assert max(segments.values()) <= Limits().segments


def test_packing_does_not_depend_on_what_is_remembered(spark):
    texts = [" ".join(f"w{(i * 7 + j * j) % 997}" for j in range(50)) for i in range(60)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    assert pack_documents(rows, WORDS, known=5).collect() == pack_documents(rows, WORDS).collect()


def test_segments_are_encoded_once_in_the_order_met():
    from outings.llm.common import Segments

    asked = []

    def encode(new):
        asked.append(list(new))
        return np.array([len(s) for s in new]), np.ones(len(new), np.int64)

    table = Segments(encode)
    assert table.codes(["b", "a", "b"]).tolist() == [0, 1, 0] and table.codes(["a", "ccc", "ccc", "b"]).tolist() == [1, 2, 2, 0]
    assert asked == [["b", "a"], ["ccc"]] and table.gather(np.array([2, 0])).tolist() == [3, 1] and not len(table.codes([]))


def test_words_that_are_no_utf8_and_special_ones():
    from tokenizers import Tokenizer

    from outings.llm.packing import Words

    path = public_tokenizers.path("word_bpe_49k.json")
    texts = [b"a \xff\xc3 b", b"\xc0\x80x Hello, World", b"<|endoftext|> A<|startoftext|>x", "ΣΑΣ ǅ ɐ İ x y é".encode(), b"plain words only"]
    library = Tokenizer.from_file(path)
    for own in (texts, texts[2:], texts[4:]):
        ids, stops = Words(path).encode(own)
        want = [library.encode(t.decode("utf-8", "replace"), add_special_tokens=False).ids for t in own]
        assert ids.tolist() == [i for w in want for i in w] and stops.tolist() == np.cumsum([len(w) for w in want]).tolist()
