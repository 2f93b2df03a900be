"""Ranked lexical search without random access: impact-sorted lists, score intervals per document, reads until all is resolved."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import DataType

from outings.llm.common import id_and_text, lowered, slices, token_hashes
from outings.operators.keyed import top_per_group
from outings.sources.tables import materialized

# Terms are runs of ASCII letters and digits and of all bytes of other characters.
TERM = np.zeros(256, np.int8)
TERM[48:58] = TERM[65:91] = TERM[97:123] = TERM[128:] = 1


@dataclass(frozen=True)
class Search:
    """``k`` documents per item. A stripe of the index holds about ``postings`` entries; ``terms`` bounds the items that are
    sent to the tasks at a time, ``bits`` the filter of their terms. After every round of reads the impact down to which
    lists are read falls to ``fall`` of what it was."""

    k: int = 20
    k1: float = 1.2
    b: float = 0.25
    postings: int = 1 << 21
    terms: int = 1 << 19
    bits: int = 22
    fall: float = 0.4


def term_rows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, hash, count) of the distinct terms of every text, and nothing for a text without terms."""
    size = np.fromiter(map(len, texts), np.int64, len(texts))
    starts, hashes, _ = token_hashes(lowered(np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)), TERM)
    owner = np.searchsorted(np.cumsum(size + 1), starts, side="right")
    order = np.lexsort((hashes, owner))
    owner, hashes = owner[order], hashes[order]
    new = np.ones(len(owner), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (hashes[1:] != hashes[:-1])
    at = np.flatnonzero(new)
    return owner[at], hashes[at], np.diff(np.append(at, len(owner)))


def query_terms(items: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """item_id, term, times. Repeated rows count once; the terms of several texts under one id belong to one item."""
    df = id_and_text(items, id_col, text_col).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                owner, terms, times = term_rows([t or b"" for t in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(owner)), pa.array(terms.view(np.int64)),
                                                  pa.array(times, pa.int64())], names=["item_id", "term", "times"])

    found = df.where("doc_id is not null").mapInArrow(run, f"item_id {dict(df.dtypes)['doc_id']}, term long, times long")
    return found.groupBy("item_id", "term").agg(F.sum("times").alias("times"))


def term_filter(queries: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of 2^bits bits, half a megabyte by default whatever the number of queries, that has the bit of every term."""
    slot = F.shiftrightunsigned("term", 64 - bits)
    words = queries.select(slot.alias("slot")).groupBy(F.shiftright("slot", 6).alias("word")).agg(
        F.expr("bit_or(shiftleft(1L, CAST(slot % 64 AS int)))").alias("mask"))
    out = np.zeros(1 << (bits - 6), np.uint64)
    for row in words.toArrow().to_pylist():
        out[row["word"]] = np.uint64(row["mask"] & 0xFFFFFFFFFFFFFFFF)
    return out


def passes(bitmap: np.ndarray, terms: np.ndarray, bits: int) -> np.ndarray:
    slot = terms >> np.uint64(64 - bits)
    return (bitmap[(slot >> np.uint64(6)).astype(np.int64)] >> (slot & np.uint64(63))) & np.uint64(1) > 0


def document_terms(docs: DataFrame, bitmap: np.ndarray, bits: int, id_col: str, text_col: str) -> DataFrame:
    """doc_id, n (terms with repeats) and, of the terms that pass the filter, hashes and counts; one row per document."""
    df = id_and_text(docs, id_col, text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                rows = part.num_rows
                owner, terms, times = term_rows([t or b"" for t in part.column("text").to_pylist()])
                n = np.bincount(owner, weights=times, minlength=rows).astype(np.int64)
                good = passes(bitmap, terms, bits)
                owner, terms, times = owner[good], terms[good], times[good]
                offsets = pa.array(np.searchsorted(owner, np.arange(rows + 1)), pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.array(n), pa.ListArray.from_arrays(offsets, pa.array(terms.view(np.int64))),
                     pa.ListArray.from_arrays(offsets, pa.array(times, pa.int64()))], names=["doc_id", "n", "terms", "times"])

    return df.mapInArrow(run, f"doc_id {dict(df.dtypes)['doc_id']}, n long, terms array<long>, times array<long>")


def document_frequencies(found: DataFrame) -> DataFrame:
    """term and df; terms of a batch are counted in the task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            terms, counts = np.unique(batch.column("terms").flatten().to_numpy(), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(terms, pa.int64()), pa.array(counts, pa.int64())], names=["term", "df"])

    return found.select("terms").mapInArrow(run, "term long, df long").groupBy("term").agg(F.sum("df").alias("df"))


def impact_index(found: DataFrame, n_docs: int, n_terms: int, search: Search) -> DataFrame:
    """Stripes of documents: docs, and for every term (sorted) its list of documents by impact, highest first.

    A stripe is a run of rows of one task, so nothing is shuffled. The impact of a term is (10^9 tf) div (1000 tf + 12 m).
    """
    id_type = dict(found.dtypes)["doc_id"]
    part_b = round(100 * search.b)
    ratio = round(10 * search.k1)

    def stripe(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(parts).combine_chunks()
        lists = table.column("terms").combine_chunks()
        counts = pa.compute.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
        terms = lists.flatten().to_numpy().view(np.uint64)
        tf = table.column("times").combine_chunks().flatten().to_numpy()
        doc = np.repeat(np.arange(len(counts)), counts)
        m = np.array([100 - part_b + (part_b * n * n_docs) // n_terms for n in table.column("n").to_pylist()], np.int64)
        impact = (10 ** 9 * tf) // (1000 * tf + ratio * m[doc])
        order = np.lexsort((doc, -impact, terms))
        own, first = np.unique(terms[order], return_index=True)
        docs = table.column("doc_id").combine_chunks()
        arrays = [pa.ListArray.from_arrays(pa.array([0, len(docs)], pa.int32()), docs)]
        for values, kind in ((own, np.uint64), (np.append(first, len(order)), np.int64), (doc[order], np.int32), (impact[order], np.int32)):
            arrays.append(pa.array([values.astype(kind).tobytes()], pa.binary()))
        return pa.RecordBatch.from_arrays(arrays, names=["docs", "terms", "first", "doc", "impact"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                piece = batch.slice(at, 1024)
                parts.append(piece)
                size += len(piece.column("terms").flatten()) + 1024
                if size >= search.postings:
                    yield stripe(parts)
                    parts, size = [], 0
        if parts:
            yield stripe(parts)

    kinds = f"docs array<{id_type}>, terms binary, first binary, doc binary, impact binary"
    return found.where("size(terms) > 0").mapInArrow(run, kinds)


class Lists:
    """The lists of one stripe."""

    def __init__(self, terms: bytes, first: bytes, doc: bytes, impact: bytes, size: int):
        self.terms, self.first = np.frombuffer(terms, np.uint64), np.frombuffer(first, np.int64)
        self.doc, self.impact, self.size = np.frombuffer(doc, np.int32), np.frombuffer(impact, np.int32), size

    def best(self, terms: np.ndarray, weights: np.ndarray, search: Search) -> tuple[np.ndarray, np.ndarray]:
        """Documents that may be among the k best of the stripe, all ties included, with their final scores.

        Lists are read in the order of impact. ``lower`` is the score that has been read of a document, its upper end adds
        the heads of the lists in which it has not been seen. A document is out once its upper end is below the k-th lower
        end; a list is read on while a document that is not out may still be in it.
        """
        at = np.minimum(np.searchsorted(self.terms, terms), len(self.terms) - 1)
        here = (self.terms[at] == terms) & (weights > 0)
        at, weights = at[here], weights[here]
        lists = [(self.doc[a:b], self.impact[a:b].astype(np.int64) * w)
                 for a, b, w in zip(self.first[at].tolist(), self.first[at + 1].tolist(), weights.tolist())]
        n = len(lists)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        lower, seen, read = np.zeros(self.size, np.int64), np.zeros((n, self.size), bool), [0] * n
        heads = np.array([scores[0] for _, scores in lists], np.int64)
        alive, level = None, int(heads.max())
        while True:
            level = int(level * search.fall)
            for i, (docs, scores) in enumerate(lists):
                if heads[i] > level and (alive is None or not seen[i, alive].all()):
                    stop = int(np.searchsorted(-scores, -level, side="left"))
                    own = docs[read[i]:stop]
                    lower[own] += scores[read[i]:stop]
                    seen[i, own] = True
                    read[i] = stop
                    heads[i] = scores[stop] if stop < len(scores) else 0
            known = alive if alive is not None else np.flatnonzero(lower)
            if len(known) >= search.k:
                floor = int(np.partition(lower[known], -search.k)[-search.k])
            else:
                floor = 0
            if alive is None and (heads.sum() < floor or not heads.any()):
                # No document that has not been seen anywhere can reach the k best.
                alive = known
            if alive is not None:
                upper = lower[alive] + ((~seen[:, alive]) * heads[:, None]).sum(axis=0)
                alive, upper = alive[upper >= floor], upper[upper >= floor]
                if (upper == lower[alive]).all():
                    return alive, lower[alive]


def search_stripes(index: DataFrame, items: list[tuple], search: Search, item_type: DataType) -> DataFrame:
    """item_id, doc_id, score: the best documents of every stripe for a bounded set of items (id, terms, weights)."""
    id_type = dict(index.dtypes)["docs"][6:-1]
    batch_type = to_arrow_type(item_type)
    prepared_items = [(i, np.array(t, np.int64).view(np.uint64), np.array(w, np.int64)) for i, t, w in items]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):
                docs = batch.column("docs")[row].values
                lists = Lists(*(batch.column(c)[row].as_py() for c in ("terms", "first", "doc", "impact")), len(docs))
                for item, terms, weights in prepared_items:
                    found, scores = lists.best(terms, weights, search)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([item] * len(found), batch_type), docs.take(pa.array(found)), pa.array(scores, pa.int64())],
                        names=["item_id", "doc_id", "score"])

    return index.mapInArrow(run, f"item_id {item_type.simpleString()}, doc_id {id_type}, score long")


def ranked(docs: DataFrame, items: DataFrame, search: Search = Search(), id_col: str = "doc_id", text_col: str = "text",
           item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the k documents with the highest scores above 0 of every item, ties by ascending doc_id.

    Every document is read once for the terms of all items, a filter of fixed size keeps the others out, and the lists stay
    in stripes where the documents are. The items are sent to the stripes in bounded sets; a stripe returns its own best.
    Terms are compared by 64-bit hashes.

    Defined cases: null and empty texts have no terms and are found by nothing; rows of documents that share an id are ranked
    each; a null doc_id is ranked after the others of its score; repeated rows of items count once, several texts under one
    item id are one item, items without id or terms have no rows; empty tables give no rows; extra columns are ignored.
    """
    item_type = dict(items.dtypes)[item_col]
    queries = materialized(query_terms(items, item_col, item_text_col), "query-terms")
    found = materialized(document_terms(docs, term_filter(queries, search.bits), search.bits, id_col, text_col), "document-terms")
    facts = found.agg(F.count_if(F.col("n") > 0), F.sum("n")).first()
    n_docs, n_terms = facts[0], facts[1] or 1

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weights = [math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) * times
                       for df, times in zip(batch.column("df").to_pylist(), batch.column("times").to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column("item_id"), batch.column("term"), pa.array(weights, pa.int64())],
                                             names=["item_id", "term", "weight"])

    weighed = queries.join(document_frequencies(found), "term").select("item_id", "term", "times", "df")
    weighed = weighed.mapInArrow(weigh, f"item_id {item_type}, term long, weight long")
    whole = weighed.groupBy("item_id").agg(F.sort_array(F.collect_list(F.struct("term", "weight"))).alias("terms"))
    sets = max(1, -(-queries.count() // search.terms))
    whole = materialized(whole.withColumn("part", F.pmod(F.xxhash64(F.col("item_id").cast("string")), F.lit(sets))), "items")
    index = materialized(impact_index(found, n_docs, n_terms, search), "impact-index")
    hits = None
    for part in range(sets):
        rows = whole.where(F.col("part") == part).select("item_id", "terms").collect()
        own = [(r["item_id"], [t["term"] for t in r["terms"]], [t["weight"] for t in r["terms"]]) for r in rows]
        some = materialized(search_stripes(index, own, search, items.schema[item_col].dataType), "hits")
        hits = some if hits is None else hits.unionByName(some)
    order = [F.col("score").desc(), F.col("doc_id").asc_nulls_last()]
    best = top_per_group(hits.where("score > 0"), ["item_id"], order, search.k, "rank")
    return best.select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
