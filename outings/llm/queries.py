"""The registered queries of the operators, with their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, oracle: str | None = None):
    def register(build):
        QUERIES[name] = build
        if oracle is not None:
            ORACLES[name] = oracle
        return build

    return register


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def tokenizer(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


@query("op1_vector_approximation_topk", """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS q FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, list_inner_product(a.q, b.q)::BIGINT AS score
      FROM v a JOIN v b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id AND len(a.q) = len(b.q)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, rank::INTEGER AS rank, vec_id, score FROM r WHERE rank <= 5
""")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    from outings.llm.topk import top_k

    return top_k(read(spark, sf_dir, "embeddings"))


@query("op2_token_counts")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    from outings.llm.token_counts import token_counts

    return token_counts(read(spark, sf_dir, "documents"), tokenizer("byte_bpe_50k.json"))


@query("op3_language_id")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    from outings.llm.language import fit, predict

    docs = read(spark, sf_dir, "documents")
    return predict(docs, fit(docs))


@query("op4_lsh_forest")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    from outings.llm.near_dups import near_duplicates

    return near_duplicates(read(spark, sf_dir, "documents"))


@query("op5_fuzzy_lines")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    from outings.llm.lines import dedup_report

    return dedup_report(read(spark, sf_dir, "documents"))


@query("op6_rule_ledger", r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS words,
             list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM d),
g AS (SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram
      FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w WHERE len(words) >= 3)),
twice AS (SELECT doc_id, gram FROM g GROUP BY doc_id, gram HAVING count(*) > 1),
covered AS (SELECT doc_id, count(DISTINCT i + o) AS n
            FROM (SELECT g.doc_id, g.i, unnest([0, 1, 2]) AS o FROM g JOIN twice USING (doc_id, gram)) GROUP BY doc_id),
m AS (SELECT doc_id, len(words)::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
             length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g'))::BIGINT AS n_symbols,
             (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
             coalesce((SELECT n FROM covered c WHERE c.doc_id = w.doc_id), 0)::BIGINT AS n_repeat_words,
             len(lines)::BIGINT AS n_lines,
             regexp_matches(text, '\p{L}') AS has_letter, len(regexp_extract_all(text, '\p{Lu}{2,}')) AS n_capital_runs,
             length(regexp_replace(text, '[^|]+', '', 'g')) AS n_bars FROM w),
b AS (SELECT *, (n_words < 50)::BIGINT + 2 * (100 * n_repeat_words > 50 * n_words)::BIGINT
             + 4 * (20 * n_symbols > n_words)::BIGINT + 8 * (10 * n_dup_lines > 3 * n_lines)::BIGINT
             + 16 * (word_chars < 2 * n_words OR word_chars > 14 * n_words)::BIGINT + 32 * (NOT has_letter)::BIGINT
             + 64 * (2 * n_capital_runs > n_words)::BIGINT + 128 * (5 * n_bars > n_words)::BIGINT AS rule_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, rule_bits & 3 <> 0 AS base_failed,
       rule_bits & 231 = 0 AND bit_count(rule_bits & 24) <= 1 AS kept, rule_bits & 39 = 0 AS kept_v1, rule_bits FROM b
""")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    from outings.llm.rules import rule_rows

    return rule_rows(read(spark, sf_dir, "documents"))


@query("op7_vector_packing")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    from outings.llm.packing import pack_documents

    return pack_documents(read(spark, sf_dir, "documents"), tokenizer("word_bpe_49k.json"))


@query("op8_piece_digests")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    from outings.llm.pieces import piece_digests

    return piece_digests(read(spark, sf_dir, "documents"), tokenizer("piece_bpe_32k.model"))


@query("op9_ordinal_quality")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    from outings.llm.quality import fit, grade_documents, graded

    docs = read(spark, sf_dir, "documents")
    return grade_documents(docs, fit(docs, graded(read(spark, sf_dir, "labels"))))


@query("op10_feistel_shards")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    from outings.llm.shards import shard_rows

    return shard_rows(read(spark, sf_dir, "documents"))


LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


@query("op11_phrase_collocations", rf"""
WITH p AS (SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array({LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS words FROM p),
g AS (SELECT lang, s, array_to_string(words[i:i + s - 1], ' ') AS phrase
      FROM (SELECT lang, words, s, unnest(range(1, len(words) - s + 2)) AS i FROM w, (VALUES (1), (2), (3)) AS t(s))),
f AS (SELECT lang, s, phrase, count(*) AS f FROM g GROUP BY ALL),
n AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE s = 1 GROUP BY lang),
c AS (SELECT lang, s, phrase, f AS a, string_split(phrase, ' ') AS words FROM f WHERE s > 1 AND f >= 10),
inner_parts AS (SELECT DISTINCT lang, array_to_string(words[i:i + 1], ' ') AS phrase, max(a) OVER (PARTITION BY lang, array_to_string(words[i:i + 1], ' ')) AS longer
                FROM (SELECT lang, words, a, unnest([1, 2]) AS i FROM c WHERE s = 3)),
cuts AS (SELECT c.lang, c.phrase, c.a, k, array_to_string(words[1:k], ' ') AS x, array_to_string(words[k + 1:], ' ') AS y
         FROM (SELECT *, unnest(range(1, s)) AS k FROM c) c),
sc AS (SELECT cuts.lang, cuts.phrase, a, k, fl.f AS l, fr.f AS r,
              ((1000000::HUGEINT * a * a) // (fl.f::HUGEINT * fr.f))::BIGINT AS score
       FROM cuts JOIN f fl ON fl.lang = cuts.lang AND fl.phrase = x JOIN f fr ON fr.lang = cuts.lang AND fr.phrase = y),
best AS (SELECT * FROM sc QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
kept AS (SELECT best.* FROM best LEFT JOIN inner_parts USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 50 * a)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score
FROM kept JOIN n USING (lang) QUALIFY rank <= 2000
""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    from outings.llm.collocations import collocations

    return collocations(read(spark, sf_dir, "documents"))


TERMS = rf"regexp_extract_all({LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"


@query("op12_ranked_search", rf"""
WITH q AS (SELECT item_id, term, count(*) AS times FROM (SELECT item_id, unnest({TERMS}) AS term FROM benchmark) GROUP BY ALL),
d AS (SELECT doc_id, row_number() OVER () AS row, {TERMS} AS terms FROM documents),
s AS (SELECT count_if(len(terms) > 0) AS docs, sum(len(terms))::BIGINT AS words FROM d),
m AS (SELECT doc_id, row, terms, 100 - 25 + ((25 * len(terms) * docs) // words) AS m FROM d, s),
p AS (SELECT row, doc_id, m, term, count(*) AS tf FROM (SELECT row, doc_id, m, unnest(terms) AS term FROM m) GROUP BY ALL),
w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2) / (2 * count(*) + 1)))::BIGINT AS w FROM p, s GROUP BY term),
h AS (SELECT item_id, row, doc_id, sum(times * w * ((1000000000 * tf) // (1000 * tf + 12 * m)))::BIGINT AS score
      FROM q JOIN w USING (term) JOIN p USING (term) GROUP BY ALL)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INTEGER AS rank, doc_id, score
FROM h WHERE score > 0 QUALIFY rank <= 20
""")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    from outings.llm.ranked_search import ranked

    return ranked(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))


@query("op13_source_mix")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    from outings.llm.mixing import mixed

    return mixed(read(spark, sf_dir, "documents"))
