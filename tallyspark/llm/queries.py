"""The registered queries of the operators: NAME -> (function, oracle SQL or None)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import bpe, collocations, ctph, gru, langid, leaks, lines, nra, secrets, simhash, spellings, substrings, urls


def documents(spark: SparkSession, sf: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/documents.parquet")


def op1_substring_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return substrings.digests(documents(spark, sf))


SUBSTRING_SQL = r"""
WITH w AS (SELECT doc_id, coalesce(regexp_extract_all(text, '[^\x20\x09-\x0D]+'), []) AS ws FROM documents),
win AS (SELECT doc_id, i, sha256(array_to_string(ws[i:i + 49], ' ')) AS s
        FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 48)) AS i FROM w)),
least AS (SELECT s, min(doc_id) AS low FROM win GROUP BY s),
hit AS (SELECT doc_id, i FROM win JOIN least USING (s) WHERE low < doc_id),
gone AS (SELECT doc_id, list(DISTINCT p) AS ps FROM (SELECT doc_id, unnest(range(i, i + 50)) AS p FROM hit) GROUP BY doc_id),
kept AS (SELECT doc_id, len(ws) AS n_words, CASE WHEN ps IS NULL THEN ws ELSE list_filter(
             list_transform(range(1, len(ws) + 1), lambda x: CASE WHEN list_contains(ps, x) THEN NULL ELSE ws[x] END),
             lambda y: y IS NOT NULL) END AS ks FROM w LEFT JOIN gone USING (doc_id))
SELECT doc_id, n_words, n_words - len(ks) AS n_removed, sha256(coalesce(array_to_string(ks, ' '), '')) AS kept_sha256 FROM kept
"""


def op7_simhash_near_dedup(spark: SparkSession, sf: str) -> DataFrame:
    return simhash.near_duplicates(documents(spark, sf))


def op9_decontamination(spark: SparkSession, sf: str) -> DataFrame:
    return leaks.find(documents(spark, sf), spark.read.parquet(f"{sf}/benchmark.parquet"))


def vocabulary_path(name: str = "word_bpe_49k.json") -> str:
    """Where the public vocabulary files lie; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op8_bpe(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.digests(documents(spark, sf), vocabulary_path())


def op2_line_dedup(spark: SparkSession, sf: str) -> DataFrame:
    kept = lines.deduplicate(documents(spark, sf))
    return kept.select("doc_id", "n_lines", "n_removed", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op3_secret_scan(spark: SparkSession, sf: str) -> DataFrame:
    return secrets.scan(documents(spark, sf))


def op4_url_filter(spark: SparkSession, sf: str) -> DataFrame:
    return urls.judge(spark.read.parquet(f"{sf}/pages.parquet"))


def op6_exact_top_k(spark: SparkSession, sf: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf}/embeddings.parquet").select("vec_id", nra.whole("embedding").alias("v"))
    return nra.top_k(vectors, F.col("vec_id") % 20 == 0)


TOP_K_SQL = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(64 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = len(embedding)),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)),
r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 20
"""


def held_out(modulus: int, remainder: int, key: str = "doc_id") -> Column:
    """Whether crc32 of the key's text leaves the remainder; a null key counts as held out."""
    return F.coalesce(F.crc32(F.col(key).cast("string").cast("binary")) % modulus == remainder, F.lit(True))


def op5_language_id(spark: SparkSession, sf: str) -> DataFrame:
    docs = documents(spark, sf).withColumn("held_out", held_out(5, 0))
    return langid.predict(docs, langid.train(docs, ~F.col("held_out")), extra=("held_out",))


def op10_lm_scoring(spark: SparkSession, sf: str) -> DataFrame:
    return gru.score(documents(spark, sf), held_out(7, 2))


def op11_document_fingerprints(spark: SparkSession, sf: str) -> DataFrame:
    """Fingerprints of all documents, of their edited texts and how alike they are."""
    return ctph.compare_with_edits(documents(spark, sf))


def op12_spelling_variants(spark: SparkSession, sf: str) -> DataFrame:
    """Words of all documents, their near words, forms and roots."""
    return spellings.group_variants(documents(spark, sf))


# the checksum goes over hexadecimal digits with the table of CRC-32 for four bits; letters beyond ASCII stand for one byte each
# in the edit distance
SPELLING_SQL = r"""
WITH RECURSIVE runs AS (SELECT doc_id, translate(run, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS w, count(*) AS c
    FROM (SELECT doc_id, unnest(regexp_extract_all(text, '[A-Za-zÀ-ÿ]+')) AS run FROM documents) WHERE length(run) >= 7 GROUP BY ALL),
digits AS (SELECT *, hex(encode(concat(doc_id, ':', w))) AS d FROM runs),
sums AS (SELECT w, c, xor(4294967295, list_reduce(list_prepend(4294967295, list_transform(range(0, length(d)), lambda i:
    CAST(strpos('0123456789ABCDEF', substr(d, i + CASE WHEN i % 2 = 0 THEN 2 ELSE 0 END, 1)) - 1 AS BIGINT))),
    lambda a, x: xor(a >> 4, [0, 498536548, 997073096, 651767980, 1994146192, 1802195444, 1303535960, 1342533948,
        3988292384, 4027552580, 3604390888, 3412177804, 2607071920, 2262029012, 2685067896, 3183342108][xor(a, x) % 16 + 1]))) AS h FROM digits),
words AS (SELECT word, CAST(sum(c) AS BIGINT) AS n FROM (SELECT CASE WHEN h % 31 = 0 THEN
    concat(substr(w, 1, h % length(w)), substr(w, h % length(w) + 2)) ELSE w END AS word, c FROM sums) WHERE length(word) >= 7 GROUP BY word HAVING sum(c) >= 2),
keys AS (SELECT word, n, unnest(list_distinct(list_prepend(word, list_transform(range(1, length(word) + 1), lambda i: concat(substr(word, 1, i - 1), substr(word, i + 1)))))) AS k FROM words),
pairs AS (SELECT DISTINCT a.word, b.word AS other, b.n AS other_n FROM keys a JOIN keys b ON a.k = b.k AND a.word <> b.word),
near AS (SELECT * FROM pairs WHERE levenshtein(translate(word, :OTHER, :BYTES), translate(other, :OTHER, :BYTES)) = 1),
best AS (SELECT word, count(*) AS n_near, max(other_n) AS best_n, arg_min(other, (-other_n, other)) AS best FROM near GROUP BY word),
formed AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 10 * n THEN best END AS form, CASE WHEN best_n >= 10 * n THEN best_n END AS form_n
    FROM words LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS at FROM formed UNION ALL SELECT chain.word, formed.form FROM chain JOIN formed ON chain.at = formed.word WHERE formed.form IS NOT NULL)
SELECT f.word, f.form, chain.at AS root, f.n, f.n_near, f.form_n FROM formed f JOIN chain ON chain.word = f.word
JOIN formed g ON g.word = chain.at WHERE g.form IS NULL
""".replace(":OTHER", "'" + "".join(map(chr, range(192, 256))) + "'").replace(
    ":BYTES", "'" + "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789!#$%&()*+,-./:;<=>?@[]^_`{|}" + "'")


def op13_phrase_collocations(spark: SparkSession, sf: str) -> DataFrame:
    """The best phrases of two to four words of each language."""
    return collocations.mine(documents(spark, sf))


PHRASE_SQL = r"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]')) AS piece FROM documents WHERE text IS NOT NULL),
words AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
totals AS (SELECT lang, CAST(sum(len(w)) AS BIGINT) AS n FROM words GROUP BY lang),
grams AS (SELECT lang, k, w[i:i + k - 1] AS p FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, (SELECT unnest([1, 2, 3, 4]) AS k) WHERE len(w) >= k)),
f AS (SELECT lang, k, p, count(*) AS a FROM grams GROUP BY ALL HAVING count(*) >= 30),
inner_ AS (SELECT lang, p[i:i + m - 1] AS p, max(a) AS longer FROM (SELECT lang, p, a, m, unnest(range(1, k - m + 2)) AS i FROM f, (SELECT unnest([2, 3]) AS m) WHERE k > m) GROUP BY ALL),
open_ AS (SELECT f.* FROM f LEFT JOIN inner_ USING (lang, p) WHERE k > 1 AND (longer IS NULL OR CAST(100 AS HUGEINT) * longer < CAST(80 AS HUGEINT) * a)),
cuts AS (SELECT lang, p, a, k, unnest(range(1, k)) AS c FROM open_),
scored AS (SELECT cuts.lang, cuts.p, cuts.a, c, h.a AS l, t.a AS r, CAST(CAST(2000000 AS HUGEINT) * cuts.a // (CAST(h.a AS HUGEINT) + t.a) AS BIGINT) AS score
    FROM cuts JOIN f h ON h.lang = cuts.lang AND h.p = cuts.p[1:c] JOIN f t ON t.lang = cuts.lang AND t.p = cuts.p[c + 1:cuts.k]),
lowest AS (SELECT *, array_to_string(p, ' ') AS phrase FROM scored QUALIFY row_number() OVER (PARTITION BY lang, p ORDER BY score, c) = 1)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM lowest JOIN totals USING (lang)
QUALIFY row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) <= 2000
"""


QUERIES = {
    "op1_substring_dedup": (op1_substring_dedup, SUBSTRING_SQL),
    "op2_line_dedup": (op2_line_dedup, None),
    "op3_secret_scan": (op3_secret_scan, None),
    "op4_url_filter": (op4_url_filter, None),
    "op6_exact_top_k": (op6_exact_top_k, TOP_K_SQL),
    "op5_language_id": (op5_language_id, None),
    "op7_simhash_near_dedup": (op7_simhash_near_dedup, None),
    "op8_bpe": (op8_bpe, None),
    "op9_decontamination": (op9_decontamination, None),
    "op10_lm_scoring": (op10_lm_scoring, None),
    "op11_document_fingerprints": (op11_document_fingerprints, None),
    "op12_spelling_variants": (op12_spelling_variants, SPELLING_SQL),
    "op13_phrase_collocations": (op13_phrase_collocations, PHRASE_SQL),
}
