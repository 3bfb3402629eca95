"""The registered queries of this package, with production parameters, and their SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import collocations, decontam, id_files, langid, maxscore, packing, pii, setjoin, sharding, simhash, toxicity, variants, warc


def tokenizer_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("byte_bpe_50k.json"))


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def op1_maxscore(spark: SparkSession, folder: str) -> DataFrame:
    return maxscore.top_k(maxscore.integer_vectors(table(spark, folder, "embeddings")), F.col("vec_id") % 50 == 0, 5)


def op2_simple8b(spark: SparkSession, folder: str) -> DataFrame:
    return id_files.round_trip(table(spark, folder, "documents"), tokenizer_path())


def op3_warc(spark: SparkSession, folder: str) -> DataFrame:
    return warc.round_trip(table(spark, folder, "pages")).drop("url")


def op4_pii(spark: SparkSession, folder: str) -> DataFrame:
    return pii.report(table(spark, folder, "documents")).drop("top_score")


def op5_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.report(table(spark, folder, "documents"))


def op6_toxicity(spark: SparkSession, folder: str) -> DataFrame:
    return toxicity.report(table(spark, folder, "documents"), table(spark, folder, "labels"))


def op7_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    return decontam.report(table(spark, folder, "documents"), table(spark, folder, "benchmark")).drop("spans")


def op8_langid(spark: SparkSession, folder: str) -> DataFrame:
    return langid.report(table(spark, folder, "documents"))


def op9_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.report(table(spark, folder, "documents"))


def op10_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packing.pack(table(spark, folder, "documents"), tokenizer_path())


def op11_set_relation(spark: SparkSession, folder: str) -> DataFrame:
    return setjoin.report(table(spark, folder, "documents"))


def op12_collocations(spark: SparkSession, folder: str) -> DataFrame:
    return collocations.report(table(spark, folder, "documents"))


def op13_variants(spark: SparkSession, folder: str) -> DataFrame:
    return variants.report(table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_maxscore, op2_simple8b, op3_warc, op4_pii, op5_sharding, op6_toxicity, op7_decontamination, op8_langid, op9_simhash, op10_packing,
        op11_set_relation, op12_collocations, op13_variants,
    )
}

_MAXSCORE = """
WITH v AS (
  SELECT vec_id, [floor(256 * x::DOUBLE) FOR x IN embedding] AS t FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len([x FOR x IN embedding IF x IS NULL OR NOT isfinite(x)]) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.t, c.t)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

_WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (SELECT page_id, strlen(html)::BIGINT AS payload_bytes, sha1(html) AS payload_digest, max(page_id) OVER (PARTITION BY html) AS kept FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes < 1000 OR page_id = kept THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN payload_bytes < 1000 OR page_id = kept THEN NULL ELSE kept END AS refers_to
FROM d
"""

#: The contract's patterns, for an engine without look-around; the last kind is the method's own.
_PII_PATTERNS = (
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+"), ("ip", r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+"), ("card", r"[0-9](?:[\x20-]?[0-9])+"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]"), ("iban", pii.PATTERNS["iban"]),
)
_PII = f"""
WITH k(kind_no, kind, pattern) AS (VALUES {", ".join(f"({i}, '{kind}', '{pattern}')" for i, (kind, pattern) in enumerate(_PII_PATTERNS, 1))}),
d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
w AS (
{" UNION ALL ".join(f"SELECT doc_id, {i} AS kind_no, '{kind}' AS kind, regexp_extract_all(text, '{pattern}') AS words, string_split_regex(text, '{pattern}') AS gaps FROM d" for i, (kind, pattern) in enumerate(_PII_PATTERNS, 1))}
), e AS (
  SELECT doc_id, kind_no, kind, unnest(words) AS word, unnest(gaps[1:len(words)]) AS gap, unnest(range(len(words))) AS i FROM w WHERE len(words) > 0
), s AS (
  SELECT *, sum(length(gap) + length(word)) OVER (PARTITION BY doc_id, kind_no ORDER BY i) AS stop FROM e
), c AS (
  SELECT *, stop - length(word) AS start, regexp_replace(word, '[^0-9]', '', 'g') AS digits, replace(word, ' ', '') AS code FROM s
), g AS (
  SELECT * FROM c WHERE CASE kind
    WHEN 'email' THEN true
    WHEN 'ip' THEN len([x FOR x IN string_split(word, '.') IF length(ltrim(x, '0')) > 3 OR right(x, 3)::INTEGER > 255]) = 0
    WHEN 'phone' THEN length(digits) BETWEEN 10 AND 15
    WHEN 'card' THEN length(digits) BETWEEN 14 AND 19 AND
      list_sum([CASE WHEN x % 2 = 1 THEN substr(digits, length(digits) - x + 1, 1)::INTEGER
        ELSE [0, 2, 4, 6, 8, 1, 3, 5, 7, 9][substr(digits, length(digits) - x + 1, 1)::INTEGER + 1] END FOR x IN range(1, length(digits) + 1)]) % 10 = 0
    ELSE length(code) >= 15 AND list_reduce(list_prepend(0, [CASE WHEN x >= 'A' THEN ascii(x) - 55 ELSE x::INTEGER END FOR x IN string_split(code[5:] || code[:4], '')]),
      lambda a, x: (a * CASE WHEN x > 9 THEN 100 ELSE 10 END + x) % 97) = 1 END
), f AS (
  SELECT doc_id, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone,
    coalesce(string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, kind_no) FILTER (kind_no <= 4), '') AS base,
    string_agg(kind || ':' || start::BIGINT || ':' || stop::BIGINT, ',' ORDER BY start, kind_no) AS spans
  FROM g GROUP BY doc_id
)
SELECT d.doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN f USING (doc_id)
"""

_DECONTAMINATION = r"""
WITH dw AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
iw AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
ip AS (SELECT item_id, w, least(len(w), 13) AS n, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM iw WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS body FROM ip),
lengths AS (SELECT DISTINCT n FROM win),
dp AS (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM dw, lengths WHERE len(w) >= n),
ds AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS body FROM dp),
occ AS (SELECT doc_id, item_id, ds.n, i FROM ds JOIN win USING (n, body)),
hit AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM occ) GROUP BY doc_id),
its AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM occ) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM dw LEFT JOIN hit USING (doc_id) LEFT JOIN its USING (doc_id)
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_SET_RELATION = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
p AS (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM w WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 2], ' ') AS shingle FROM p),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS n FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT o.a, o.b FROM o JOIN n x ON x.doc_id = o.a JOIN n y ON y.doc_id = o.b WHERE 100 * o.n >= 90 * (x.n + y.n - o.n)),
both_ways AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
reach(doc_id, other) AS (SELECT a, b FROM both_ways UNION SELECT r.doc_id, e.b FROM reach r JOIN both_ways e ON r.other = e.a),
c AS (SELECT doc_id, min(other) AS other FROM reach GROUP BY doc_id)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, least(doc_id, coalesce(other, doc_id)) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN c USING (doc_id)
"""

_COLLOCATIONS = rf"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM d),
p AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM w),
g AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase FROM p, range(1, 5) AS r(k) WHERE i + k - 1 <= len(w)),
f AS (SELECT lang, k, phrase, count(*)::HUGEINT AS f FROM g GROUP BY ALL),
total AS (SELECT lang, sum(f)::BIGINT AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, string_split(phrase, ' ') AS w, f FROM f WHERE k >= 2 AND f >= 30),
inside AS (SELECT lang, w, k, f, unnest(range(2, k)) AS m FROM c WHERE k > 2),
shadow AS (SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, max(f) AS longer FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM inside) GROUP BY ALL),
kept AS (SELECT c.* FROM c LEFT JOIN shadow USING (lang, phrase) WHERE longer IS NULL OR 100 * longer < 80 * f),
cuts AS (SELECT *, unnest(range(1, k)) AS cut FROM kept),
scored AS (
  SELECT cuts.lang, cuts.phrase, cuts.f AS a, x.f AS l, y.f AS r, cut, (2000000 * cuts.f) // (x.f + y.f) AS score
  FROM cuts JOIN f x ON x.lang = cuts.lang AND x.phrase = array_to_string(cuts.w[1:cut], ' ') JOIN f y ON y.lang = cuts.lang AND y.phrase = array_to_string(cuts.w[cut + 1:cuts.k], ' ')
), worst AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) = 1),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM worst)
SELECT lang, rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n, score::BIGINT AS score FROM ranked JOIN total USING (lang) WHERE rank <= 2000
"""


def _crc_table() -> list[int]:
    """Of the reflected polynomial that crc32 is defined by."""
    found = []
    for byte in range(256):
        for _ in range(8):
            byte = byte >> 1 ^ (0xEDB88320 if byte & 1 else 0)
        found.append(byte)
    return found


_VARIANTS = rf"""
WITH RECURSIVE d AS (SELECT doc_id, unnest(regexp_extract_all({_LOWER}, '[A-Za-z\x{{C0}}-\x{{FF}}]+')) AS run FROM documents),
t AS (SELECT doc_id, run, count(*) AS n FROM d WHERE length(run) >= 7 GROUP BY ALL),
crc AS (SELECT {_crc_table()}::BIGINT[] AS x),
h AS (
  SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, flatten([CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [195, unicode(c) - 64] END FOR c IN string_split(doc_id || ':' || run, '')])),
    lambda a, b: xor(a >> 8, x[(xor(a, b) & 255) + 1]))) AS h
  FROM t, crc
), e AS (SELECT CASE WHEN h % 31 = 0 THEN run[1:(h % length(run))] || run[(h % length(run)) + 2:] ELSE run END AS word, n FROM h),
v AS (SELECT word, sum(n)::BIGINT AS n FROM e WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
k AS (SELECT word, unnest(range(1, length(word) + 1)) AS i FROM v),
cut AS (SELECT word, i, word[1:i - 1] AS a, word[i + 1:] AS b FROM k),
near AS (
  SELECT x.word, y.word AS other FROM cut x JOIN cut y ON x.a = y.a AND x.b = y.b AND x.word <> y.word
  UNION SELECT cut.word, v.word FROM cut JOIN v ON v.word = a || b
  UNION SELECT v.word, cut.word FROM cut JOIN v ON v.word = a || b
), best AS (
  SELECT near.word, count(*) AS n_near, first(other ORDER BY v.n DESC, other) AS other, max(v.n) AS other_n FROM near JOIN v ON v.word = near.other GROUP BY near.word
), f AS (
  SELECT v.word, v.n, coalesce(n_near, 0) AS n_near, CASE WHEN other_n >= 10 * v.n THEN other END AS form, CASE WHEN other_n >= 10 * v.n THEN other_n END AS form_n FROM v LEFT JOIN best USING (word)
), follow(word, root, step) AS (SELECT word, word, 0 FROM f UNION ALL SELECT follow.word, f.form, step + 1 FROM follow JOIN f ON f.word = follow.root WHERE f.form IS NOT NULL),
roots AS (SELECT word, arg_max(root, step) AS root FROM follow GROUP BY word)
SELECT word, form, root, n, n_near, form_n FROM f JOIN roots USING (word)
"""

ORACLES: dict[str, str] = {
    "op1_maxscore": _MAXSCORE, "op3_warc": _WARC, "op4_pii": _PII, "op7_decontamination": _DECONTAMINATION, "op11_set_relation": _SET_RELATION, "op12_collocations": _COLLOCATIONS,
    "op13_variants": _VARIANTS,
}
