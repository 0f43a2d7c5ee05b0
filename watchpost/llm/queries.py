"""Queries of the text operators over the given tables, and the SQL twins that exist."""
from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from . import (decontaminate, exact_dedup, filter_audit, language, licenses, packing, quality, shuffle_shards, simhash, sketches, suffix_dedup, token_files,
               whitening)
from .common import read, words

LOWER = "translate(coalesce({}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = "regexp_extract_all(" + LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    def wrap(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn
    return wrap


@query()
def op3_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrow files of equal-length sequences, read back per document."""
    return token_files.token_output(read(spark, sf_dir, "documents"))


@query("""SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size, doc_id = max(doc_id) OVER g AS kept,
 sha256(coalesce(text, '')) AS text_sha256 FROM documents WINDOW g AS (PARTITION BY coalesce(text, ''))""")
def op4_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of identical texts by Patricia-trie owners; the largest doc_id stays."""
    return exact_dedup.exact_groups(read(spark, sf_dir, "documents"), keep="largest")


@query()
def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pieces of at most 1024 tokens packed by the configuration linear program."""
    return packing.pack(read(spark, sf_dir, "documents"), room=1024)


@query()
def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen shards of equal counts by a two-pass external shuffle."""
    return shuffle_shards.shard_rows(read(spark, sf_dir, "documents"), n_shards=16)


@query(f"""WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {WORDS.format('text')} AS w FROM benchmark),
win AS (SELECT DISTINCT item, least(10, len(w)) AS m, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS k
 FROM (SELECT item, w, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, {WORDS.format('text')} AS w FROM documents), sizes AS (SELECT DISTINCT m FROM win),
pos AS (SELECT doc_id, m, i, array_to_string(w[i:i + m - 1], ' ') AS k FROM (SELECT doc_id, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM d, sizes WHERE len(w) >= m)),
hit AS (SELECT doc_id, i, m, item FROM pos JOIN win USING (m, k)),
cov AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest(range(i, i + m)) AS p FROM (SELECT DISTINCT doc_id, i, m FROM hit)) GROUP BY doc_id),
its AS (SELECT doc_id, count(DISTINCT item) AS n, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM hit GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(cov.n, 0) AS n_hit, coalesce(its.n, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
 coalesce(cov.n, 0) > 0 AS contaminated FROM d LEFT JOIN cov USING (doc_id) LEFT JOIN its USING (doc_id)""")
def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ten-word windows of benchmark items in suffix arrays of the documents."""
    found = decontaminate.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"), n=10)
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def _rows_sql(rows) -> str:
    return ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in row) + ")" for row in rows)


_TOKENS = [(n, label, token) for n, (label, text) in enumerate((k, t) for k, notices in licenses.TEMPLATES.items() for t in notices)
           for token in sorted({w.decode() for w in words(text.encode())})]


@query(f"""WITH d AS (SELECT doc_id, text, {WORDS.format('text')} AS w FROM documents),
ph(phrase, label) AS (VALUES {_rows_sql((p, v) for p, v in licenses.PHRASES.items())}),
pos AS (SELECT doc_id, label, i FROM (SELECT doc_id, label, w, string_split(phrase, ' ') AS p, unnest(range(len(w))) AS i FROM d, ph) WHERE w[i + 1:i + len(p)] = p),
base AS (SELECT doc_id, count(*) AS n, min(i) AS f, max(i) AS l, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM pos GROUP BY doc_id),
tok(n, label, token) AS (VALUES {_rows_sql(_TOKENS)}), size AS (SELECT n, label, count(*) AS size FROM tok GROUP BY n, label),
lines AS (SELECT doc_id, ln, unnest(list_distinct({WORDS.format('line')})) AS token FROM (SELECT doc_id, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) AS ln,
 unnest(string_split(coalesce(text, ''), chr(10))) AS line FROM d)),
share AS (SELECT doc_id, ln, n, tok.label, count(*) / any_value(size) AS share FROM lines JOIN tok USING (token) JOIN size USING (n) GROUP BY doc_id, ln, n, tok.label
 HAVING count(*) >= ceil(0.9 * any_value(size) - 1e-9)),
own AS (SELECT doc_id, max(share) AS share FROM share GROUP BY doc_id),
every AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM pos UNION ALL SELECT doc_id, label FROM share) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(base.n, 0) AS n_base, base.f AS first_word, base.l AS last_word, coalesce(base.labels, '') AS base_labels,
 coalesce(every.labels, '') AS labels, CASE WHEN base.n > 0 THEN 1e0 ELSE coalesce(own.share, 0e0) END AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN own USING (doc_id) LEFT JOIN every USING (doc_id)""")
def op10_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """License phrases, and notices by a set-similarity join with their templates."""
    return licenses.scan(read(spark, sf_dir, "documents"))


@query()
def op5_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by error-correcting output codes."""
    docs = read(spark, sf_dir, "documents")
    return language.identify(docs, language.train(docs))


@query()
def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document by a factorisation machine."""
    docs = read(spark, sf_dir, "documents")
    return quality.score(docs, quality.train(docs, read(spark, sf_dir, "labels")))


@query()
def op2_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of fingerprints within 4 bits, by anchors of covering codes."""
    return simhash.simhash_components(read(spark, sf_dir, "documents"))


@query()
def op7_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes that repeat a smaller document removed, by a merge sort of suffixes."""
    return suffix_dedup.remove_repeats(read(spark, sf_dir, "documents")).drop("kept")


_ORDERS = "SELECT a || b || c || d || e AS filter_order FROM " + ", ".join(f"(SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS {x}) AS o{x}" for x in "abcde") + \
    " WHERE " + " AND ".join(f"{x} <> {y}" for i, x in enumerate("abcde") for y in "abcde"[i + 1:])


@query(rf"""WITH d AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS t FROM documents),
low AS (SELECT t, min(doc_id) AS low FROM d GROUP BY t),
m AS (SELECT doc_id, part, t, low, regexp_extract_all(t, '[^ 	-]+') AS w FROM d JOIN low USING (t)),
lab AS (SELECT doc_id, coalesce(max(CAST(quality = 1 AS INT)), 0) AS good, coalesce(max(CAST(toxic = 1 AS INT)), 0) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT m.doc_id, part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
 CASE WHEN len(w) < 200 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 50 * len(w) THEN 'B' ELSE '' END
 || CASE WHEN 100 * length(regexp_replace(t, '[^A-Z]+', '', 'g')) > 2 * length(t) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(t, '[#$%&*|]') THEN 'D' ELSE '' END
 || CASE WHEN m.doc_id > low THEN 'E' ELSE '' END AS fails FROM m LEFT JOIN lab ON m.doc_id = lab.doc_id),
p AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
o AS (SELECT filter_order, step, filter_order[step] AS filter, filter_order[:step - 1] AS before FROM ({_ORDERS}), (SELECT unnest(range(1, 6)) AS step) AS s),
x AS (SELECT part, filter_order, step, filter, n, good, toxic, contains(fails, filter) AS hit, before <> '' AND translate(fails, before, '') <> fails AS gone,
 fails = filter AS only_this FROM p, o),
r AS (SELECT part, filter_order, step, filter, sum(CASE WHEN NOT gone AND NOT hit THEN n ELSE 0 END) AS kept, sum(CASE WHEN NOT gone AND hit THEN n ELSE 0 END) AS removed,
 sum(CASE WHEN gone AND hit THEN n ELSE 0 END) AS redundant, sum(CASE WHEN only_this THEN n ELSE 0 END) AS unique_fails,
 sum(CASE WHEN NOT gone AND hit THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN NOT gone AND hit THEN toxic ELSE 0 END) AS toxic_lost FROM x GROUP BY part, filter_order, step, filter)
SELECT part, filter_order, CAST(step AS INT) AS step, CAST(kept AS BIGINT) AS kept, CAST(removed AS BIGINT) AS removed, CAST(redundant AS BIGINT) AS redundant,
 CAST(unique_fails AS BIGINT) AS unique_fails, CAST(good_lost AS BIGINT) AS good_lost, CAST(toxic_lost AS BIGINT) AS toxic_lost,
 CAST(sum(removed) OVER (PARTITION BY part, filter) AS BIGINT) AS shapley FROM r""")
def op11_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five filters in all orders, by anti and semi joins of failing ids."""
    return filter_audit.audit(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"))


@query()
def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen whitened components of every vector by Golub-Kahan-Lanczos bidiagonalisation."""
    return whitening.whiten(read(spark, sf_dir, "embeddings"), components=16)


@query()
def op13_sketches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bottom-k sketches of every text and its edited text."""
    return sketches.edited_likeness(read(spark, sf_dir, "documents"))
