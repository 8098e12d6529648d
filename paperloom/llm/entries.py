"""Queries of this subpackage, by name, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from paperloom.llm import decontamination, folds, html_tree, language, licenses, mixing, ngram_join, quality, secrets, spelling, spotsigs, token_counts, toxicity, vector_codes
from paperloom.session import read

Query = Callable[[SparkSession, str], DataFrame]


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontamination.contamination(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "items"), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


OP1_SQL = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
i AS (
  SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item, n, array_to_string(w[s:s + n - 1], ' ') AS g
  FROM (SELECT item, w, least(10, len(w)) AS n, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS s FROM i WHERE len(w) > 0)),
grams AS (
  SELECT rid, n, s, array_to_string(w[s:s + n - 1], ' ') AS g
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS s FROM d, (SELECT DISTINCT n FROM win) WHERE len(w) >= n)),
occ AS (SELECT rid, s, n, item FROM grams JOIN win USING (n, g)),
hits AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(s, s + n)) AS p FROM occ) GROUP BY rid),
its AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT rid, item FROM occ) GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hits USING (rid) LEFT JOIN its USING (rid)
"""


def op2_spotsigs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spotsigs.edited(read(spark, sf_dir, "documents"))


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.context_limits(token_counts.lengths(read(spark, sf_dir, "documents")))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(read(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans", "n_random")


def op5_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan(read(spark, sf_dir, "documents"))


def _licenses_sql() -> str:
    """The same scan in DuckDB SQL, from the same fixed values."""

    def quoted(text: str) -> str:
        return "'" + text.replace("'", "''") + "'"

    def lines(column: str) -> str:
        out = f"lower(coalesce({column}, ''))"
        for old, new in licenses.SPELLINGS:
            out = f"replace({out}, {quoted(old)}, {quoted(new)})"
        split = f"string_split(regexp_replace({out}, {quoted(licenses.SYMBOLS)}, ' ', 'g'), chr(10))"
        begins, wrapped, certain = (f"regexp_matches(x, {quoted(r)})" for r in (licenses.STATEMENT, licenses.WRAPPED, licenses.CERTAIN))
        return f"array_to_string(list_filter({split}, lambda x: NOT ({begins} AND (NOT {wrapped} OR {certain}))), chr(10))"

    def canonical(column: str) -> str:
        return f"trim(regexp_replace({column}, '[ ' || chr(10) || ']+', ' ', 'g'))"

    notices = {t for ts in licenses.NOTICES.values() for t in ts}
    rows = ", ".join(f"({quoted(k)}, {quoted(t)}, {t in notices})" for k, t in licenses.whole_texts())
    digests = ", ".join(f"({quoted(k)}, {quoted(d)})" for k, d in licenses.DIGESTS)
    return f"""
WITH raw(license, text, notice) AS (VALUES {rows}),
known AS (SELECT license, notice, {canonical(lines("text"))} AS body FROM raw),
fixed(license, digest) AS (VALUES {digests}),
digests AS (SELECT digest, min(license) AS license FROM (SELECT license, sha256(body) AS digest FROM known UNION ALL SELECT license, digest FROM fixed) GROUP BY digest),
d AS (SELECT row_number() OVER () AS rid, doc_id, {lines("text")} AS lines FROM documents),
hit AS (
  SELECT rid, string_agg(DISTINCT k.license, ',' ORDER BY k.license) AS line_licenses
  FROM (SELECT rid, trim(unnest(string_split(lines, chr(10)))) AS line FROM d) l JOIN known k ON k.notice AND k.body = l.line GROUP BY rid)
SELECT doc_id, sha256({canonical("lines")}) AS digest, k.license, coalesce(line_licenses, '') AS line_licenses
FROM d LEFT JOIN hit USING (rid) LEFT JOIN digests k ON k.digest = sha256({canonical("lines")})
"""


def op6_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    joined = ngram_join.join(read(spark, sf_dir, "documents"))
    return joined.select("doc_id", "class_id", "n_links", "n_shingles")


OP6_SQL = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
g AS (
  SELECT DISTINCT doc_id, array_to_string(w[s:s + 4], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS s FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
e AS (
  SELECT x.a, x.b FROM (
    SELECT p.doc_id AS a, q.doc_id AS b, count(*) AS c FROM g p JOIN g q USING (g) WHERE p.doc_id <> q.doc_id GROUP BY 1, 2) x
  JOIN n na ON na.doc_id = x.a JOIN n nb ON nb.doc_id = x.b
  WHERE 5 * x.c >= 4 * (na.n + nb.n - x.c)),
r AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM r JOIN e ON r.b = e.a),
c AS (SELECT a, min(b) AS least FROM r GROUP BY a),
l AS (SELECT a, count(*) AS n_links FROM e GROUP BY a)
SELECT d.doc_id, least(d.doc_id, coalesce(c.least, d.doc_id)) AS class_id, coalesce(l.n_links, 0) AS n_links, coalesce(n.n, 0) AS n_shingles
FROM d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN c ON c.a = d.doc_id LEFT JOIN l ON l.a = d.doc_id
"""


def op7_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_tree.extract(read(spark, sf_dir, "pages"))


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    machine = quality.learn(docs, read(spark, sf_dir, "labels").where(~folds.held_out()))
    scored = quality.score(docs, machine)
    return scored.select("doc_id", folds.held_out().alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))


def op9_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = language.learn(docs.where(~folds.held_out()))
    found = language.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", folds.held_out().alias("held_out"), "lang_pred", "score", "margin", "rejected")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix(read(spark, sf_dir, "documents"))
    return mixed.select("doc_id", "size", "source_size", "target", "taken", "source", "shards")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(read(spark, sf_dir, "documents"))


OP11_SQL = r"""
WITH RECURSIVE crc(i, v, k) AS (
  SELECT i, i, 0 FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END, k + 1 FROM crc WHERE k < 8),
t AS MATERIALIZED (SELECT list(v ORDER BY i) AS t FROM crc WHERE k = 8),
runs AS MATERIALIZED (
  SELECT id, run, count(*) AS times FROM (
    SELECT coalesce(CAST(doc_id AS VARCHAR), '') AS id,
           unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z\x{C0}-\x{FF}]+')) AS run
    FROM documents)
  WHERE length(run) >= 7 GROUP BY 1, 2),
marked AS MATERIALIZED (
  SELECT run, times, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(string_split(id || ':' || run, ''),
    lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::BIGINT] ELSE [(192 + (unicode(c) >> 6))::BIGINT, (128 + (unicode(c) & 63))::BIGINT] END))),
    lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]))) AS h
  FROM runs, t),
w AS MATERIALIZED (
  SELECT word, CAST(sum(times) AS BIGINT) AS n FROM (
    SELECT CASE WHEN h % 31 = 0 THEN run[1:h % length(run)] || run[h % length(run) + 2:] ELSE run END AS word, times FROM marked)
  WHERE length(word) >= 7 GROUP BY word HAVING sum(times) >= 2),
less AS MATERIALIZED (SELECT word, n, i, word[1:i - 1] || word[i + 1:] AS rest FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
pairs AS (
  SELECT a.word AS a, b.word AS b, b.n FROM less a JOIN less b ON a.rest = b.rest AND a.i = b.i AND a.word <> b.word
  UNION SELECT w.word, l.word, l.n FROM w JOIN less l ON w.word = l.rest
  UNION SELECT l.word, w.word, w.n FROM w JOIN less l ON w.word = l.rest),
best AS (SELECT a, count(*) AS n_near, max(n) AS best_n, arg_min(b, (-n, b)) AS best FROM pairs GROUP BY a),
f AS MATERIALIZED (
  SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN best_n >= 10 * n THEN best END AS form, CASE WHEN best_n >= 10 * n THEN best_n END AS form_n
  FROM w LEFT JOIN best ON a = word),
chain(word, point, step) AS (
  SELECT word, form, 1 FROM f WHERE form IS NOT NULL
  UNION ALL SELECT c.word, f.form, step + 1 FROM chain c JOIN f ON f.word = c.point WHERE f.form IS NOT NULL)
SELECT f.word, form, coalesce(root, f.word) AS root, n, n_near, form_n
FROM f LEFT JOIN (SELECT word, arg_max(point, step) AS root FROM chain GROUP BY word) r ON r.word = f.word
"""


def op12_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    network = toxicity.learn(docs, read(spark, sf_dir, "labels").where(~folds.held_out()))
    scored = toxicity.score(docs, network)
    return scored.select("doc_id", folds.held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op13_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.codes(read(spark, sf_dir, "embeddings")).select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """The rounds of op13 one after another, as DuckDB SQL."""
    distance = "coalesce(list_sum(list_transform(list_zip(p.part, c.entry), lambda z: (z[1] - z[2]) * (z[1] - z[2]))), 0)"
    out = f"""
WITH fine AS (
  SELECT row_number() OVER () AS rid, vec_id, label, embedding AS raw FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
kept AS MATERIALIZED (
  SELECT rid, vec_id, label, raw, list_transform(raw, lambda x: CAST(floor(4096 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM fine WHERE len(raw) = (SELECT len(raw) FROM fine ORDER BY vec_id NULLS LAST, raw LIMIT 1)),
p AS MATERIALIZED (SELECT rid, j, v[len(v) * j // {parts} + 1:len(v) * (j + 1) // {parts}] AS part FROM kept, range({parts}) t(j)),
c0 AS MATERIALIZED (
  SELECT j, e, v[len(v) * j // {parts} + 1:len(v) * (j + 1) // {parts}] AS entry
  FROM (SELECT row_number() OVER (ORDER BY vec_id NULLS LAST) - 1 AS e, v FROM (SELECT vec_id, arg_min(v, raw) AS v FROM kept GROUP BY vec_id)), range({parts}) t(j)
  WHERE e < {entries})"""
    assign = """,
a{r} AS MATERIALIZED (
  SELECT rid, j, min(d)[2] AS e, min(d)[1] AS far, any_value(part) AS part
  FROM (SELECT p.rid, p.j, p.part, [CAST({distance} AS BIGINT), c.e] AS d FROM p JOIN c{r} c ON c.j = p.j) GROUP BY rid, j)"""
    update = """,
m{r} AS (
  SELECT j, e, list((s - ((s % n) + n) % n) // n ORDER BY i) AS entry
  FROM (SELECT j, e, i, sum(part[i])::BIGINT AS s, count(*) AS n FROM (SELECT j, e, part, unnest(range(1, len(part) + 1)) AS i FROM a{b}) GROUP BY j, e, i) GROUP BY j, e),
c{r} AS MATERIALIZED (SELECT c.j, c.e, coalesce(m.entry, c.entry) AS entry FROM c{b} c LEFT JOIN m{r} m ON m.j = c.j AND m.e = c.e)"""
    for r in range(rounds + 1):
        out += (update.format(r=r, b=r - 1) if r else "") + assign.format(r=r, distance=distance)
    return out + f""",
coded AS MATERIALIZED (SELECT rid, string_agg(printf('%02x', e), '' ORDER BY j) AS code, CAST(sum(far) AS BIGINT) AS error FROM a{rounds} GROUP BY rid)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error,
       (SELECT sha256(string_agg(array_to_string(entry, ','), ',' ORDER BY j, e)) FROM c{rounds}) AS codebooks_sha256
FROM kept JOIN coded USING (rid)
"""


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_decontamination, op2_spotsigs, op3_token_counts, op4_secrets, op5_licenses, op6_ngram_join, op7_html, op8_quality, op9_language, op10_mixing, op11_spelling,
        op12_toxicity, op13_vector_codes,
    )
}
ORACLE_SQL: dict[str, str] = {"op1_decontamination": OP1_SQL, "op5_licenses": _licenses_sql(), "op6_ngram_join": OP6_SQL, "op11_spelling": OP11_SQL, "op13_vector_codes": _codes_sql()}
