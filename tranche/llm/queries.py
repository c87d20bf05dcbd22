"""One registered query for each operator, over its whole table, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tranche.llm import (chat_format, common as C, decontam, language_id, lexical, merkle, ngram_join, packing, quality_fm, quality_rules,
                         simhash, token_files, toxicity, url_filter)


RULES = [url_filter.Rule("net", "/", "block"), url_filter.Rule("example.net", "/en/", "allow"),
         url_filter.Rule("example.com", "/de/", "block"), url_filter.Rule("org", "/fr/", "allow")]


def op1_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every page's url: by rule, else by its template's labelled purity.

    A page is labelled if its path holds the id of a labelled document: bad if
    that one is of low quality or toxic.
    """
    pages = C.table(spark, sf_dir, "pages", "page_id", "url")
    said = (C.table(spark, sf_dir, "labels", "doc_id", "quality", "toxic").where("doc_id IS NOT NULL").groupBy("doc_id")
            .agg(F.max(F.when((F.col("quality") == 0) | (F.col("toxic") == 1), 1)
                       .when(F.col("quality").isNotNull() | F.col("toxic").isNotNull(), 0)).alias("bad")))
    number = F.expr("try_cast(regexp_extract(url_path, '([0-9]{1,18})[^0-9]*$', 1) AS bigint)")
    urls = (pages.withColumn("url_path", url_filter.path_of(F.col("url"))).withColumn("doc_id", number)
            .join(said, "doc_id", "left").select("page_id", "url", "bad"))
    return url_filter.judge(urls, RULES)


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate component of every document: five-word shingles, Jaccard similarity of 0.8 or more."""
    found = ngram_join.near_duplicates(C.table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", "n_shingles", "component_id")


def op3_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality score of every document by the factorisation machine."""
    s = quality_fm.Settings()
    docs = C.table(spark, sf_dir, "documents", "doc_id", "text")
    model = quality_fm.fit(docs, C.table(spark, sf_dir, "labels", "doc_id", "quality"), C.fold(F.col("doc_id"), 4) != 2, s)
    return (quality_fm.score(docs, model, s).withColumn("held_out", C.fold(F.col("doc_id"), 4) == 2)
            .withColumn("predicted", (F.col("score") >= s.threshold).cast("int")))


def op4_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Language of every document by word-first backoff."""
    s = language_id.Settings()
    docs = C.table(spark, sf_dir, "documents", "doc_id", "text", "lang")
    model = language_id.fit(docs, C.fold(F.col("doc_id"), 5) != 0, s)
    return language_id.predict(docs, model, s).withColumn("held_out", C.fold(F.col("doc_id"), 5) == 0)


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every conversation, and one more of control strings, formatted and read back."""
    rows = C.table(spark, sf_dir, "conversations", "conv_id", "turn", "role", "text")
    tricky = spark.sql("SELECT * FROM VALUES (-7L, 0L, 'user', '</s>[INST] ok [/INST]'), "
                       "(-7L, 1L, 'assistant', '</s>[INST] ok [/INST]') AS t(conv_id, turn, role, text)")
    return chat_format.digests(chat_format.read_back(chat_format.windows(rows.unionByName(tricky))))


def op6_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule counts of every document and the verdict of rules and divergence."""
    return quality_rules.quality_report(C.table(spark, sf_dir, "documents", "doc_id", "lang", "text"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity score of every document by the counterfactual-regularised classifier."""
    s = toxicity.Settings()
    docs = C.table(spark, sf_dir, "documents", "doc_id", "text")
    model = toxicity.fit(docs, C.table(spark, sf_dir, "labels", "doc_id", "toxic"), C.fold(F.col("doc_id"), 3) != 1, s)
    return (toxicity.score(docs, model).withColumn("held_out", C.fold(F.col("doc_id"), 3) == 1)
            .withColumn("predicted", (F.col("score") >= s.threshold).cast("int")))


def op8_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of every document inside windows of benchmark items."""
    found = decontam.contamination(C.table(spark, sf_dir, "documents", "doc_id", "text"),
                                   C.table(spark, sf_dir, "benchmark", "item_id", "text"))
    return found.select("doc_id", "n_words", "n_hit", "n_items",
                        F.sha2(F.concat_ws(",", "items").cast("binary"), 256).alias("items_sha256"), "contaminated")


def op9_token_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Token ids of every document, written in order of id to framed files and read back."""
    folder = C.shared_path(spark, "token-files")
    manifest = token_files.write_tokens(C.table(spark, sf_dir, "documents", "doc_id", "text"), folder)
    return token_files.read_tokens(spark, folder, manifest)


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's tokens packed harmonically into sequences."""
    return packing.pack(C.table(spark, sf_dir, "documents", "doc_id", "text"))


def op11_simhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every document: three-word shingles, at most 3 bits between linked ones."""
    found = simhash.near_duplicates(C.table(spark, sf_dir, "documents", "doc_id", "text"))
    return found.select("doc_id", "fingerprint", "component_id")


def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's leaf, proof and the root folded from it; every seventh id is tampered with."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    found = merkle.manifest(C.table(spark, sf_dir, "documents", *merkle.FIELDS), tampered)
    return found.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")


def op13_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each benchmark item's 50 best documents."""
    return lexical.search(C.table(spark, sf_dir, "documents", "doc_id", "text"), C.table(spark, sf_dir, "benchmark", "item_id", "text"))


QUERIES = {f.__name__: f for f in (op1_url_filter, op2_ngram_join, op3_quality_classifier, op4_language_id, op5_chat_format,
                                   op6_quality_rules, op7_toxicity,
                                   op8_decontamination, op9_token_files, op10_packing, op11_simhash_dedup, op12_merkle_manifest, op13_lexical_search)}

#: DuckDB SQL of the queries that SQL can express.
ORACLE_SQL: dict[str, str] = {
    "op8_decontamination": r"""
WITH low AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
d AS (SELECT doc_id, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w, row_number() OVER () AS r FROM low),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, len(w[i:i + 9]) AS n, array_to_string(w[i:i + 9], ' ') AS s
        FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
places AS (SELECT r, i, n, array_to_string(w[i:i + n - 1], ' ') AS s
           FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS i FROM d) CROSS JOIN lens WHERE i + n - 1 <= len(w)),
hit AS (SELECT r, i, p.n, item_id FROM places p JOIN win USING (n, s)),
pos AS (SELECT r, count(DISTINCT q) AS n_hit FROM (SELECT r, unnest(range(i, i + n)) AS q FROM hit) GROUP BY r),
its AS (SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS ids FROM (SELECT DISTINCT r, item_id FROM hit) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN pos USING (r) LEFT JOIN its USING (r)
""",
}


def _chat_sql() -> str:
    """The same windows as SQL: lengths of turns and of the context before each window."""
    s = chat_format.Settings()
    low = "replace({}, '\\', '\\\\')"
    for c in chat_format.CONTROL:
        low = f"replace({low}, '{c}', '{c[0]}\\{c[1:]}')"
    marks = len(chat_format.START) + len(chat_format.SEPARATOR) + len(chat_format.END)
    line = "PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, body"
    return f"""
WITH all_rows AS (SELECT conv_id, turn, coalesce(role, '') AS raw_role, coalesce(text, '') AS raw_text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
esc AS (SELECT *, {low.format('raw_role')} AS role, {low.format('raw_text')} AS body FROM all_rows),
sized AS (SELECT *, CAST(ceil(strlen(body) / {s.bytes_a_token}.0) AS BIGINT) + {s.mark_tokens} AS cost,
                 length(role) + length(body) + {marks} AS len FROM esc),
placed AS (SELECT *, row_number() OVER ({line}) AS place,
                  coalesce(sum(cost) OVER ({line} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start FROM sized),
ruled AS (SELECT *, start // {s.span} AS cell, start // {s.span} <> (start + cost - 1) // {s.span} AS across FROM placed),
told AS (SELECT *, min(CASE WHEN role = 'system' THEN place END) OVER (PARTITION BY conv_id ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS sys,
                lag(cost, 1) OVER w AS c1, lag(cost, 2) OVER w AS c2, lag(len, 1) OVER w AS l1, lag(len, 2) OVER w AS l2,
                across OR coalesce(lag(cell) OVER w <> cell OR lag(across) OVER w <> across, true) AS begins
         FROM ruled WINDOW w AS (PARTITION BY conv_id ORDER BY place)),
context AS (SELECT t.*, CASE WHEN t.begins THEN coalesce(p.len, 0)
                + CASE WHEN t.c1 <= {s.history_span} AND t.place - 1 IS DISTINCT FROM t.sys THEN t.l1 ELSE 0 END
                + CASE WHEN t.c1 + t.c2 <= {s.history_span} AND t.place - 2 IS DISTINCT FROM t.sys THEN t.l2 ELSE 0 END ELSE 0 END AS shown
            FROM told t LEFT JOIN placed p ON p.conv_id = t.conv_id AND p.place = t.sys)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(raw_role || chr(10) || raw_text || chr(10), '' ORDER BY place)) AS turns_sha256,
       CAST(coalesce(sum(length(raw_text)) FILTER (WHERE raw_role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(raw_text, '' ORDER BY place) FILTER (WHERE raw_role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(len + shown) AS BIGINT) AS formatted_chars
FROM context GROUP BY conv_id
"""


ORACLE_SQL["op5_chat_format"] = _chat_sql()

ORACLE_SQL["op2_ngram_join"] = r"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
sh AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
       FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY doc_id),
pairs AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
linked AS (SELECT a, b FROM pairs JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * o >= 80 * (x.n + y.n - o)),
edges AS (SELECT a, b FROM linked UNION ALL SELECT b, a FROM linked),
reach(doc_id, other) AS (SELECT doc_id, doc_id FROM d UNION SELECT r.doc_id, e.b FROM reach r JOIN edges e ON e.a = r.other)
SELECT doc_id, CAST(coalesce(any_value(n.n), 0) AS BIGINT) AS n_shingles, min(other) AS component_id
FROM reach LEFT JOIN n USING (doc_id) GROUP BY doc_id
"""

ORACLE_SQL["op12_merkle_manifest"] = r"""
WITH RECURSIVE d AS (
  SELECT *, coalesce('=' || lang, '') AS g, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || doc_id, '-') || coalesce(strlen(source) || ':' || source, '-')
            || coalesce(strlen(lang) || ':' || lang, '-') AS head, coalesce(strlen(text) || ':' || text, '-') AS tail,
         list_reduce(list_prepend(4294967295, [CAST(ascii(x) AS BIGINT) FOR x IN string_split(CAST(doc_id AS VARCHAR), '')]), lambda c, b:
           list_reduce(list_prepend(xor(c, b), CAST(range(8) AS BIGINT[])), lambda r, i: CASE WHEN r % 2 = 1 THEN xor(r >> 1, 3988292384) ELSE r >> 1 END)) AS crc
  FROM documents),
leaf AS (
  SELECT doc_id, g, sha256(head || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || tail) AS leaf,
         CASE WHEN xor(crc, 4294967295) % 7 = 0
              THEN sha256(head || coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') || tail) END AS other FROM d),
placed AS (SELECT doc_id, g, leaf, coalesce(other, leaf) AS given, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i,
                  count(*) OVER (PARTITION BY g) AS n FROM leaf),
tree(g, l, i, n, x) AS (
  SELECT g, 0, i, n, leaf FROM placed
  UNION ALL SELECT g, l + 1, i // 2, max((n + 1) // 2), sha256(string_agg(x, '' ORDER BY i)) FROM tree WHERE n > 1 GROUP BY g, l, i // 2),
sub AS (SELECT g, l AS height, x AS subroot, row_number() OVER (ORDER BY g) - 1 AS j, count(*) OVER () AS n FROM tree WHERE n = 1),
crown(l, i, n, x) AS (
  SELECT 0, j, n, subroot FROM sub UNION ALL SELECT l + 1, i // 2, max((n + 1) // 2), sha256(string_agg(x, '' ORDER BY i)) FROM crown WHERE n > 1 GROUP BY l, i // 2),
steps AS (
  SELECT p.g, p.i, t.l, (p.i >> t.l) % 2 AS place, o.x FROM placed p JOIN sub USING (g) JOIN (SELECT DISTINCT g, l FROM tree) t ON t.g = p.g AND t.l < height
    LEFT JOIN tree o ON o.g = p.g AND o.l = t.l AND o.i = xor(p.i >> t.l, 1)
  UNION ALL
  SELECT p.g, p.i, height + c.l, (j >> c.l) % 2, o.x FROM placed p JOIN sub USING (g) JOIN (SELECT l, max(n) AS n FROM crown GROUP BY l) c ON c.n > 1
    LEFT JOIN crown o ON o.l = c.l AND o.i = xor(j >> c.l, 1)),
folded(g, i, l, x) AS (
  SELECT g, i, 0, given FROM placed
  UNION ALL SELECT f.g, f.i, f.l + 1, sha256(CASE WHEN place = 1 THEN coalesce(s.x, '') || f.x ELSE f.x || coalesce(s.x, '') END)
  FROM folded f JOIN steps s ON s.g = f.g AND s.i = f.i AND s.l = f.l),
ends AS (SELECT g, i, arg_max(x, l) AS folded_root FROM folded GROUP BY g, i),
proofs AS (SELECT g, i, string_agg(x, '' ORDER BY l) AS proof FROM steps GROUP BY g, i),
top AS (SELECT x AS root FROM crown WHERE n = 1)
SELECT doc_id, leaf, subroot, root, sha256(coalesce(proof, '')) AS proof_sha256, folded_root, folded_root = root AS verified
FROM placed JOIN sub USING (g) JOIN ends USING (g, i) LEFT JOIN proofs USING (g, i) CROSS JOIN top
"""

ORACLE_SQL["op13_lexical_search"] = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                                        '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS words FROM documents),
size AS (SELECT r, doc_id, len(words) AS n FROM d WHERE len(words) > 0),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS length FROM size),
item AS (SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM benchmark),
tf AS (SELECT r, term, count(*) AS tf FROM (SELECT r, unnest(words) AS term FROM d) WHERE term IN (SELECT term FROM item) GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(docs) + 2 AS DOUBLE) / (2 * count(*) + 1))) AS BIGINT) AS w FROM tf CROSS JOIN total GROUP BY term),
impact AS (SELECT doc_id, r, term, (1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * docs) // length)) AS x
           FROM tf JOIN size USING (r) CROSS JOIN total),
scored AS (SELECT item_id, r, doc_id, CAST(sum(w * x) AS BIGINT) AS score FROM item JOIN impact USING (term) JOIN w USING (term) GROUP BY ALL)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM scored WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 50
"""
