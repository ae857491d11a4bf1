"""Registered queries of this package: each operator over its whole table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusq.llm import byte_bpe, chat_format, exact_dedup, html_extract, line_dedup, merkle, ngram_join, packing, pii, quality
from corpusq.llm import suffix_dedup, topk_search, vector_codes
from corpusq.llm.common import ascii_lower, table

LOWER_KEY = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def vocabulary(name: str) -> str:
    """Place of a public vocabulary file; the operators take any path."""
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"))
    return cleaned.select(
        "doc_id",
        "n_bytes",
        F.aggregate(
            "spans", F.lit(0).cast("long"), lambda total, s: total + s["end"] - s["start"]
        ).alias("n_removed"),
        F.size("spans").cast("long").alias("n_spans"),
        F.sha2("kept", 256).alias("kept_sha256"),
    )


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cleaned = line_dedup.dedup_lines(table(spark, sf_dir, "documents"))
    return cleaned.select(
        "doc_id",
        "line_dedup.n_lines",
        "line_dedup.n_dropped",
        F.sha2("line_dedup.text", 256).alias("kept_sha256"),
    )


OP2_SQL = """
WITH line AS (
  SELECT doc_id, l.line, l.pos,
         translate(trim(l.line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
       LATERAL (SELECT unnest(lines) AS line, generate_subscripts(lines, 1) AS pos) l
), owner AS (
  SELECT key, min(doc_id) AS first FROM line WHERE length(key) >= 10
  GROUP BY key HAVING count(DISTINCT doc_id) >= 2
), judged AS (
  SELECT line.*, first IS NOT NULL AND first <> doc_id AS gone FROM line LEFT JOIN owner USING (key)
)
SELECT doc_id,
       count(*) AS n_lines,
       CAST(count(*) FILTER (gone) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT gone), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""


def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.exact_dedup(table(spark, sf_dir, "documents"))


OP3_SQL = f"""
WITH d AS (SELECT doc_id, sha256({LOWER_KEY}) AS text_sha256 FROM documents)
SELECT doc_id,
       max(doc_id) OVER w AS keep_id,
       count(*) OVER w AS group_size,
       doc_id = max(doc_id) OVER w AS kept,
       text_sha256
FROM d WINDOW w AS (PARTITION BY text_sha256)
"""


def op9_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", probe), (-7, 1, "assistant", probe)], rows.schema)
    chats = chat_format.format_chats(rows.unionByName(extra))
    # What is learned is what the mask covers in the formatted text, read back.
    masked = F.transform("loss_spans", lambda m: F.substring(F.col("formatted"), m["start"].cast("int") + 1, m["length"].cast("int")))
    learned = F.concat_ws("", F.transform(masked, lambda t: chat_format.unescape(t)))
    chats = chats.withColumn(
        "turns",
        F.when(F.col("identical"), F.col("turns")).otherwise(F.raise_error(F.lit("a conversation does not read back identical"))),
    )
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return chats.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.concat_ws("", lines), 256).alias("turns_sha256"),
        F.char_length(learned).cast("long").alias("loss_chars"),
        F.sha2(learned, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )


OP9_SQL = r"""
WITH source AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL
  SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL
  SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
), shown AS (
  SELECT *,
         regexp_matches(text, '\\[01234]') OR contains(text, '###') OR contains(text, '</turn>') OR
         regexp_matches(role, '\\[01234]|###|</turn>|:|\n') AS conflict
  FROM source
), safe AS (
  SELECT *,
         CASE WHEN conflict THEN replace(replace(replace(text, '\', '\0'), '###', '\1'), '</turn>', '\2')
              ELSE text END AS body,
         CASE WHEN conflict THEN replace(replace(replace(replace(replace(role, '\', '\0'), '###', '\1'),
              '</turn>', '\2'), ':', '\3'), chr(10), '\4') ELSE role END AS head
  FROM shown
)
SELECT conv_id,
       count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(4 + length(head) + 2 + length(body) + 8) AS BIGINT) AS formatted_chars
FROM safe GROUP BY conv_id
"""

def op4_html_extract(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    texts = html_extract.extract(pages, html_extract.fit(pages))
    return texts.select("page_id", "url", "text", F.char_length("text").cast("long").alias("n_chars"))


# The markup of the given pages is simple enough for SQL: one article, whose only inline element is <b>.
OP4_SQL = r"""
WITH a AS (
  SELECT page_id, url,
         regexp_extract(coalesce(html, ''), '<article>(.*?)</article>', 1, 's') AS body FROM pages
), t AS (
  SELECT page_id, url, regexp_replace(regexp_replace(body, '</?b>', '', 'g'), '<[^>]*>', ' ', 'g') AS raw FROM a
), d AS (
  SELECT page_id, url,
         trim(regexp_replace(regexp_replace(regexp_replace(
           replace(replace(raw, '&lt;', '<'), '&gt;', '>'), '&quot;', '"', 'g'), '&amp;?', '&', 'g'),
           '[\s]+', ' ', 'g')) AS text FROM t
)
SELECT page_id, url, text, length(text) AS n_chars FROM d
"""


def op5_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return topk_search.top_k(vectors, vectors.where("vec_id % 50 = 0"))


OP5_SQL = """
WITH v AS (
  SELECT vec_id, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS w
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id,
         CAST(list_sum([q.w[i] * c.w[i] FOR i IN range(1, len(q.w) + 1)]) AS BIGINT) AS score
  FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id AND len(q.w) = len(c.w)
), r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank,
         vec_id, score FROM s
)
SELECT * FROM r WHERE rank <= 5
"""


def quality_model(spark: SparkSession, docs: DataFrame, sf_dir: str) -> quality.AdditiveModel:
    return quality.fit(docs, table(spark, sf_dir, "labels"))


def op6_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    score = quality.scorer(quality_model(spark, docs, sf_dir))
    scored = docs.select("doc_id", quality.held_out(F.col("doc_id")).alias("held_out"), score("text").alias("score"))
    return scored.withColumn("predicted", F.when(F.col("score") >= 0.7, 1).otherwise(0))


def op7_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.ngram_join(table(spark, sf_dir, "documents"))


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = vocabulary("byte_bpe_50k.tiktoken")
    encoded = byte_bpe.encode(table(spark, sf_dir, "documents"), path)
    decoded = byte_bpe.decode(encoded, path)
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op10_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    pieces = packing.pack(table(spark, sf_dir, "documents"), vocabulary("word_bpe_49k.json"))
    return pieces.select(
        "doc_id",
        "start",
        "length",
        F.crc32("ids").alias("ids_crc32"),
        "doc_tokens",
        "sequence_id",
        "offset",
    )


def op11_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = pii.find_pii(table(spark, sf_dir, "documents"))

    def listed(spans: str):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    kinds = F.transform("base", lambda s: s["kind"])
    counts = [
        (F.size(kinds) - F.size(F.array_remove(kinds, kind))).cast("long").alias(f"n_{kind}") for kind in pii.KINDS
    ]
    added = (F.size("spans") - F.size("base")).cast("long").alias("n_added")
    return found.select("doc_id", *counts, F.sha2(listed("base"), 256).alias("base_sha256"), listed("spans").alias("spans"), added)


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.compress(table(spark, sf_dir, "embeddings"))[0]


def _op12_sql(parts: int = 16, entries: int = 64, rounds: int = 2) -> str:
    """Vectors of one length that the parts divide, as the given table has them."""
    steps = [f"""
WITH kept AS (
  SELECT vec_id, label, [CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT) FOR x IN embedding] AS w FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), numbered AS (
  SELECT *, row_number() OVER (ORDER BY vec_id NULLS LAST, w) AS n FROM kept
), part AS (
  SELECT n, p, w[p * (len(w) // {parts}) + 1 : (p + 1) * (len(w) // {parts})] AS w
  FROM numbered, (SELECT unnest(range({parts})) AS p)
), book0 AS (
  SELECT p, n - 1 AS e, w FROM part WHERE n <= {entries}
)"""]
    for turn in range(rounds + 1):
        steps.append(f"""near{turn} AS (
  SELECT n, p, arg_min(e, d * {entries} + e) AS e, min(d) AS d
  FROM (SELECT x.n, x.p, b.e, CAST(list_sum([(x.w[i] - b.w[i]) * (x.w[i] - b.w[i]) FOR i IN range(1, len(x.w) + 1)]) AS BIGINT) AS d
        FROM part x JOIN book{turn} b ON x.p = b.p)
  GROUP BY n, p
)""")
        if turn < rounds:
            steps.append(f"""mean{turn} AS (
  SELECT p, e, list(m ORDER BY i) AS w FROM (
    SELECT a.p, a.e, i, CAST(floor(CAST(sum(x.w[i]) AS DOUBLE) / count(*)) AS BIGINT) AS m
    FROM near{turn} a JOIN part x ON a.n = x.n AND a.p = x.p, LATERAL (SELECT unnest(range(1, len(x.w) + 1)) AS i)
    GROUP BY a.p, a.e, i
  ) GROUP BY p, e
), book{turn + 1} AS (
  SELECT b.p, b.e, coalesce(m.w, b.w) AS w FROM book{turn} b LEFT JOIN mean{turn} m ON b.p = m.p AND b.e = m.e
)""")
    return ", ".join(steps) + f""", coded AS (
  SELECT n, string_agg(printf('%02x', e), '' ORDER BY p) AS code, CAST(sum(d) AS BIGINT) AS error
  FROM near{rounds} GROUP BY n
), digest AS (
  SELECT sha256(string_agg(array_to_string(w, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM book{rounds}
)
SELECT vec_id, code, error, CAST(sum(error) OVER (PARTITION BY label) AS BIGINT) AS label_error, codebooks_sha256
FROM coded JOIN numbered USING (n), digest
"""


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    hit = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    found = {"text": F.when(hit, ascii_lower(F.col("text"))).otherwise(F.col("text"))}
    return merkle.manifest(docs, found=found)


def _op13_sql(fanout: int = 8, levels: int = 7) -> str:
    """A tree of ``levels`` per language and for all of them: enough for fanout ** levels documents each."""

    def leaf(text: str) -> str:
        fields = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
        return "sha256(" + " || ".join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in fields) + ")"

    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    # A byte at a time, a bit at a time; decimal digits only.
    crc = """xor(list_reduce(list_concat([4294967295], [CAST(ord(c) AS BIGINT) FOR c IN string_split(CAST(doc_id AS VARCHAR), '')]),
      lambda a, b: list_reduce(list_concat([xor(a, b)], CAST(range(8) AS BIGINT[])),
        lambda x, i: xor(x // 2, 3988292384 * (x % 2)))), 4294967295)"""
    steps = [f"""
WITH leaf AS (
  SELECT doc_id, coalesce('1' || lang, '0') AS k, {leaf("text")} AS leaf,
         {leaf(f"CASE WHEN {crc} % 3 = 0 THEN {lower} ELSE text END")} AS later FROM documents
), placed AS (
  SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id NULLS FIRST, leaf) - 1 AS p, count(*) OVER (PARTITION BY k) AS c FROM leaf
), a0 AS (SELECT k, p, leaf AS h, c FROM placed)"""]

    def tree(name: str) -> None:
        for i in range(levels):
            steps.append(f"""{name}{i + 1} AS (
  SELECT k, p // {fanout} AS p, CASE WHEN min(c) > 1 THEN sha256(string_agg(h, '' ORDER BY p)) ELSE min(h) END AS h,
         (min(c) + {fanout - 1}) // {fanout} AS c FROM {name}{i} GROUP BY k, p // {fanout}
), {name}run{i} AS (
  SELECT k, p // {fanout} AS q, list(h ORDER BY p) AS run FROM {name}{i} GROUP BY k, p // {fanout}
)""")

    def climb(name: str, source: str, out: str) -> str:
        for i in range(levels):
            steps.append(f"""{out}{i + 1} AS (
  SELECT f.* EXCLUDE (x, proof, p, c, before, after), p // {fanout} AS p, (c + {fanout - 1}) // {fanout} AS c,
         CASE WHEN c > 1 THEN sha256(before || x || after) ELSE x END AS x, proof || before || after AS proof
  FROM (SELECT s.*, array_to_string(run[1 : s.p % {fanout}], '') AS before, array_to_string(run[s.p % {fanout} + 2 :], '') AS after
        FROM {source if i == 0 else f"{out}{i}"} s JOIN {name}run{i} r ON s.k = r.k AND s.p // {fanout} = r.q) f
)""")
        return f"{out}{levels}"

    tree("a")
    steps.append(f"""heads AS (
  SELECT k AS lang, '' AS k, h, row_number() OVER (ORDER BY k) - 1 AS p, count(*) OVER () AS c FROM a{levels}
), b0 AS (SELECT k, p, h, c FROM heads)""")
    tree("b")
    steps.append("start AS (SELECT doc_id, k, leaf, p, c, later AS x, '' AS proof FROM placed)")
    low = climb("a", "start", "low")
    steps.append(f"""middle AS (
  SELECT d.doc_id, d.leaf, h.h AS subroot, h.k, h.p, h.c, d.x, d.proof FROM {low} d JOIN heads h ON h.lang = d.k
)""")
    top = climb("b", "middle", "top")
    return ", ".join(steps) + f"""
SELECT doc_id, leaf, subroot, b.h AS root, sha256(proof) AS proof_sha256, x AS folded_root, x = b.h AS verified
FROM {top} d, b{levels} b
"""


OP12_SQL = _op12_sql()
OP13_SQL = _op13_sql()

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_suffix_dedup": op1_suffix_dedup,
    "op2_line_dedup": op2_line_dedup,
    "op4_html_extract": op4_html_extract,
    "op5_topk_search": op5_topk_search,
    "op6_quality_classifier": op6_quality_classifier,
    "op7_ngram_join": op7_ngram_join,
    "op8_byte_bpe": op8_byte_bpe,
    "op10_packing": op10_packing,
    "op3_exact_dedup": op3_exact_dedup,
    "op9_chat_format": op9_chat_format,
    "op11_pii": op11_pii,
    "op12_vector_codes": op12_vector_codes,
    "op13_merkle_manifest": op13_merkle_manifest,
}
ORACLE: dict[str, str] = {
    "op4_html_extract": OP4_SQL,
    "op5_topk_search": OP5_SQL,
    "op2_line_dedup": OP2_SQL,
    "op3_exact_dedup": OP3_SQL,
    "op9_chat_format": OP9_SQL,
    "op12_vector_codes": OP12_SQL,
    "op13_merkle_manifest": OP13_SQL,
}
