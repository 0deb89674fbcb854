"""The registered queries of this subpackage and, where SQL can say it, their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tableops.llm import (
    archives,
    decontam,
    fim,
    langid,
    pieces,
    pii,
    quality,
    repeats,
    resampling,
    rules,
    secrets,
    simhash,
    tokens,
)
from tableops.llm.base import fold, fresh_folder, staged, table


def op1_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of every document; a source owns its documents, a language of it is a repository."""
    found = secrets.scan(
        table(spark, sf_dir, "documents"),
        "doc_id",
        owner=F.col("source"),
        repository=F.concat_ws("/", "source", "lang"),
    )
    return found.select(
        "doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"),
        "spans", "n_bare", "n_live", "n_example", "most_held",
    )


def _op1_sql() -> str:
    parts = []
    for n, k in enumerate(secrets.KINDS):
        pattern = k.pattern.replace("'", "''")
        value = f"regexp_extract(m, '{pattern}', {k.group})" if k.group else "m"
        fits = "".join(f" AND regexp_matches(v, '{x}')" for x in k.also)
        parts.append(f"""
SELECT * FROM (
  SELECT doc_id, source, repo, {n} AS kind, '{k.name}' AS name, {value} AS v, e - length(m) AS s, e FROM (
    SELECT doc_id, source, repo, ms[i] AS m,
           sum(length(gs[i]) + length(ms[i])) OVER (PARTITION BY doc_id ORDER BY i) AS e
    FROM (SELECT doc_id, source, repo, regexp_extract_all(t, '{pattern}') AS ms,
                 regexp_split_to_array(t, '{pattern}') AS gs FROM d) AS x,
         unnest(range(1, len(ms) + 1)) AS u(i)) AS y) AS z
WHERE length(v) >= {k.least}{fits}""")
    return f"""
WITH d AS (SELECT doc_id, source, concat_ws('/', source, lang) AS repo, coalesce(text, '') AS t FROM documents),
c AS ({" UNION ALL ".join(parts)}),
f AS (SELECT v, count(DISTINCT source) AS owners, count(DISTINCT repo) AS repos FROM c GROUP BY v),
j AS (SELECT c.*, repos, owners <= 2 AND repos <= 4 AS live, c.name || ':' || CAST(s AS BIGINT) || ':' || CAST(e AS BIGINT) AS tag
      FROM c JOIN f USING (v)
      WHERE kind < 3 OR (owners <= 2 AND repos <= 4 AND NOT EXISTS (
            SELECT 1 FROM c AS b WHERE b.doc_id = c.doc_id AND b.kind < 3 AND b.s < c.e AND c.s < b.e))),
g AS (SELECT doc_id, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access,
             count(*) FILTER (kind = 2) AS n_hex, count(*) FILTER (kind = 3) AS n_bare,
             count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_example, max(repos) AS most_held,
             string_agg(tag, ',' ORDER BY s, kind) FILTER (kind < 3) AS base,
             string_agg(tag, ',' ORDER BY s, kind) AS spans FROM j GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
       coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
       coalesce(spans, '') AS spans, coalesce(n_bare, 0) AS n_bare, coalesce(n_live, 0) AS n_live,
       coalesce(n_example, 0) AS n_example, coalesce(most_held, 0) AS most_held
FROM documents LEFT JOIN g USING (doc_id)"""


def op2_repeated_strings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document less its repeated strings of 200 bytes."""
    return repeats.remove_repeats(table(spark, sf_dir, "documents"), "doc_id")


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measurements, failure bits and the verdict of policy v1 on every document."""
    entries = rules.ledger(table(spark, sf_dir, "documents"), "doc_id")
    return entries.select(
        "doc_id",
        *rules.MEASURES[:5],
        rules.rejected("base").alias("base_failed"),
        (~rules.rejected("base") & ~rules.rejected("v1")).alias("kept"),
        "failed_bits",
    )


def _op3_sql() -> str:
    space, word = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]+"
    bits = " + ".join(
        f"CASE WHEN {r.sql} THEN {1 << i} ELSE 0 END" for i, r in enumerate(rules.RULES)
    )
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, '{word}') AS ws,
             [x FOR x IN string_split(t, chr(10)) IF regexp_matches(x, '{word}')] AS ls FROM d),
runs AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS run
         FROM w, unnest(range(1, len(ws) - 6)) AS u(i) WHERE len(ws) >= 8),
twice AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, run) AS n FROM runs),
covered AS (SELECT doc_id, count(DISTINCT i + j) AS n_repeat_words
            FROM twice, unnest(range(0, 8)) AS v(j) WHERE n > 1 GROUP BY doc_id),
m AS (SELECT doc_id, len(ws) AS n_words,
             CAST(length(regexp_replace(t, '{space}', '', 'g')) AS BIGINT) AS word_chars,
             CAST(length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) AS BIGINT) AS n_symbols,
             CAST(len(ls) - len(list_distinct(ls)) AS BIGINT) AS n_dup_lines,
             coalesce(n_repeat_words, 0) AS n_repeat_words,
             len(ls) AS n_lines, len(list_distinct(ws)) AS n_unique_words,
             len(regexp_extract_all(t, '\\p{{Lu}}')) AS n_upper,
             len([x FOR x IN ws IF x LIKE '%!']) AS n_marked
      FROM w LEFT JOIN covered USING (doc_id)),
b AS (SELECT *, CAST({bits} AS INTEGER) AS failed_bits FROM m)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
       failed_bits & {rules.mask("base")} != 0 AS base_failed,
       failed_bits & {rules.mask("v1") | rules.mask("base")} = 0 AS kept, failed_bits
FROM b"""


def op4_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document encoded, and decoded again from its ids."""
    model = pieces.configured(spark)
    encoded = pieces.encode(table(spark, sf_dir, "documents"), model, "doc_id", verify=True)
    return encoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_pieces"),
        F.sha2(F.array_join("ids", ","), 256).alias("ids_sha256"),
        "round_trip",
    )


def op5_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Trees learned from the quality labels outside fold 0 of 5, applied to all documents."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", fold("doc_id", 5) == 0)
    known = staged(quality.statistics(docs, "doc_id", "held_out"), "quality-features")
    forest = quality.train(known.where("NOT held_out"), table(spark, sf_dir, "labels"))
    scored = quality.classify(known, forest, "doc_id", "held_out")
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))


def _big_endian_hex(col: str, size: int = 8) -> Column:
    """Little-endian bytes as lowercase hex, byte by byte: ``reverse`` takes binary for UTF-8 text."""
    return F.lower(F.hex(F.concat(*[F.substring(col, i, 1) for i in range(size, 0, -1)])))


def op6_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and component of every document: three-word shingles, three bits."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select(
        "doc_id",
        _big_endian_hex("fingerprint").alias("fingerprint"),
        F.col("component").alias("component_id"),
    )


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document: base spans, and disguised ones the tagger adds."""
    docs = table(spark, sf_dir, "documents")
    found = pii.find(docs, pii.train(docs), "doc_id")
    return found.select(
        "doc_id", "n_email", "n_ip", "n_card", "n_phone",
        F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_added",
    )


def op8_arc_to_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pages to ARC files, those to WARC files, and what the WARC files hold."""
    arc, warc = fresh_folder(spark, "arc"), fresh_folder(spark, "warc")
    archives.write_arc(table(spark, sf_dir, "pages"), arc)
    archives.convert(spark, arc, warc)
    return archives.warc_records(spark, warc).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"
    )


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank-order profiles of two thirds of the documents, applied to all."""
    docs = table(spark, sf_dir, "documents").withColumn("held_out", fold("doc_id", 3) == 1)
    profiles = langid.train(docs.where("NOT held_out"))
    return langid.identify(docs, profiles, "doc_id", "held_out")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The benchmark items each document holds at a resemblance of 0.8 or more."""
    found = decontam.matches(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id"
    )
    ids = F.array_sort(F.array_distinct(F.transform("matches", lambda m: m["item_id"])))
    return found.select(
        "doc_id",
        (F.size("matches") > 0).alias("contaminated"),
        F.size("matches").alias("n_items"),
        F.array_join(ids.cast("array<string>"), ",").alias("item_ids"),
        F.array_max(F.transform("matches", lambda m: m["similarity"])).alias("similarity"),
    )


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of the longer documents, drawn by their likeness to the benchmark."""
    return resampling.resample(
        table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), "doc_id"
    )


def _op11_sql() -> str:
    s = resampling.Settings()
    word, upper = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    words = f"regexp_extract_all(translate(coalesce(text, ''), '{upper}', '{upper.lower()}'), '{word}')"
    h = f"CAST('0x' || substr(sha256('{s.seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS UBIGINT)"
    return f"""
WITH d AS (SELECT doc_id, {words} AS ws FROM documents),
table_of AS (SELECT list_transform(range(256), lambda v: list_reduce(
       range(8), lambda c, i: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, v)) AS crcs),
own AS (SELECT doc_id, unnest(ws) AS w FROM d),
target AS (SELECT unnest({words}) AS w FROM benchmark),
b AS (SELECT w, xor(list_reduce(
               list_transform(regexp_extract_all(hex(encode(w)), '..'), lambda x: CAST('0x' || x AS BIGINT)),
               lambda c, x: xor(c >> 8, crcs[(xor(c, x) & 255) + 1]), 4294967295), 4294967295)
               % {s.buckets} AS bucket
      FROM (SELECT w FROM own UNION SELECT w FROM target), table_of),
s AS (SELECT bucket, count(*) AS n FROM own JOIN b USING (w) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM target JOIN b USING (w) GROUP BY bucket),
g AS (SELECT s.bucket, CAST(floor(1000 * ln(
               CAST(coalesce(t.n, 0) + 1 AS DOUBLE) * CAST((SELECT count(*) FROM own) + {s.buckets} AS DOUBLE)
               / (CAST(s.n + 1 AS DOUBLE) * CAST((SELECT count(*) FROM target) + {s.buckets} AS DOUBLE))))
             AS BIGINT) AS gain
      FROM s LEFT JOIN t USING (bucket)),
f AS (SELECT doc_id, CAST(floor(sum(gain) / CAST(count(*) AS DOUBLE)) AS BIGINT) AS weight
      FROM own JOIN b USING (w) JOIN g USING (bucket) GROUP BY doc_id),
x AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
             coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln(({h} + 0.5) / 4294967296))) AS BIGINT) AS score
      FROM d LEFT JOIN f USING (doc_id)),
r AS (SELECT doc_id, row_number() OVER (ORDER BY score DESC, doc_id) AS rank FROM x
      WHERE n_features >= {s.min_words})
SELECT doc_id, n_features, weight, score,
       CASE WHEN rank <= (SELECT {s.percent} * count(*) // 100 FROM r) THEN rank END AS rank
FROM x LEFT JOIN r USING (doc_id)"""


def op12_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tokens of every document under the SentencePiece model."""
    return tokens.count(table(spark, sf_dir, "documents"), pieces.configured(spark), "doc_id")


def op13_fill_in_middle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document taken apart, and put together again from what that gave."""
    made = fim.transform(
        table(spark, sf_dir, "documents"), "doc_id"
    ).withColumn("output_sha256", F.sha2("output", 256))
    names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output_sha256"]
    back = fim.restore(made, *names)
    return back.select(*names, F.sha2("text", 256).alias("restored_sha256"))


def _op13_sql() -> str:
    plan = fim.Plan()
    p, s, m = plan.marks
    held = " OR ".join(f"contains(t, '{x}')" for x in plan.marks)
    part = "CAST('0x' || substr(hx, {at}, 8) AS UBIGINT)"
    h1, h2, h3, h4 = (part.format(at=1 + 8 * i) for i in range(4))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t,
                  sha256('{plan.seed}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS hx FROM documents),
u AS (SELECT *, regexp_extract_all(t, '[{plan.joined}]+|[^{plan.joined}]') AS us FROM d),
c AS (SELECT *, len(us) AS n, {h1} % (len(us) + 1) AS c1, {h2} % (len(us) + 1) AS c2,
             CASE WHEN t = '' OR {held} OR {h3} % 100 >= {plan.transformed} THEN 'plain'
                  WHEN {h4} % 100 < {plan.spm} THEN 'spm' ELSE 'psm' END AS form FROM u),
k AS (SELECT doc_id, t, n, form,
             array_to_string(us[1:CAST(least(c1, c2) AS BIGINT)], '') AS a,
             array_to_string(us[CAST(least(c1, c2) AS BIGINT) + 1:CAST(greatest(c1, c2) AS BIGINT)], '') AS b,
             array_to_string(us[CAST(greatest(c1, c2) AS BIGINT) + 1:], '') AS z FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form,
       CASE WHEN form != 'plain' THEN CAST(length(a) AS BIGINT) END AS prefix_chars,
       CASE WHEN form != 'plain' THEN CAST(length(b) AS BIGINT) END AS middle_chars,
       sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN '{p}' || a || '{s}' || z || '{m}' || b
                        ELSE '{s}' || z || '{p}' || a || '{m}' || b END) AS output_sha256,
       sha256(t) AS restored_sha256
FROM k"""


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secrets": op1_secrets,
    "op2_repeated_strings": op2_repeated_strings,
    "op3_quality_rules": op3_quality_rules,
    "op4_pieces": op4_pieces,
    "op5_quality_classifier": op5_quality_classifier,
    "op6_simhash": op6_simhash,
    "op7_personal_data": op7_personal_data,
    "op8_arc_to_warc": op8_arc_to_warc,
    "op9_language_id": op9_language_id,
    "op10_decontamination": op10_decontamination,
    "op11_resampling": op11_resampling,
    "op12_token_counts": op12_token_counts,
    "op13_fill_in_middle": op13_fill_in_middle,
}

ORACLE: dict[str, str] = {
    "op1_secrets": _op1_sql(),
    "op3_quality_rules": _op3_sql(),
    "op11_resampling": _op11_sql(),
    "op13_fill_in_middle": _op13_sql(),
}
