"""The registered queries of this subpackage and their SQL."""

import public_tokenizers
from pyspark.sql import functions as F

from tallyline.llm import (
    alignment, bpe, chat, decontamination, exact_dedup, fingerprints, html_text, licences, mixing, near_dedup, search, toxicity,
    url_filter,
)
from tallyline.llm.common import table

URL_RULES = [
    ("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"),
]

MIX = {"clean": 0.90, "junk": 0.08, "toxic": 0.02}


def op1_exact_dedup(spark, sf_dir):
    return exact_dedup.exact_groups(table(spark, sf_dir, "documents")).drop("text_key")


def op2_chat_format(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    text = "\\### Assistant: </turn> ok"
    more = spark.createDataFrame([(-7, 0, "user", text), (-7, 1, "assistant", text)], rows.schema)
    turns = chat.canonical_turns(rows.unionByName(more), order_col="turn")
    chats = chat.format_chats(turns)
    read = chats.select(
        "conv_id", chat.read_turns(F.col("formatted")).alias("turns"),
        chat.loss_text(F.col("formatted"), F.col("spans")).alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"),
    )
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.encode(F.concat_ws("", said), "UTF-8"), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.encode("loss", "UTF-8"), 256).alias("loss_sha256"), "formatted_chars",
    )


def op3_fingerprints(spark, sf_dir):
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


def op4_byte_bpe(spark, sf_dir):
    path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    return bpe.round_trip(table(spark, sf_dir, "documents"), str(path), public_tokenizers.PATTERN)


def op5_url_filter(spark, sf_dir):
    judged = url_filter.judge_urls(table(spark, sf_dir, "pages"), URL_RULES)
    return judged.withColumn("score", F.round("score", 6) + 0.0)


def op6_near_dedup(spark, sf_dir):
    return near_dedup.near_classes(table(spark, sf_dir, "documents")).drop("text_key")


def op7_toxicity(spark, sf_dir):
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_licences(spark, sf_dir):
    return licences.licences(table(spark, sf_dir, "documents"))


def op9_mixing(spark, sf_dir):
    rates = mixing.mixed_rates(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"), MIX)
    parts = [F.col("posterior")[i].alias(f"p_{name}") for i, name in enumerate(mixing.DOMAINS)]
    return rates.select("doc_id", "tokens", *parts, "rate", "copies")


def op10_html_text(spark, sf_dir):
    return html_text.extracted(table(spark, sf_dir, "pages"))


def op11_alignment(spark, sf_dir):
    files = str(public_tokenizers.path("byte_bpe_50k.json")), public_tokenizers.PATTERN, str(public_tokenizers.path("piece_bpe_32k.model"))
    return alignment.alignment(table(spark, sf_dir, "documents"), files)


def op12_search(spark, sf_dir):
    return search.ranked(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op13_decontamination(spark, sf_dir):
    found = decontamination.hits(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    n_hit = decontamination.n_hit()
    return found.select(
        "doc_id", "hits.n_words", n_hit.alias("n_hit"), F.size("hits.items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "hits.items"), 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"),
    )


def _url_level(order):
    """SQL of one level of the two url models: the chance of a gram's last character after the others."""
    chance = lambda k: (
        f"CASE WHEN {k}_all = 0 THEN {k}_below ELSE ({k} + {k}_kinds * {k}_below) / ({k}_all + {k}_kinds) END AS {k}_p"
    )
    shorter = "1 / 256.0 AS a_below, 1 / 256.0 AS b_below" if order == 1 else "s.a_p AS a_below, s.b_p AS b_below"
    join = "" if order == 1 else f"JOIN model{order - 1} s ON s.gram = right(l.gram, {order - 1})"
    return f"""
        level{order} AS (
            SELECT right(gram, {order}) AS gram, sum(a) AS a, sum(b) AS b FROM counts GROUP BY 1
        ), context{order} AS (
            SELECT left(gram, {order - 1}) AS context, sum(a) AS a_all, sum(b) AS b_all,
                count(*) FILTER (a > 0) AS a_kinds, count(*) FILTER (b > 0) AS b_kinds
            FROM level{order} GROUP BY 1
        ), model{order} AS (
            SELECT gram, {chance("a")}, {chance("b")} FROM (
                SELECT l.*, c.* EXCLUDE (context), {shorter}
                FROM level{order} l JOIN context{order} c ON c.context = left(l.gram, {order - 1}) {join}
            )
        )"""


QUERIES = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_chat_format": op2_chat_format,
    "op3_fingerprints": op3_fingerprints,
    "op4_byte_bpe": op4_byte_bpe,
    "op5_url_filter": op5_url_filter,
    "op6_near_dedup": op6_near_dedup,
    "op7_toxicity": op7_toxicity,
    "op8_licences": op8_licences,
    "op9_mixing": op9_mixing,
    "op10_html_text": op10_html_text,
    "op11_alignment": op11_alignment,
    "op12_search": op12_search,
    "op13_decontamination": op13_decontamination,
}

ORACLES = {
    "op1_exact_dedup": r"""
        WITH texts AS (
            SELECT doc_id, coalesce(text, '') AS original,
                regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm
            FROM documents
        ), ranked AS (
            SELECT doc_id, sha256(norm) AS text_sha256, length(original) AS n_chars,
                count(*) OVER (PARTITION BY norm) AS group_size,
                first_value(doc_id) OVER (PARTITION BY norm ORDER BY length(original) DESC, doc_id) AS keep_id
            FROM texts
        )
        SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256, n_chars FROM ranked
    """,
    "op2_chat_format": r"""
        WITH said AS (
            SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
            UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
            UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'
        ), escaped AS (
            SELECT *, length(replace(text, '\', '\\')) + length(text) - length(replace(text, '</turn>', '/turn>'))
                + coalesce(list_sum(list_transform(regexp_extract_all(text, '#{3,}'), lambda r: length(r) - 2)), 0) AS body_chars
            FROM said
        ), chats AS (
            SELECT conv_id, count(*) AS n_turns,
                string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text) AS turns,
                coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '') AS loss,
                sum(length(role) + body_chars + 14) AS formatted_chars
            FROM escaped GROUP BY conv_id
        )
        SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars,
            sha256(loss) AS loss_sha256, CAST(formatted_chars AS BIGINT) AS formatted_chars
        FROM chats
    """,
    "op5_url_filter": r"""
        WITH parts AS (
            SELECT page_id, path, translate(host, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host FROM (
                SELECT page_id, coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '') AS host,
                    coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path
                FROM pages
            )
        ), ruled AS (
            SELECT *, CASE
                WHEN (host = 'example.net' OR ends_with(host, '.example.net')) AND starts_with(path, '/en/') THEN 'example.net/en/'
                WHEN (host = 'example.com' OR ends_with(host, '.example.com')) AND starts_with(path, '/de/') THEN 'example.com/de/'
                WHEN (host = 'org' OR ends_with(host, '.org')) AND starts_with(path, '/fr/') THEN 'org/fr/'
                WHEN (host = 'net' OR ends_with(host, '.net')) AND starts_with(path, '/') THEN 'net/'
            END AS rule FROM parts
        ), decided AS (
            SELECT *, CASE WHEN rule IN ('net/', 'example.com/de/') THEN 'block' WHEN rule IS NOT NULL THEN 'allow' END AS said FROM ruled
        ), addresses AS (
            SELECT address, said, CAST('0x' || left(md5(address), 8) AS BIGINT) % 5 = 0 AS held
            FROM (SELECT host || path AS address, max(said) AS said FROM decided GROUP BY 1)
        ), grams AS (
            SELECT address, said, held, substr(padded, i, 4) AS gram FROM (
                SELECT *, unnest(range(1, length(padded) - 2)) AS i
                FROM (SELECT *, chr(2) || chr(2) || chr(2) || address || chr(3) AS padded FROM addresses)
            )
        ), counts AS (
            SELECT gram, count(*) FILTER (said = 'allow' AND NOT held) AS a, count(*) FILTER (said = 'block' AND NOT held) AS b
            FROM grams GROUP BY gram
        ),""" + ",".join(_url_level(order) for order in range(1, url_filter.ORDER + 1)) + r""", known AS (
            SELECT coalesce(bool_or(a > 0) AND bool_or(b > 0), false) AS known FROM counts
        ), raw AS (
            SELECT address, avg(CASE WHEN known THEN ln(a_p) - ln(b_p) ELSE 0 END) AS score
            FROM grams JOIN model4 USING (gram), known GROUP BY address
        ), ends AS (
            SELECT count(*) FILTER (said = 'allow') AS n_a, count(*) FILTER (said = 'block') AS n_b,
                avg(score) FILTER (said = 'allow') AS mean_a, avg(score) FILTER (said = 'block') AS mean_b,
                stddev_pop(score) FILTER (said = 'allow') AS spread_a, stddev_pop(score) FILTER (said = 'block') AS spread_b
            FROM raw JOIN addresses USING (address) WHERE held
        ), threshold AS (
            SELECT CASE WHEN n_a = 0 OR n_b = 0 THEN 0 WHEN spread_a + spread_b = 0 THEN (mean_a + mean_b) / 2
                ELSE (mean_a * spread_b + mean_b * spread_a) / (spread_a + spread_b) END AS cut FROM ends
        )
        SELECT page_id, host, path, rule, coalesce(said, CASE WHEN score >= cut THEN 'allow' ELSE 'block' END) AS verdict,
            round(score - cut, 6) + 0.0 AS score
        FROM decided JOIN raw ON raw.address = host || path, threshold
    """,
    "op12_search": r"""
        WITH words AS (
            SELECT doc_id, row_number() OVER () AS row, len(w) AS n, w FROM (
                SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                    '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS w
                FROM documents
            ) WHERE len(w) > 0
        ), asked AS (
            SELECT item_id, row_number() OVER () AS item, unnest(regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
            FROM benchmark
        ), wanted AS (
            SELECT item, item_id, term, count(*) AS c FROM asked GROUP BY ALL
        ), corpus AS (
            SELECT count(*) AS n_docs, CAST(sum(n) AS BIGINT) AS n_terms FROM words
        ), counted AS (
            SELECT row, doc_id, n, term, count(*) AS tf FROM (SELECT row, doc_id, n, unnest(w) AS term FROM words)
            WHERE term IN (SELECT term FROM wanted) GROUP BY ALL
        ), weights AS (
            SELECT term, CAST(floor(1000 * ln((2.0 * n_docs + 2) / (2 * df + 1))) AS BIGINT) AS w
            FROM (SELECT term, count(*) AS df FROM counted GROUP BY term), corpus
        ), scored AS (
            SELECT item, item_id, row, doc_id,
                CAST(sum(c * w * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * n_docs) // n_terms)))) AS BIGINT) AS score
            FROM wanted JOIN counted USING (term) JOIN weights USING (term), corpus
            GROUP BY ALL
        )
        SELECT item_id, CAST(place AS INTEGER) AS rank, doc_id, score FROM (
            SELECT *, row_number() OVER (PARTITION BY item ORDER BY score DESC, doc_id, row) AS place FROM scored WHERE score > 0
        ) WHERE place <= 20
    """,
    "op13_decontamination": r"""
        WITH items AS (
            SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all(
                translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
            FROM benchmark
        ), windows AS (
            SELECT DISTINCT item, k, array_to_string(w[i:i + k - 1], ' ') AS win FROM (
                SELECT item, w, least(len(w), 10) AS k, unnest(range(1, greatest(len(w) - 10, 0) + 2)) AS i FROM items WHERE len(w) > 0
            )
        ), words AS (
            SELECT doc_id, row_number() OVER () AS row, coalesce(w, []) AS w FROM (
                SELECT doc_id, regexp_extract_all(
                    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
                FROM documents
            )
        ), found AS (
            SELECT row, item, k, i FROM (
                SELECT row, k, i, array_to_string(w[i:i + k - 1], ' ') AS win FROM (
                    SELECT row, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM words, (SELECT DISTINCT k FROM windows)
                )
            ) JOIN windows USING (k, win)
        ), places AS (
            SELECT row, count(DISTINCT place) AS n_hit FROM (SELECT row, unnest(range(i, i + k)) AS place FROM found) GROUP BY row
        ), named AS (
            SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items
            FROM (SELECT DISTINCT row, item FROM found) GROUP BY row
        )
        SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
            sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
        FROM words LEFT JOIN places USING (row) LEFT JOIN named USING (row)
    """,
}
