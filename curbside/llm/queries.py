"""The operators of this package as queries over the given tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, functions as F

from curbside.llm import (
    exact_dedup, language_id, lexical, minhash, mixing, packing, pieces, pii, repair, suffix_dedup, token_counts, toxicity,
    vectors,
)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

WORDS = public_tokenizers.path("word_bpe_49k.json")
PIECES = public_tokenizers.path("piece_bpe_32k.model")
BASE_KINDS = ["email", "ip", "card", "phone"]


def query(function: Callable[[SparkSession, str], DataFrame]):
    QUERIES[function.__name__] = function
    return function


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of at most 4096 tokens; one row for each piece of a document."""
    pieces = packing.pack_documents(table(spark, sf_dir, "documents"), WORDS, capacity=4096, end_id=2)
    return pieces.select(
        "doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset"
    )


@query
def op2_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document encoded into pieces and decoded again."""
    return pieces.round_trips(table(spark, sf_dir, "documents"), PIECES).select(
        "doc_id", "n_tokens", "n_bytes", F.crc32("ids").alias("ids_crc32"), "round_trip"
    )


@query
def op3_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """For each document the one that stays of its equal texts."""
    return exact_dedup.exact_duplicates(table(spark, sf_dir, "documents"))


ORACLES["op3_exact_dedup"] = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS h
  FROM documents
)
SELECT doc_id, max(doc_id) OVER g AS keep_id, count(*) OVER g AS group_size,
  doc_id = max(doc_id) OVER g AS kept, h AS text_sha256
FROM d WINDOW g AS (PARTITION BY h)
"""


@query
def op4_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Links between vectors of one label with a cosine of 0.98 or more."""
    return vectors.near_vectors(table(spark, sf_dir, "embeddings"), least=0.98)


ORACLES["op4_embedding_dedup"] = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings
),
good AS (
  SELECT * FROM v WHERE label IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(e, lambda x: x <> 0)) > 0
),
links AS (
  SELECT a.vec_id AS p, b.vec_id AS q FROM good a JOIN good b
  ON a.label = b.label AND len(a.e) = len(b.e) AND a.vec_id <> b.vec_id AND list_cosine_similarity(a.e, b.e) >= 0.98
),
reached AS (
  SELECT vec_id AS p, vec_id AS q FROM v
  UNION SELECT r.p, l.q FROM reached r JOIN links l ON r.q = l.p
),
named AS (SELECT p AS vec_id, min(q) AS component_id FROM reached GROUP BY p),
counted AS (SELECT p AS vec_id, count(*) AS n FROM links GROUP BY p)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN named USING (vec_id) LEFT JOIN counted USING (vec_id)
"""


def fold(doc_id: str, folds: int):
    """The remainder by which rows are held out of training; rows without doc_id have none."""
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % folds


def language_model(spark: SparkSession, docs: DataFrame) -> language_id.LanguageModel:
    """Learned from the rows that are not held out."""
    return language_id.train(docs.where(fold("doc_id", 4) != 2), PIECES)


@query
def op5_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of each document."""
    docs = table(spark, sf_dir, "documents")
    found = language_id.predict_language(docs, language_model(spark, docs))
    return found.select("doc_id", F.coalesce(fold("doc_id", 4) == 2, F.lit(False)).alias("held_out"), "lang_pred", "score")


@query
def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The histogram of encoded lengths with totals for each length as a context limit."""
    return token_counts.length_histogram(token_counts.encoded_lengths(table(spark, sf_dir, "documents"), WORDS))


@query
def op7_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in each document: counts and spans."""
    found = pii.find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id",
        *[pii.span_count(F.col("pii"), k).alias(f"n_{k}") for k in BASE_KINDS],
        F.sha2(pii.span_text(F.col("pii"), BASE_KINDS), 256).alias("base_sha256"),
        pii.span_text(F.col("pii"), list(pii.PATTERNS)).alias("spans"),
        F.concat_ws(",", F.transform("pii", lambda s: s["score"].cast("string"))).alias("scores"),
    )


def _pii_sql() -> str:
    plain = {
        "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
        "ip": r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+",
        "card": r"[0-9](?:[\x20-]?[0-9])+",
        "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
        "iban": r"\b(?:" + "|".join(
            rf"(?:{'|'.join(names)})[0-9]{{2}}(?:\x20?[A-Z0-9]){{{length - 4}}}" for length, names in sorted(pii.IBAN_LENGTHS.items())
        ) + r")\b",
        "ssn": r"\b[0-9]{3}-[0-9]{2}-[0-9]{4}\b",
    }
    digits = "regexp_replace(m, '[^0-9]', '', 'g')"
    luhn = (
        f"list_sum(list_transform(range(1, length({digits}) + 1), lambda i: CASE WHEN i % 2 = 1 THEN {digits}[-i]::INT "
        f"ELSE ({digits}[-i]::INT * 2) // 10 + ({digits}[-i]::INT * 2) % 10 END)) % 10 = 0"
    )
    turned = "regexp_replace(replace(m, ' ', ''), '^(.{4})(.*)$', '\\2\\1')"
    number = (
        f"list_reduce(list_prepend(0::BIGINT, list_transform(string_split({turned}, ''), lambda c: "
        "CASE WHEN c BETWEEN '0' AND '9' THEN c::BIGINT ELSE ascii(c) - 55 END)), "
        "lambda a, b: CASE WHEN b < 10 THEN (a * 10 + b) % 97 ELSE (a * 100 + b) % 97 END)"
    )
    tests = {
        "email": "true",
        "ip": "list_max(list_transform(string_split(m, '.'), lambda x: CASE WHEN length(ltrim(x, '0')) > 3 THEN 999 "
        "WHEN ltrim(x, '0') = '' THEN 0 ELSE ltrim(x, '0')::INT END)) <= 255",
        "card": f"length({digits}) BETWEEN 16 AND 19 AND {luhn}",
        "phone": f"length({digits}) BETWEEN 8 AND 15",
        "iban": f"{number} = 1",
        "ssn": "NOT regexp_matches(m, '^(?:000|666|9)|-00-|-0000$')",
    }
    parts = [
        f"""SELECT doc_id, t, {at} AS kind_at, '{kind}' AS kind, unnest(regexp_extract_all(t, '{plain[kind]}')) AS m,
        generate_subscripts(regexp_extract_all(t, '{plain[kind]}'), 1) AS i, string_split_regex(t, '{plain[kind]}') AS gaps,
        regexp_extract_all(t, '{plain[kind]}') AS ms FROM d WHERE regexp_matches(t, '{plain[kind]}')"""
        for at, kind in enumerate(plain)
    ]
    checks = " ".join(f"WHEN kind = '{k}' THEN {t}" for k, t in tests.items())
    raised = " ".join(f"WHEN kind = '{k}' THEN regexp_matches(near, '\\b(?:{w})')" for k, w in pii.CONTEXT.items())
    lowered = " ".join(f"WHEN kind = '{k}' THEN regexp_matches(near, '\\b(?:{w})')" for k, w in pii.AGAINST.items())
    base = " ".join(f"WHEN kind = '{k}' THEN {s}" for k, s in pii.SCORES.items())
    counts = ", ".join(f"count(*) FILTER (kind = '{k}') AS n_{k}" for k in BASE_KINDS)
    joined = "string_agg(kind || ':' || s || ':' || e, ',' ORDER BY kind_at, s)"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
matches AS ({" UNION ALL ".join(parts)}),
placed AS (
  SELECT doc_id, t, kind_at, kind, m,
    list_sum(list_transform(gaps[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(ms[1:i - 1], lambda x: length(x))), 0) AS s
  FROM matches WHERE CASE {checks} END
),
ended AS (SELECT *, s + length(m) AS e FROM placed),
nearby AS (SELECT *, lower(t[greatest(s - {pii.REACH}, 0) + 1:s] || ' ' || t[e + 1:e + {pii.REACH}]) AS near FROM ended),
scored AS (
  SELECT *, round(least(CASE {base} END + CASE WHEN CASE {raised} END THEN {pii.RAISE} ELSE 0.0 END
    - CASE WHEN CASE {lowered} ELSE false END THEN {pii.RAISE} ELSE 0.0 END, 1.0)::DOUBLE, 2) AS score FROM nearby
),
found AS (
  SELECT doc_id, {counts}, {joined} FILTER (kind_at < 4) AS base, {joined} AS spans,
    string_agg(score::VARCHAR, ',' ORDER BY kind_at, s) AS scores
  FROM scored GROUP BY doc_id
)
SELECT d.doc_id, {", ".join(f"coalesce(n_{k}, 0) AS n_{k}" for k in BASE_KINDS)},
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(scores, '') AS scores
FROM d LEFT JOIN found USING (doc_id)
"""


ORACLES["op7_pii"] = _pii_sql()


@query
def op8_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The toxicity of each document."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    learned = labels.where(fold("doc_id", 5) != 0).select("doc_id", F.col("toxic").alias("label"))
    model = toxicity.train(docs, learned)
    return toxicity.score_toxicity(docs, model).select(
        "doc_id", F.coalesce(fold("doc_id", 5) == 0, F.lit(False)).alias("held_out"), "score",
        (F.col("score") >= 0.5).cast("int").alias("predicted"),
    )


@query
def op9_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each document without the bytes of strings of 400 bytes that occur elsewhere too."""
    return suffix_dedup.remove_repeats(table(spark, sf_dir, "documents"), length=400, words=51).select(
        "doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"),
        (F.col("n_removed") > 0).alias("has_repeats"),
        # a passage in a text of its own, unlike a copy of a whole text
        ((F.col("n_removed") > 0) & (F.col("n_removed") < F.col("n_bytes"))).alias("has_repeated_passage"),
        F.when(F.col("n_bytes") > 0, F.col("n_removed") / F.col("n_bytes")).otherwise(0.0).alias("removed_share"),
        # passages of over 50 words of another document, also those that are too short to be removed
        F.col("n_shared").alias("n_shared_passages"), (F.col("n_shared") > 0).alias("has_shared_passage"),
    )


@query
def op10_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Groups of documents whose sets of three-word shingles have a similarity of 0.85 or more."""
    return minhash.near_duplicates(table(spark, sf_dir, "documents"), words=3, similarity="0.85")


@query
def op11_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words that a mix of all sources takes of each document."""
    return mixing.mix_sources(table(spark, sf_dir, "documents"), weights=(5, 2, 1), repeats=3)


ORACLES["op11_mixing"] = """
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size FROM documents
),
s AS (
  SELECT source, sum(size) AS source_size, 3 * sum(size) AS most,
    [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM d GROUP BY source
),
leveled AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(most) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
    / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS l
  FROM s WINDOW o AS (ORDER BY most::DOUBLE / weight, source NULLS LAST)
),
t AS (SELECT source, source_size::BIGINT AS source_size, least(most::DOUBLE, weight * max(l) OVER ()) AS target FROM leveled),
q AS (
  SELECT *, coalesce(sum(size) OVER (
    PARTITION BY source ORDER BY md5(concat_ws(':', '0', coalesce(doc_id::VARCHAR, ''), size::VARCHAR)), doc_id, size
    ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM d
)
SELECT doc_id, q.source, size, source_size, target,
  list_sum(list_transform([0, 1, 2], lambda e: greatest(0, least(size, floor(target)::BIGINT - e * source_size - start))))::BIGINT AS taken
FROM q JOIN t ON q.source IS NOT DISTINCT FROM t.source
"""


@query
def op12_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten documents that score highest for each benchmark item."""
    return lexical.rank_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


ORACLES["op12_lexical_search"] = """
WITH split AS (
  SELECT doc_id, row_number() OVER () AS row_id,
    regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS terms
  FROM documents WHERE text IS NOT NULL
),
d AS (SELECT *, len(terms) AS n FROM split WHERE len(terms) > 0),
whole AS (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS l FROM d),
p AS (SELECT row_id, any_value(doc_id) AS doc_id, any_value(n) AS n, term, count(*)::BIGINT AS tf
  FROM (SELECT row_id, doc_id, n, unnest(terms) AS term FROM d) GROUP BY row_id, term),
i AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
  FROM benchmark WHERE text IS NOT NULL
),
w AS (SELECT term, floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE))::BIGINT AS w FROM p, whole GROUP BY term, big_n),
s AS (
  SELECT item_id, row_id, any_value(doc_id) AS doc_id,
    sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * n * big_n) // l))))::BIGINT AS score
  FROM i JOIN p USING (term) JOIN w USING (term), whole GROUP BY item_id, row_id
),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id NULLS LAST)::INT AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""


@query
def op13_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cheapest repair of each damaged conversation."""
    return repair.repair_conversations(repair.damage(table(spark, sf_dir, "conversations")))


ORACLES["op13_conversation_repair"] = """
WITH RECURSIVE
crc AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0],
      lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS v
    FROM range(256) r(i))
),
keyed AS (
  SELECT *, list_transform(string_split(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '), ''), lambda c: ascii(c)::BIGINT) AS codes
  FROM conversations
),
kinds AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(list_reduce(list_prepend(4294967295::BIGINT, codes), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 20 AS kind
  FROM keyed, crc
),
damaged AS (
  SELECT conv_id, turn, CASE kind WHEN 4 THEN 'user' ELSE role END AS role,
    CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) FROM kinds)
),
ordered AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(text)) AS i FROM damaged
),
seen AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) AS nth FROM ordered),
turns AS (
  SELECT conv_id, turn, i, role, text, left(role, 1) AS init,
    CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'blank' WHEN nth > 1 THEN 'duplicate'
      WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 'truncated' END AS fault
  FROM seen
),
pairs AS (SELECT *, lag(init) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM turns),
counted AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
    count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
    count(*) FILTER (fault = 'truncated') AS truncated, count(*) FILTER (before || init NOT IN ('su', 'ua', 'au')) AS illegal,
    count(*) AS n
  FROM pairs GROUP BY conv_id
),
ins(state, mid, marks, lines) AS (
  VALUES (0, 0, '', []::VARCHAR[]), (0, 2, 'I', ['user:']), (0, 3, 'II', ['user:', 'assistant:']), (1, 1, '', []), (1, 2, 'I', ['user:']),
    (1, 3, 'II', ['user:', 'assistant:']), (2, 2, '', []), (2, 3, 'I', ['assistant:']), (3, 3, '', []), (3, 2, 'I', ['user:'])
),
edits(mid, init, mark, state, cost) AS (
  VALUES (0, NULL, 'D', 0, 3), (1, NULL, 'D', 1, 3), (2, NULL, 'D', 2, 3), (3, NULL, 'D', 3, 3),
    (0, NULL, 'R', 2, 2), (1, NULL, 'R', 2, 2), (2, NULL, 'R', 3, 2), (3, NULL, 'R', 2, 2),
    (0, 's', 'K', 1, 0), (0, 'u', 'K', 2, 0), (1, 'u', 'K', 2, 0), (3, 'u', 'K', 2, 0), (2, 'a', 'K', 3, 0)
),
ways AS (
  SELECT conv_id, 0::BIGINT AS i, 0 AS state, {'c': 0, 'a': '', 'l': []::VARCHAR[]} AS best FROM counted
  UNION ALL
  SELECT w.conv_id, t.i, e.state, min({
    'c': w.best.c + 2 * length(n.marks) + e.cost + CASE WHEN t.fault = 'truncated' AND e.mark <> 'D' THEN 1 ELSE 0 END,
    'a': w.best.a || n.marks || e.mark,
    'l': list_concat(w.best.l, n.lines, CASE e.mark WHEN 'D' THEN [] WHEN 'K' THEN [t.role || ':' || t.text]
      ELSE [CASE e.state WHEN 2 THEN 'user:' ELSE 'assistant:' END || t.text] END)})
  FROM ways w JOIN turns t ON w.conv_id IS NOT DISTINCT FROM t.conv_id AND t.i = w.i + 1
    JOIN ins n ON n.state = w.state
    JOIN edits e ON e.mid = n.mid AND (e.init IS NULL OR e.init = t.init)
      AND (e.mark = 'D' OR coalesce(t.fault, '') NOT IN ('blank', 'duplicate'))
  GROUP BY w.conv_id, t.i, e.state
),
trail(state, marks, lines) AS (
  VALUES (0, '', []::VARCHAR[]), (1, 'II', ['user:', 'assistant:']), (2, 'I', ['assistant:']), (3, '', [])
),
ended AS (
  SELECT w.conv_id, min({'c': w.best.c + 2 * length(t.marks), 'a': w.best.a || t.marks, 'l': list_concat(w.best.l, t.lines)}) AS best
  FROM ways w JOIN counted c ON w.conv_id IS NOT DISTINCT FROM c.conv_id AND w.i = c.n JOIN trail t ON t.state = w.state
  GROUP BY w.conv_id
),
every AS (SELECT DISTINCT conv_id FROM conversations)
SELECT v.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
  coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(best.c, 0)::BIGINT AS cost,
  coalesce(best.a, '') AS audit, sha256(coalesce(array_to_string(best.l, chr(10)), '')) AS repaired_sha256
FROM every v LEFT JOIN counted c ON v.conv_id IS NOT DISTINCT FROM c.conv_id
LEFT JOIN ended e ON v.conv_id IS NOT DISTINCT FROM e.conv_id
"""
