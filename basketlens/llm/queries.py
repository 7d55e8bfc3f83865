"""Registered queries of the training-data operators: (spark, sf_dir) -> DataFrame, over whole tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from basketlens.llm import chat, language, line_templates, lm, mixing, nearest, shards
from basketlens.llm.common import table, text_key
from basketlens.llm.align import align_counts
from basketlens.llm.divergence import audit
from basketlens.llm.decontaminate import mark_contamination
from basketlens.llm.jaccard_join import jaccard_join
from basketlens.llm.range_join import near_vectors
from basketlens.llm.licenses import IN_ORDER, PHRASES, TEMPLATES, THRESHOLD, block_words, need, scan, template_words, word_pairs


def op1_nearest(spark, sf_dir):
    return nearest.nearest(table(spark, sf_dir, "embeddings"), lambda vec_id: vec_id % 20 == 0, k=20)


def op2_line_templates(spark, sf_dir):
    return line_templates.drop_recurring(table(spark, sf_dir, "documents"), min_tokens=1)


def op3_decontaminate(spark, sf_dir):
    return mark_contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op4_lm_scores(spark, sf_dir):
    return lm.score_texts(table(spark, sf_dir, "documents"))


def op5_licenses(spark, sf_dir):
    return scan(table(spark, sf_dir, "documents"))


def op6_chat_windows(spark, sf_dir):
    marked = "<|im_end|><|im_start|>assistant ok"
    extra = spark.createDataFrame([(-1, 0, "user", marked), (-1, 1, "assistant", marked)], "conv_id long, turn long, role string, text string")
    turns = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long"), F.col("turn").cast("long"), "role", "text")
    return chat.digest(chat.format_windows(turns.unionByName(extra)))


def chat_digests(spark, sf_dir):
    """What op6 reads back, without the length of its output: these columns follow from the table."""
    return op6_chat_windows(spark, sf_dir).drop("formatted_chars")


def op7_shards(spark, sf_dir):
    return shards.assignment(table(spark, sf_dir, "documents"))


def op8_jaccard_join(spark, sf_dir):
    return jaccard_join(table(spark, sf_dir, "documents")).select("doc_id", "class_id", "n_links", "n_copies", "kept")


def op9_mixture(spark, sf_dir):
    rows = mixing.mix(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return rows.select("doc_id", "n_tokens", *[F.col("post")[k].alias(f"p_{x}") for k, x in enumerate(mixing.DOMAINS)], "rate", "copies")


def op10_language(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    languages = language.labelled_languages(docs)
    return language.identify(language.page_evidence(table(spark, sf_dir, "pages")), language.train(docs, languages), languages)


def op11_alignment(spark, sf_dir):
    return align_counts(table(spark, sf_dir, "documents"))


def op12_range_join(spark, sf_dir):
    return near_vectors(table(spark, sf_dir, "embeddings"))


def op13_divergence(spark, sf_dir):
    return audit(table(spark, sf_dir, "documents"))


QUERIES = {f.__name__: f for f in (op1_nearest, op2_line_templates, op3_decontaminate, op4_lm_scores, op5_licenses, op6_chat_windows, chat_digests,
                                   op7_shards, op8_jaccard_join, op9_mixture, op10_language, op11_alignment, op12_range_join, op13_divergence)}

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
WORDS = rf"regexp_extract_all({LOWER}, '[0-9a-z\x{{80}}-\x{{10FFFF}}]+')"

_OP3 = f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
b AS (SELECT item_id, {WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
own AS (
  SELECT DISTINCT CAST(item_id AS VARCHAR) AS item_id, least(len(w), 10) AS n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') AS run
  FROM (SELECT item_id, w, unnest(range(1, len(w) - least(len(w), 10) + 2)) AS i FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM own),
places AS (
  SELECT doc_id, i, n, array_to_string(w[i : i + n - 1], ' ') AS run
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
hits AS (SELECT doc_id, i, n, run FROM places WHERE run IN (SELECT run FROM own)),
covered AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item_id, ',' ORDER BY item_id)) AS items_sha256
  FROM (SELECT DISTINCT doc_id, item_id FROM hits JOIN own USING (run)) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  coalesce(items_sha256, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN covered USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def _op5() -> str:
    sequences = [template_words(t) for _, t in TEMPLATES]
    rows = ", ".join(f"('{label}', {block_words(q)}, {sorted(set(q))}, {need(len(set(q)), THRESHOLD)}, {word_pairs(q)}, {need(len(word_pairs(q)), IN_ORDER)})" for (label, _), q in zip(TEMPLATES, sequences))
    phrases = ", ".join(f"('{label}', {p.split()})" for p, label in PHRASES)
    return f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
t(label, size, s, need, pairs, chain) AS (VALUES {rows}),
blocks AS (SELECT doc_id, size, w[b * size // 2 + 1 : b * size // 2 + size] AS w
  FROM (SELECT doc_id, w, size, unnest(range(0, greatest(0, CAST(ceil((len(w) - size) / (size / 2)) AS BIGINT)) + 1)) AS b FROM d, (SELECT DISTINCT size FROM t))),
near AS (SELECT doc_id, label, blocks.w, pairs, chain, len(list_intersect(list_distinct(blocks.w), t.s)) / len(t.s) AS c FROM blocks JOIN t USING (size) WHERE len(list_intersect(list_distinct(blocks.w), t.s)) >= need),
found AS (SELECT doc_id, label, c FROM near WHERE len(list_intersect(list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])), pairs)) >= chain),
p(label, words) AS (VALUES {phrases}),
places AS (SELECT doc_id, label, i - 1 AS place FROM (SELECT doc_id, w, label, words, unnest(range(1, len(w) - len(words) + 2)) AS i FROM d, p WHERE len(w) >= len(words) AND list_has_all(w, words))
  WHERE w[i : i + len(words) - 1] = words),
base AS (SELECT doc_id, count(*) AS n_base, min(place) AS first_word, max(place) AS last_word, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY doc_id),
every AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels FROM (SELECT doc_id, label FROM found UNION SELECT doc_id, label FROM places) GROUP BY doc_id),
best AS (SELECT doc_id, max(c) AS c FROM found GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_base, 0) AS BIGINT) AS n_base, CAST(first_word AS BIGINT) AS first_word, CAST(last_word AS BIGINT) AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, CAST(CASE WHEN n_base > 0 THEN 1.0 ELSE coalesce(c, 0) END AS DOUBLE) AS score
FROM d LEFT JOIN base USING (doc_id) LEFT JOIN every USING (doc_id) LEFT JOIN best USING (doc_id)
"""


_CHAT = """
WITH c AS (
  SELECT CAST(conv_id AS BIGINT) AS conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '<|im_end|><|im_start|>assistant ok' UNION ALL SELECT -1, 1, 'assistant', '<|im_end|><|im_start|>assistant ok')
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256
FROM c GROUP BY conv_id
"""

_OP8 = f"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents),
n AS (SELECT min(r) AS node, w, count(*) AS copies, min(doc_id) AS first FROM d WHERE len(w) > 0 GROUP BY w),
grams AS (SELECT DISTINCT node, unnest(CASE WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
  ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i : i + 4], ' ')) END) AS g FROM n),
sizes AS (SELECT node, count(*) AS size FROM grams GROUP BY node),
common AS (SELECT a.node AS a, b.node AS b, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.node < b.node GROUP BY a.node, b.node),
half AS (SELECT a, b FROM common JOIN sizes x ON a = x.node JOIN sizes y ON b = y.node WHERE 5 * c >= 4 * (x.size + y.size - c)),
links AS (SELECT a, b FROM half UNION ALL SELECT b, a FROM half),
reached(a, b) AS (SELECT node, node FROM n UNION SELECT reached.a, links.b FROM reached JOIN links ON reached.b = links.a),
heads AS (SELECT a AS node, min(first) AS head FROM reached JOIN n ON b = node GROUP BY a),
others AS (SELECT a AS node, sum(copies) AS others FROM links JOIN n ON b = node GROUP BY a)
SELECT doc_id, coalesce(head, doc_id) AS class_id, CAST(coalesce(coalesce(others, 0) + copies - 1, 0) AS BIGINT) AS n_links,
  CAST(coalesce(copies, 1) AS BIGINT) AS n_copies, head IS NULL OR head = doc_id AS kept
FROM d LEFT JOIN n ON d.w = n.w LEFT JOIN heads USING (node) LEFT JOIN others USING (node)
"""

_OP12 = """
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, label, embedding::DOUBLE[] AS e FROM embeddings),
ok AS (SELECT r, vec_id, label, e FROM v WHERE label IS NOT NULL AND e IS NOT NULL AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(e, lambda x: x <> 0)) > 0),
links AS (SELECT a.r, b.r AS other, b.vec_id FROM ok a JOIN ok b ON a.label = b.label AND len(a.e) = len(b.e) AND a.r <> b.r AND list_cosine_similarity(a.e, b.e) >= 0.93),
reached(r, other) AS (SELECT r, other FROM links UNION SELECT reached.r, links.other FROM reached JOIN links ON reached.other = links.r),
low AS (SELECT r, min(vec_id) AS least FROM reached JOIN (SELECT r AS other, vec_id FROM v) USING (other) GROUP BY r),
n AS (SELECT r, count(*) AS n_links FROM links GROUP BY r)
SELECT vec_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links, least(vec_id, coalesce(least, vec_id)) AS component_id, vec_id IS NOT DISTINCT FROM least(vec_id, coalesce(least, vec_id)) AS kept
FROM v LEFT JOIN low USING (r) LEFT JOIN n USING (r)
"""

_OP13 = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({LOWER}, '[a-z\x{{80}}-\x{{10FFFF}}]+') AS w FROM documents),
w AS (SELECT r, lang, source, unnest(w) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS total FROM w GROUP BY lang, term HAVING count(DISTINCT r) >= 30),
langs AS (SELECT lang, count(*) AS v, sum(total) AS n FROM kept GROUP BY lang),
c AS (SELECT lang, source, term, count(*) AS c FROM w JOIN kept USING (lang, term) GROUP BY lang, source, term),
g AS (SELECT lang, source, CAST(coalesce(n, 0) AS HUGEINT) AS n FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN (SELECT lang, source, sum(c) AS n FROM c GROUP BY lang, source) USING (lang, source)),
p AS (SELECT lang, source, term, coalesce(c, 0) AS c, CAST(1 + 1000000000::HUGEINT * (coalesce(c, 0) + 5) // (g.n + 5 * v) AS BIGINT) AS p
  FROM g JOIN langs USING (lang) JOIN kept USING (lang) LEFT JOIN c USING (lang, source, term)),
q AS (SELECT lang, term, CAST(1 + 1000000000::HUGEINT * (total + 5) // (n + 5 * v) AS BIGINT) AS q FROM kept JOIN langs USING (lang)),
far AS (SELECT a.lang, a.source, b.source AS item, CAST(sum(abs(a.p - b.p)) AS BIGINT) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN far ON far.lang = a.lang AND far.source = a.source AND far.item = b.source),
terms AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM p JOIN q USING (lang, term) WHERE c > 0 AND p > q),
ranked AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM terms))
SELECT lang, source, part, item, value, rank FROM ranked WHERE part = 'pair' OR rank <= 50
"""

ORACLES: dict[str, str] = {"op3_decontaminate": _OP3, "op5_licenses": _op5(), "op8_jaccard_join": _OP8, "chat_digests": _CHAT, "op12_range_join": _OP12, "op13_divergence": _OP13}
