"""Line dedup with a log-template tree (operator 2), DataFrame functions only.

Every line of ``min_tokens`` tokens or more is parsed down a tree of fixed
depth: its token count, then its first ``depth`` tokens (fewer in lines of
``field_tokens`` to six tokens, so that four are left behind them). Tokens with
digits are fields (``<*>``) from the start. Lines that reach one leaf with the
same tokens are one sequence. From ``field_tokens`` tokens on, the tokens
behind the leading ones form eight nearly equal segments (fewer than eight
tokens: one each). Sequences of a leaf that are equal but for two segments (one
token, where there are fewer than eight) are one template, and what differs is
its fields; a sequence may belong to several templates.

A template recurs if enough documents hold it: two for lines of ``long_tokens``
tokens or more, else ``min_docs`` and the share ``min_share`` of all documents,
halved with each further token, because a short line meets its like by chance
and the more so the larger the corpus is. Fields without digits also ask
``min_members`` different sequences. All lines of recurring templates are
dropped, and other lines stay as they are.

Leaves and lines are shuffled as 64-bit hashes and combined before the
shuffle, so a line that a third of all documents hold is a few rows. Only
leaves with several sequences are read as tokens again, and a sequence has at
most 28 templates, so the work grows with the lines. The text itself is
shuffled once, to meet the places of its dropped lines.
"""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from basketlens.llm.common import broadcast_if_small, cut, once, text_key

FIELD = "<*>"
MAX_BROADCAST_LEAVES = 200_000
SEGMENTS = 8


def _lines(docs: DataFrame) -> DataFrame:
    """doc_id, text_key, pos, tokens for each line that is not blank."""
    masked = F.when(F.col("line").rlike(r"\d"), F.regexp_replace("line", r"[^\s\d]*\d\S*", FIELD)).otherwise(F.col("line"))
    split = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_key(F.col("text")).alias("text_key"), F.posexplode(F.split(F.col("text").cast("string"), "\n")).alias("pos", "line"))
    return once(split, tokens=F.array_remove(F.split(masked, r"\s+"), "")).drop("line")


def _parsed(docs: DataFrame, depth: int, min_tokens: int, field_tokens: int) -> DataFrame:
    """Lines with their number of leading tokens, their leaf and the two hashes of their token sequence."""
    rows = _lines(docs).where(F.size("tokens") >= max(min_tokens, 1)).withColumn("n", F.size("tokens"))
    lead = F.when(F.col("n") >= field_tokens, F.least(F.lit(depth), F.greatest(F.col("n") - 4, F.lit(1)))).otherwise(F.least(F.lit(depth), F.col("n")))
    return rows.select("doc_id", "text_key", "pos", "tokens", "n", lead.alias("lead"), F.xxhash64("n", F.slice("tokens", F.lit(1), lead)).alias("leaf"),
                       F.xxhash64("tokens").alias("a"), F.xxhash64(F.lit(1), "tokens").alias("b"))


def _masks(several: DataFrame) -> DataFrame:
    """key (hash of all but the masked segments of a sequence), a, b, n, need, docs, own for every template of a sequence."""
    m = F.col("n") - F.col("lead")

    def segment(k: int) -> Column:
        start = F.when(m >= SEGMENTS, F.floor(m * k / SEGMENTS)).otherwise(F.lit(k)).cast("int")
        end = F.when(m >= SEGMENTS, F.floor(m * (k + 1) / SEGMENTS)).otherwise(F.lit(k + 1)).cast("int")
        return F.when(m > k, F.xxhash64(F.slice("tokens", F.col("lead") + 1 + start, end - start)))

    rows = once(several, **{f"h{k}": segment(k) for k in range(SEGMENTS)})

    def key(*masked: int) -> Column:
        return F.xxhash64("leaf", *[F.lit(k) for k in masked], *[F.col(f"h{k}") for k in range(SEGMENTS) if k not in masked])

    two = F.array(*[key(i, j) for i, j in combinations(range(SEGMENTS), 2)])
    one = F.slice(F.array(*[key(k) for k in range(SEGMENTS - 1)]), F.lit(1), m)
    return rows.select("a", "b", "n", "need", "docs", "own", F.explode(F.when(m >= SEGMENTS, two).otherwise(one)).alias("key"))


def _recurring(docs: DataFrame, depth: int, min_tokens: int, field_tokens: int, min_docs: int, min_share: float, long_tokens: int, min_members: int):
    """(lines, exact, several, entries, good): places of lines; sequences with their documents; those of leaves with several, with
    their tokens; their places (key, a, b) in templates that may recur; the templates that do, with their number k of sequences."""
    lines = cut(_parsed(docs, depth, min_tokens, field_tokens).select("doc_id", "text_key", "pos", "n", "leaf", "a", "b"))
    who = F.xxhash64("doc_id", "text_key").alias("who")
    share = min_share * docs.count()
    need = F.when(F.col("n") >= long_tokens, F.lit(2)).otherwise(F.greatest(F.lit(min_docs), F.ceil(F.lit(float(share)) * F.pow(F.lit(2.0), 1 - F.col("n"))))).cast("long")
    held = lines.groupBy("leaf", "a", "b", who).agg(F.min("n").alias("n"))
    exact = held.groupBy("leaf", "a", "b").agg(F.min("n").alias("n"), F.count(F.lit(1)).alias("docs"))
    exact = cut(exact.withColumn("need", need).withColumn("own", F.col("docs") >= F.col("need")))
    may = (F.col("k") >= min_members) & (F.col("total") >= F.col("need")) & F.col("weak")
    some = [F.count(F.lit(1)).alias("k"), F.sum("docs").alias("total"), F.min("need").alias("need"), F.bool_or(~F.col("own")).alias("weak"), F.bool_or("own").alias("strong")]
    leaves = exact.where((F.col("n") >= field_tokens) & (F.col("n") > 4)).groupBy("leaf").agg(*some).where(may).select("leaf")
    leaves = broadcast_if_small(cut(leaves), MAX_BROADCAST_LEAVES)
    several = _parsed(docs, depth, min_tokens, field_tokens).select("leaf", "a", "b", "tokens", "lead").join(leaves, "leaf", "left_semi").groupBy("leaf", "a", "b").agg(F.any_value("tokens").alias("tokens"), F.any_value("lead").alias("lead"))
    several = cut(several.join(exact, ["leaf", "a", "b"]))
    masks = _masks(several)
    keys = cut(masks.groupBy("key").agg(*some).where(may).select("key", "k", "strong"))
    entries = cut(masks.join(broadcast_if_small(keys, MAX_BROADCAST_LEAVES), "key"))
    # Where no sequence alone is in enough documents, each is in few, and the documents of all are counted.
    unsure = entries.where("not strong").select("key", "k", "need", "a", "b")
    counted = unsure.join(lines.select("a", "b", who).distinct(), ["a", "b"]).groupBy("key", "who").agg(F.min("k").alias("k"), F.min("need").alias("need"))
    counted = counted.groupBy("key").agg(F.min("k").alias("k"), F.min("need").alias("need"), F.count(F.lit(1)).alias("docs")).where("docs >= need")
    good = cut(keys.where("strong").select("key", "k").unionByName(counted.select("key", "k")))
    return lines, exact, several, entries, good


def _found(exact: DataFrame, entries: DataFrame, good: DataFrame) -> DataFrame:
    """leaf, a, b, own, linked (null or true) for every distinct sequence."""
    linked = entries.join(good.select("key"), "key", "left_semi").select("a", "b").distinct().withColumn("linked", F.lit(True))
    return exact.select("leaf", "a", "b", "own").join(linked, ["a", "b"], "left")


def templates(docs: DataFrame, depth: int = 3, min_tokens: int = 5, field_tokens: int = 5, min_docs: int = 5, min_share: float = 0.001, long_tokens: int = 20,
              min_members: int = 3) -> tuple[DataFrame, DataFrame]:
    """(lines, found). lines: doc_id, text_key, pos, n, leaf, a, b of each parsed line. found: leaf, a, b, template (the
    tokens that all sequences of its largest recurring template share, fields elsewhere; null for a sequence that has none),
    recurs, a row per distinct sequence."""
    lines, exact, several, entries, good = _recurring(docs, depth, min_tokens, field_tokens, min_docs, min_share, long_tokens, min_members)
    members = entries.select("key", "a", "b").join(good, "key")
    mine = members.groupBy("a", "b").agg(F.max(F.struct("k", "key")).alias("s")).select("a", "b", F.col("s.key").alias("key"))
    common = members.join(mine.select("key").distinct(), "key", "left_semi").join(several.select("a", "b", "tokens"), ["a", "b"])
    common = common.select("key", F.posexplode("tokens").alias("at", "token")).groupBy("key", "at").agg(F.min("token").alias("p"), F.max("token").alias("q"))
    common = common.groupBy("key").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "p", "q"))), lambda x: F.when(x["p"] == x["q"], x["p"]).otherwise(FIELD)).alias("template"))
    named = mine.join(common, "key").select("a", "b", "template")
    found = _found(exact, entries, good).join(named, ["a", "b"], "left")
    return lines, found.select("leaf", "a", "b", "template", F.coalesce("linked", "own").alias("recurs"))


def drop_recurring(docs: DataFrame, depth: int = 3, min_tokens: int = 5, field_tokens: int = 5, min_docs: int = 5, min_share: float = 0.001, long_tokens: int = 20,
                   min_members: int = 3) -> DataFrame:
    """doc_id, text (without the lines of recurring templates), n_lines and n_dropped, a row per row of ``docs(doc_id, text)``.

    Lines are separated by line feeds and joined by them again; blank lines
    and lines of fewer than ``min_tokens`` tokens stay. A null text stays null
    with no lines; an empty one has one (blank) line. Documents are rows of
    different doc_id or text: rows that repeat are one document, get equal
    results and make no template recur by themselves. A null doc_id is a value
    as any other; an empty table gives an empty result. Other columns are not read.
    """
    lines, exact, _, entries, good = _recurring(docs, depth, min_tokens, field_tokens, min_docs, min_share, long_tokens, min_members)
    gone = _found(exact, entries, good).where("own or linked").select("leaf", "a", "b")
    places = lines.join(gone, ["leaf", "a", "b"], "left_semi").groupBy(F.col("doc_id").alias("id"), F.col("text_key").alias("key")).agg(F.collect_set("pos").alias("gone"))
    base = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), text_key(F.col("text")).alias("text_key"))
    out = base.join(places, base["doc_id"].eqNullSafe(places["id"]) & (base["text_key"] == places["key"]), "left")
    split = F.split("text", "\n")
    out = once(out, rows=F.when(F.col("text").isNull() | F.col("gone").isNull(), F.lit(None)).otherwise(split))
    kept = F.transform(F.array_except(F.sequence(F.lit(0), F.size("rows") - 1), F.col("gone")), lambda i: F.get("rows", i))
    n_lines = F.when(F.col("text").isNull(), 0).otherwise(F.length("text") - F.length(F.replace("text", F.lit("\n"), F.lit(""))) + 1)
    return out.select("doc_id", F.when(F.col("rows").isNull(), F.col("text")).otherwise(F.array_join(kept, "\n")).alias("text"),
                      n_lines.cast("long").alias("n_lines"), F.when(F.col("gone").isNull(), 0).otherwise(F.size("gone")).cast("long").alias("n_dropped"))
