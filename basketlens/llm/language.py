"""Language identification by Bayesian evidence fusion (operator 10).

Four kinds of evidence are multiplied: the text under a letter-trigram model
of each language, the language that the markup declares, the suffix of the
address, and a prior of the host. The last three are learnt from the pages
themselves by grouped aggregation of the text's posteriors: P(declared |
language) and P(suffix | language) with smoothing, and P(language | host)
smoothed towards its domain and that towards all pages. A page's own share is
taken out of its host's and domain's counts, so its text isn't counted twice.

A language "other" (all trigrams alike, small prior) takes texts that fit no
model. The trigram model is counted over every labelled document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from basketlens.llm import tokens as T
from basketlens.llm.common import broadcast_if_small, cut, numpy_columns

LANGUAGES = ("de", "en", "es", "fr")      # where none are counted; see ``labelled_languages``
MIN_ROWS, MIN_SHARE = 10, 0.005           # labelled rows of a language that gets a model, at least
NOT_LANGUAGES = ("mis", "mul", "und", "zxx")   # codes for unknown, several and no languages
BUCKETS = 1 << 16
OTHER_PRIOR = 1e-4
SMOOTHING = 0.5          # added to each trigram count
MOST_TRIGRAMS = 120      # a long text's evidence is scaled to this many trigrams: they depend on each other
STRENGTH = 5.0           # pages that a level's parent weighs
MAX_BROADCAST_KEYS = 20_000
PIECE = 1 << 20          # bytes scored at a time
KEYS = ("declared", "suffix", "domain", "host")
RESULTS = {"grams", "fit", "post", "text_language", "language", "posterior", "rejected", *(f"{key}_n" for key in KEYS)}


def trigrams(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, counts) of the trigram that ends at each byte: letters lower-cased, other bytes blank; it counts if its
    middle byte is a letter."""
    low = T.lower_bytes(raw)
    letter = (low - np.uint8(97) < 26) | (low >= 128)
    low = np.where(letter, low, np.uint8(32)).astype(np.uint32)
    code = np.zeros(len(raw), np.uint32)
    use = np.zeros(len(raw), bool)
    if len(raw) > 2:
        code[2:] = ((low[:-2] << 16 | low[1:-1] << 8 | low[2:]) * np.uint32(2654435761)) >> np.uint32(16)
        use[2:] = letter[1:-1]
    return code, use


def _pieces(texts: pa.Array):
    """(row, bytes) for each piece of each text, with a blank on both sides; pieces of a text overlap by two bytes."""
    raw, offsets = T.text_bytes(texts)
    blank = np.full(1, 32, np.uint8)
    a = 0
    while a < len(texts):                      # several short texts at a time
        b = int(np.searchsorted(offsets, offsets[a] + PIECE, "right")) - 1
        if b <= a:
            text = np.concatenate([blank, raw[offsets[a]: offsets[a + 1]], blank])
            for k in range(0, max(1, len(text) - 2), PIECE):
                part = text[k: k + PIECE + 2]
                yield np.full(len(part), a), part, a, a + 1
            a += 1
            continue
        sizes = np.diff(offsets[a: b + 1]) + 2
        rows = np.repeat(np.arange(a, b), sizes)
        part = np.full(int(sizes.sum()), 32, np.uint8)
        at = np.arange(offsets[a], offsets[b]) - offsets[a] + 2 * np.repeat(np.arange(b - a), sizes - 2) + 1
        part[at] = raw[offsets[a]: offsets[b]]
        yield rows, part, a, b
        a = b


def labelled_languages(docs: DataFrame, min_rows: int = MIN_ROWS, min_share: float = MIN_SHARE) -> tuple[str, ...]:
    """The languages that ``docs(lang)`` labels, sorted: two- or three-letter codes (in any case, blanks around) of
    ``min_rows`` rows and of a share ``min_share`` of the labelled rows, at least; so 1 / min_share of them at most.

    Counted over every row. Null, empty and other labels count for nothing; an empty table has none.
    """
    label = F.lower(F.trim(F.col("lang").cast("string")))
    counts = docs.groupBy(label.alias("label")).count().where(F.col("label").rlike("^[a-z]{2,3}$") & ~F.col("label").isin(*NOT_LANGUAGES))
    counts = cut(counts)
    total = counts.agg(F.sum("count")).first()[0] or 0
    rows = counts.where(F.col("count") >= max(min_rows, min_share * total)).collect()
    return tuple(sorted(r.label for r in rows))


def _counter(languages):
    def count(batches):
        total = np.zeros(len(languages) * BUCKETS, np.int64)
        index = {x: i for i, x in enumerate(languages)}
        for batch in batches:
            label = np.array([index.get(x, -1) for x in batch.column("lang").to_pylist()], np.int64)
            for rows, part, _, _ in _pieces(batch.column("text")):
                code, use = trigrams(part)
                use &= label[rows] >= 0
                total += np.bincount(label[rows[use]] * BUCKETS + code[use], minlength=len(total))
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], names=["cell", "n"])
    return count


def train(docs: DataFrame, languages=LANGUAGES) -> np.ndarray:
    """Log probability of each trigram bucket under each language and "other", from every row of ``docs(text, lang)``
    whose lang, without case and blanks around, is one of ``languages``. The result's size is that of the languages,
    whatever the table's."""
    cells = (docs.select(F.col("text").cast("string").alias("text"), F.lower(F.trim(F.col("lang").cast("string"))).alias("lang"))
             .where(F.col("lang").isin(list(languages)))
             .mapInArrow(_counter(languages), "cell int, n long").groupBy("cell").agg(F.sum("n").alias("n")))
    cells = numpy_columns(cells)
    counts = np.zeros(len(languages) * BUCKETS)
    counts[cells["cell"]] = cells["n"]
    counts = counts.reshape(len(languages), BUCKETS) + SMOOTHING
    table = np.log(counts / counts.sum(1, keepdims=True))
    return np.vstack([table, np.full((1, BUCKETS), -np.log(BUCKETS))]).astype(np.float32)


def _scorer(model: np.ndarray):
    kinds = len(model)
    prior = np.full(kinds, np.log((1 - OTHER_PRIOR) / max(kinds - 1, 1)))
    prior[-1] = np.log(OTHER_PRIOR)

    def score(batches):
        for batch in batches:
            n = batch.num_rows
            fit, grams = np.zeros((n, kinds)), np.zeros(n, np.int64)
            for rows, part, a, b in _pieces(batch.column("body")):
                code, use = trigrams(part)
                code, rows = code[use], rows[use] - a
                grams[a:b] += np.bincount(rows, minlength=b - a)
                for k in range(kinds):
                    fit[a:b, k] += np.bincount(rows, weights=model[k].take(code), minlength=b - a)
            fit *= np.minimum(1.0, MOST_TRIGRAMS / np.maximum(grams, 1))[:, None]
            post = fit + prior
            post = np.exp(post - post.max(1, keepdims=True))
            post /= post.sum(1, keepdims=True)
            ends = pa.array(np.arange(0, (n + 1) * kinds, kinds, dtype=np.int32))
            cols = {c: batch.column(c) for c in batch.schema.names if c != "body"}
            cols |= {"grams": pa.array(grams), "fit": pa.ListArray.from_arrays(ends, pa.array(fit.ravel())),
                     "post": pa.ListArray.from_arrays(ends, pa.array(post.ravel()))}
            yield pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))
    return score


def _sums(df: DataFrame, key: str, kinds: int) -> DataFrame:
    """A row per value of key: ``<key>_n``, the array of summed posteriors. Combined before the shuffle; blank keys have none."""
    return df.where(F.col(key) != "").groupBy(key).agg(*[F.sum(F.col("post")[k]).alias(f"s{k}") for k in range(kinds)]).select(
        key, F.array(*[f"s{k}" for k in range(kinds)]).alias(f"{key}_n"))


def _fuser(names: list[str], totals: np.ndarray, min_posterior: float, kept: list[str]):
    kinds = len(names)
    overall = (totals + np.append(np.full(kinds - 1, (1 - OTHER_PRIOR) / max(kinds - 1, 1)), OTHER_PRIOR)) / (totals.sum() + 1.0)
    labels = np.array([*names, "und"], dtype=object)

    def matrix(column: pa.Array) -> np.ndarray:
        out = np.zeros((len(column), kinds))
        out[column.is_valid().to_numpy(zero_copy_only=False)] = column.flatten().to_numpy().reshape(-1, kinds)
        return out

    def fuse_batch(batches):
        for batch in batches:
            post, total = matrix(batch.column("post")), matrix(batch.column("fit"))
            own = {key: np.maximum(matrix(batch.column(f"{key}_n")) - post, 0.0) for key in KEYS}        # posteriors of the key's other pages
            for key in KEYS:
                own[key][batch.column(f"{key}_n").is_null().to_numpy(zero_copy_only=False)] = 0.0
            among = {key: x.sum(1, keepdims=True) for key, x in own.items()}
            for key in ("declared", "suffix"):                       # P(value | language), smoothed towards P(value)
                share = np.maximum(among[key] / max(totals.sum() - 1.0, 1.0), 1e-9)
                seen = (own[key] + STRENGTH * share) / (totals + STRENGTH)
                total = total + np.where(among[key] > 0, np.log(seen), 0.0)
            domain = (own["domain"] + STRENGTH * overall) / (among["domain"] + STRENGTH)
            host = (own["host"] + STRENGTH * domain) / (among["host"] + STRENGTH)
            total = total + np.log(host)
            best = total.argmax(1)
            sure = 1.0 / np.exp(total - total.max(1, keepdims=True)).sum(1)
            none = batch.column("grams").to_numpy() == 0
            rejected = none | (best == kinds - 1) | (sure < min_posterior)
            text = np.where(none, kinds, post.argmax(1))
            yield pa.RecordBatch.from_arrays(
                [*[batch.column(c) for c in kept], pa.array(labels[text], pa.string()), pa.array(labels[np.where(none, kinds, best)], pa.string()),
                 pa.array(np.where(none, 0.0, sure)), pa.array(rejected)], names=[*kept, "text_language", "language", "posterior", "rejected"])
    return fuse_batch


def fuse(scored: DataFrame, languages=LANGUAGES, min_posterior: float = 0.5) -> DataFrame:
    """Adds text_language, language, posterior and rejected to the scored rows (see ``identify``)."""
    names = [*languages, "other"]
    kinds = len(names)
    totals = np.array(scored.agg(*[F.coalesce(F.sum(F.col("post")[k]), F.lit(0.0)) for k in range(kinds)]).first(), np.float64)
    out = scored
    for key in KEYS:
        out = out.join(broadcast_if_small(cut(_sums(scored, key, kinds)), MAX_BROADCAST_KEYS), key, "left")
    kept = [c for c in scored.columns if c not in ("fit", "post")]
    schema = ", ".join([f"`{c}` {t}" for c, t in scored.dtypes if c in kept] + ["text_language string", "language string", "posterior double", "rejected boolean"])
    return out.select(*scored.columns, *[f"{key}_n" for key in KEYS]).mapInArrow(_fuser(names, totals, min_posterior, kept), schema)


def identify(rows: DataFrame, model: np.ndarray, languages=LANGUAGES, min_posterior: float = 0.5) -> DataFrame:
    """Language of each row of ``rows``: columns body, declared, suffix, domain and host, and any that name the row.

    Returns all columns but body, with grams (letter trigrams), text_language
    (of the text alone), language, posterior and rejected (posterior below
    ``min_posterior``, language "other", or a text without letters, whose
    language is "und" and posterior 0). Ties go to the language first in order.
    Nulls in any of the five columns are empty; an empty one is no evidence.
    Rows that repeat are rows of their own. An empty table stays empty. Columns
    of the rows that bear a result's name raise ValueError.
    """
    evidence = ("body", "declared", "suffix", "domain", "host")
    names = [c for c in rows.columns if c not in evidence]
    clash = sorted({c.lower() for c in names} & RESULTS)
    if clash:
        raise ValueError(f"columns bear names of results: {clash}")
    rows = rows.select(*names, *[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in evidence])
    schema = ", ".join([f"`{c}` {t}" for c, t in rows.dtypes if c != "body"] + ["grams long", "fit array<double>", "post array<double>"])
    scored = cut(rows.mapInArrow(_scorer(model), schema))
    return fuse(scored, languages, min_posterior)


def page_evidence(pages: DataFrame) -> DataFrame:
    """page_id and the five evidence columns of ``pages(page_id, url, html)``.

    body: the html without scripts, styles, comments, navigation and tags;
    declared: primary tag of the html element's lang; host: of the address,
    lower-cased, without "www." and port; domain: its last two labels; suffix:
    its last label with a two-letter first folder of the path, as in "com/fr".
    """
    html, url = F.coalesce(F.col("html").cast("string"), F.lit("")), F.coalesce(F.col("url").cast("string"), F.lit(""))
    text = F.regexp_replace(html, r"(?is)<(script|style|nav|noscript)\b.*?</\1\s*>|<!--.*?-->", " ")
    text = F.regexp_replace(F.regexp_replace(text, r"(?s)<[^>]*>", " "), r"&[#\w]{1,12};", " ")
    declared = F.lower(F.regexp_extract(html, r"(?i)<html\b[^>]*?\blang\s*=\s*[\"']?([A-Za-z]{2,3})", 1))
    host = F.regexp_replace(F.lower(F.regexp_extract(url, r"^[A-Za-z][\w+.-]*://(?:[^/?#@]*@)?([^/?#:]+)", 1)), r"^www\.", "")
    labels = F.split(host, r"\.")
    folder = F.lower(F.regexp_extract(url, r"^[A-Za-z][\w+.-]*://[^/?#]*/([A-Za-z]{2})(?:[/?#]|$)", 1))
    suffix = F.when(host == "", F.lit("")).otherwise(F.concat(F.element_at(labels, -1), F.when(folder != "", F.concat(F.lit("/"), folder)).otherwise(F.lit(""))))
    return pages.select("page_id", text.alias("body"), declared.alias("declared"), suffix.alias("suffix"),
                        F.when(F.size(labels) >= 2, F.array_join(F.slice(labels, -2, 2), ".")).otherwise(host).alias("domain"), host.alias("host"))


def document_evidence(docs: DataFrame, *names) -> DataFrame:
    """Evidence of documents: lang is the declared language and source the host; there is no address."""
    return docs.select(*names, F.col("text").alias("body"), F.lower(F.trim(F.col("lang").cast("string"))).alias("declared"), F.lit("").alias("suffix"),
                       F.lit("").alias("domain"), F.col("source").cast("string").alias("host"))
