import numpy as np
import pytest

from basketlens.llm.language import document_evidence, fuse, identify, labelled_languages, page_evidence, train
from helpers import documents

PARTS = {"de": "schicht und der die ungen heit keit", "en": "the ing and tion of er with", "es": "cion ado que los mente ez la", "fr": "eau que les ment tre oi est"}


def text(rng, lang, n):
    p = PARTS[lang].split()
    return " ".join("".join(p[int(k)] for k in rng.integers(0, len(p), int(rng.integers(1, 4)))) for _ in range(n))


@pytest.fixture(scope="module")
def model(spark):
    rng = np.random.default_rng(14)
    rows = [(i, text(rng, lang, 60), lang) for i, lang in enumerate(list(PARTS) * 40)] + [(999, None, "en"), (998, "x", None), (997, "y", "xx")]
    return train(spark.createDataFrame(rows, "doc_id long, text string, lang string"))


def page(i, url, html):
    return (i, url, html, 1, "x", 2.0)


PAGES = "page_id long, url string, html string, grams int, host string, best double"


def test_held_out_texts_and_evidence(spark, model):
    rng = np.random.default_rng(15)
    rows, want = [], {}
    for i in range(200):
        lang = list(PARTS)[int(rng.integers(0, 4))]
        body = text(rng, lang, 40)
        rows.append(page(i, f"https://www.{lang}-site{i % 5}.example.{lang}/{lang}/{i}", f'<html lang="{lang}-XX"><script>der die und</script><nav>the of and</nav><p>{body}</p></html>'))
        want[i] = lang
    # texts too short to tell, on hosts that tell
    for i in range(200, 220):
        lang = list(PARTS)[i % 4]
        rows.append(page(i, f"http://{lang}-site{i % 5}.example.{lang}/{lang}/x", f"<html lang='{lang}'><body>a</body>"))
        want[i] = lang
    got = {r.page_id: r for r in identify(page_evidence(spark.createDataFrame(rows, PAGES)), model).collect()}
    assert np.mean([got[i].language == lang for i, lang in want.items()]) > 0.97
    assert got[0].host == f"{want[0]}-site0.example.{want[0]}" and got[0].domain == f"example.{want[0]}" and got[0].suffix == f"{want[0]}/{want[0]}"
    assert not any(got[i].rejected for i in range(200))


def test_rejections_nulls_and_empty_tables(spark, model):
    rng = np.random.default_rng(16)
    junk = " ".join("".join(chr(97 + int(c)) for c in rng.integers(0, 26, 9)) for _ in range(60))
    rows = [page(0, None, None), page(1, "", ""), page(2, "http://h/", "<p>12 34 !!</p>"), page(3, "not a url", f"<p>{junk}</p>"), page(4, "https://u@H.Example.COM:80/de?x", "<p>" + text(rng, "de", 50)),
            page(None, "http://a.b", "<p>" + text(rng, "fr", 50)), page(5, "http://a.b", "<p>" + text(rng, "en", 60000)), page(5, "http://a.b", "<p>" + text(rng, "en", 5))]
    got = identify(page_evidence(spark.createDataFrame(rows, PAGES)), model).collect()
    by = {r.page_id: r for r in got}
    assert len(got) == len(rows)
    for i in (0, 1, 2):
        assert (by[i].language, by[i].posterior, by[i].rejected) == ("und", 0.0, True)
    assert by[3].rejected and by[3].language == "other"
    assert (by[4].language, by[4].host, by[4].suffix) == ("de", "h.example.com", "com/de") and by[None].language == "fr" and not by[5].rejected
    assert identify(page_evidence(spark.createDataFrame([], PAGES)), model).count() == 0
    assert train(spark.createDataFrame([], "text string, lang string")).shape == model.shape


def test_same_result_by_shuffle_joins(spark, model, monkeypatch):
    import basketlens.llm.language as L
    rng = np.random.default_rng(17)
    rows = [(i, text(rng, list(PARTS)[i % 4], 20)) for i in range(40)]
    docs = documents(spark, rows)
    few = sorted((r.doc_id, r.language, round(r.posterior, 9)) for r in identify(document_evidence(docs, "doc_id"), model).collect())
    monkeypatch.setattr(L, "MAX_BROADCAST_KEYS", 0)
    assert few == sorted((r.doc_id, r.language, round(r.posterior, 9)) for r in identify(document_evidence(docs, "doc_id"), model).collect())


def test_languages_of_the_labels(spark):
    rows = [(i, "x", lang) for lang, n in (("it", 30), ("EN ", 12), ("en", 3), ("pt", 9), ("und", 50), ("", 50), ("english", 50), (None, 50)) for i in range(n)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    assert labelled_languages(docs) == ("en", "it") and labelled_languages(docs, 1) == ("en", "it", "pt") and labelled_languages(docs, 1, 0.25) == ("en", "it")
    assert labelled_languages(docs.limit(0)) == ()
    unlabelled = docs.where("lang is null").selectExpr("*", "'s' as source")
    none = identify(document_evidence(unlabelled, "doc_id"), train(docs, ()), ()).collect()
    assert len(none) == 50 and all(r.rejected for r in none)


def test_clashing_names_are_refused(spark, model):
    docs = documents(spark, [(1, "der die")])
    for name in ("grams", "Post", "host_n", "language"):
        with pytest.raises(ValueError, match=name.lower()):
            identify(document_evidence(docs.withColumnRenamed("doc_id", name), name), model)


def plain_fusion(rows, kinds, min_posterior):
    """What ``fuse`` must give, a row at a time: (best or None without letters, posterior, rejected)."""
    prior = [0.9999 / (kinds - 1)] * (kinds - 1) + [0.0001]
    totals = [sum(r["post"][k] for r in rows) for k in range(kinds)]
    overall = [(totals[k] + prior[k]) / (sum(totals) + 1) for k in range(kinds)]
    out = {}
    for r in rows:
        def others(key):
            same = [x for x in rows if x[key] == r[key] and r[key]]
            return [max(sum(x["post"][k] for x in same) - r["post"][k], 0.0) if same else 0.0 for k in range(kinds)]
        score = list(r["fit"])
        for key in ("declared", "suffix"):
            n = others(key)
            share = max(sum(n) / max(sum(totals) - 1, 1), 1e-9)
            if sum(n) > 0:
                score = [score[k] + np.log((n[k] + 5 * share) / (totals[k] + 5)) for k in range(kinds)]
        d, h = others("domain"), others("host")
        domain = [(d[k] + 5 * overall[k]) / (sum(d) + 5) for k in range(kinds)]
        score = [score[k] + np.log((h[k] + 5 * domain[k]) / (sum(h) + 5)) for k in range(kinds)]
        best = int(np.argmax(score))
        sure = 1 / sum(np.exp(x - max(score)) for x in score)
        out[r["id"]] = ("und", 0.0, True) if not r["grams"] else (best, sure, best == kinds - 1 or sure < min_posterior)
    return out


def test_fusion_by_plain_python(spark):
    rng = np.random.default_rng(18)
    names, rows = ["aa", "bb", "cc"], []
    for i in range(120):
        post = rng.dirichlet([0.5] * 4)
        host = ["", "h1", "h2", "h3", "h4"][int(rng.integers(0, 5))]
        rows.append({"id": i, "declared": ["", "aa", "bb", "zz"][int(rng.integers(0, 4))], "suffix": ["", "com", f"only{i}"][int(rng.integers(0, 3))],
                     "domain": {"h1": "d1", "h2": "d1", "h3": "d2"}.get(host, ""), "host": host, "grams": int(rng.integers(0, 4)),
                     "fit": [float(x) for x in rng.normal(-20, 2, 4)], "post": [float(x) for x in post]})
    schema = "id long, declared string, suffix string, domain string, host string, grams long, fit array<double>, post array<double>"
    scored = spark.createDataFrame([tuple(r[c.split()[0]] for c in schema.split(", ")) for r in rows], schema)
    want = plain_fusion(rows, 4, 0.5)
    got = fuse(scored, names, 0.5).collect()
    assert len(got) == 120 and {r.rejected for r in got} == {True, False}
    for r in got:
        best, sure, rejected = want[r.id]
        assert (r.language, r.rejected) == (best if best == "und" else [*names, "other"][best], rejected) and abs(r.posterior - sure) < 1e-9
