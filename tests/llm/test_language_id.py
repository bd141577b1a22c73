import random

import pytest
from pyspark.sql import functions as F

from logloom.llm import language_id as li

SYLLABLES = {"en": "th er on an re he in ed nd ha".split(), "fr": "é ou eau que ent la des aux eu".split(),
             "de": "sch ung ei ch ü der ver en keit".split()}


def text(lang, n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choices(SYLLABLES[lang], k=r.randint(1, 4))) for _ in range(n))


@pytest.fixture(scope="module")
def rows():
    langs = list(SYLLABLES)
    return [(k, text(langs[k % 3], 3 + k % 40, k), langs[k % 3], f"host-{langs[k % 3]}{k % 2}") for k in range(300)]


def found(docs):
    return {r.doc_id: r for r in li.identified_documents(docs).collect()}


def test_held_out_accuracy(make_docs, rows):
    """Two of seven texts come without its language and host."""
    blind = [(i, t, None, None) if i % 7 < 2 else (i, t, la, s) for i, t, la, s in rows]
    got = found(make_docs(blind))
    right = [got[i].language == la for i, t, la, s in rows if i % 7 < 2]
    assert sum(right) / len(right) > 0.97
    assert all(r.kept for r in got.values() if r.posterior >= li.ACCEPT)


def test_evidence_is_fused(make_docs, rows):
    unsure = [(1000, "zz", None, "host-fr0"), (1001, "zz", None, "host-de1"), (1002, "zz", "fr", None),
              (1003, text("de", 60, 5), "en", "host-en0")]
    got = found(make_docs(rows + unsure))
    assert [got[k].language for k in (1000, 1001, 1002, 1003)] == ["fr", "de", "fr", "de"]


def test_pages(spark):
    html = "<!DOCTYPE html><html class='x' lang=\"{}\"><p>{}</p></html>"
    pages = [(k, f"https://a{k % 4}.site.{'fr' if k % 2 else 'com'}/x", html.format("fr" if k % 2 else "en-GB", text("fr" if k % 2 else "en", 30, k)))
             for k in range(80)]
    df = spark.createDataFrame(pages + [(99, None, None)], "page_id long, url string, html string")
    ready = li.page_evidence(df)
    row = ready.where("page_id = 1").first()
    assert (row._declared, row._suffix, row._host) == ("fr", "fr", "a1.site.fr")
    got = {r.page_id: r._language for r in li.identify(ready).collect()}
    assert all(got[k] == ("fr" if k % 2 else "en") for k in range(80)) and 99 in got


def test_odd_rows(clashing, odd_rows, no_docs, make_docs):
    got = li.identified_documents(clashing).collect()
    assert len(got) == len(odd_rows)
    assert not any(r.kept for r in got if r.doc_id in (1, 2, 3))
    kept = li.accepted(clashing)
    assert kept.columns == clashing.columns and kept.count() == sum(r.kept for r in got)
    assert li.identified_documents(no_docs).count() == 0
    nothing = li.identified_documents(make_docs([(1, "text")]).withColumn("lang", F.lit(None).cast("string")))
    assert [tuple(r) for r in nothing.collect()] == [(1, None, None, None, False)]


def letters(k, n, seed):
    """Text of the k-th of many languages, each with letters of its own."""
    r = random.Random(f"letters {k}")
    sound = ["".join(r.choices("abcdefghijklmnopqrstuvwxyz", k=3)) for _ in range(8)]
    r = random.Random(seed)
    return " ".join("".join(r.choices(sound, k=r.randint(1, 3))) for _ in range(n))


def test_small_languages_are_modelled(make_docs):
    """Six rows of 2,406 declare a language; its texts, two of them undeclared, keep it."""
    langs = list(SYLLABLES)
    docs = [(k, text(langs[k % 3], 12, k), langs[k % 3], "hot") for k in range(2400)]
    small = [(5000 + k, letters(0, 30, k), "sm" if k < 6 else None, "hot") for k in range(8)]
    got = found(make_docs(docs + small))
    assert [(got[5000 + k].language, got[5000 + k].kept) for k in range(8)] == [("sm", True)] * 8
    assert all(got[k].language == langs[k % 3] for k in range(2400))


def test_many_languages(make_docs):
    """With 220 equal languages each has less than a two-hundredth of the rows."""
    docs = [(k, letters(k % 220, 30, k), f"l{k % 220:03}", None) for k in range(880)]
    got = found(make_docs(docs))
    assert sum(got[k].language == f"l{k % 220:03}" and got[k].kept for k in range(880)) > 870


def test_junk_codes_are_no_languages(make_docs, rows):
    """Codes of single rows, and one dealt at random over all languages."""
    junk = [(i, t, f"x{i}" if i % 10 == 0 else "unknown" if i % 10 == 1 else la, s) for i, t, la, s in rows]
    got = found(make_docs(junk))
    right = [got[i].language == la for i, _, la, _ in rows]
    assert sum(right) / len(right) > 0.97 and {r.language for r in got.values()} == set(SYLLABLES)


def test_visible_text():
    page = """<!DOCTYPE html><html lang="fr"><style>p{margin:0}</style><script>var t="</p>";a(0 < 1);</script>
    <!-- ad > 0 --><p title="a > b">Un&eacute; &amp; 1 < 2<br>deux<SCRIPT src=x>hid</SCRIPT ><p>trois<!-- never closed"""
    assert li.visible(page).split() == ["Uné", "&", "1", "<", "2", "deux", "trois"]


def test_page_query_uses_every_evidence(spark, tmp_path):
    """All pages are answered; one whose text is cut short goes by suffix, host and markup."""
    from logloom.llm.queries import QUERIES

    code = "<script>" + "the and then other handed " * 40 + "</script>"
    langs = ["fr", "en", "de"]
    site = {"fr": "fr", "en": "com", "de": "de"}
    pages = [(k, f"https://h{k % 9}.site.{site[langs[k % 3]]}/x",
              f"<html lang={langs[k % 3]}>{code}<p>{text(langs[k % 3], 30, k)}</p>") for k in range(240)]
    pages += [(900, "https://new.site.fr/", f"<html>{code}<p>zz</p>"), (901, "https://h8.site.de/", "<p>zz</p>"),
              (902, None, None), (None, "no address", f"<p>{text('en', 60, 1)}</p>")]
    spark.createDataFrame(pages, "page_id long, url string, html string").write.parquet(f"{tmp_path}/pages.parquet")
    found = QUERIES["op10_page_language_id"][0](spark, str(tmp_path))
    got = {r.page_id: r for r in found.collect()}
    assert len(got) == len(pages)
    assert all(got[k].by_text == got[k].language == langs[k % 3] and got[k].kept for k in range(240))
    assert (got[900].language, got[901].language, got[None].language) == ("fr", "de", "en")
    assert got[902].by_text is None and not got[902].kept
