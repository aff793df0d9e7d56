"""URL rules against a plain reading, and the model on urls it has not seen."""

import re

import numpy as np

from tabsift.llm import urls
from tabsift.llm.queries import URL_RULES


def plain(url):
    """(host, path, rule, verdict) read character by character."""
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    end = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
    host = "".join(c.lower() if "A" <= c <= "Z" else c for c in rest[:end])
    path = re.split(r"[?#]", rest[end:])[0]
    best = None
    for verdict, h, p in URL_RULES:
        if (host == h or host.endswith("." + h)) and path.startswith(p) and (best is None or len(h + p) > len(best[0])):
            best = (h + p, verdict)
    return host, path, *(best or (None, None))


URLS = [None, "", "no url", "http://", "HTTP://A.ORG/x", "https://Example.ORG/es/1", "http://m.example.org/en/12?x=/es/", "http://example.org/en/2", "http://notexample.org/es/",
        "http://x.com/fr/1#a", "http://x.com/de/1", "http://com/de/", "http://x.com?/de/", "http://x.com#/de/", "http://x.org", "http://x.org?", "http://É.ORG/", "a://b://c.org/",
        "http://x.com/en/", "http://user@x.org:80/", "http://org/", "http://.org/"]


def test_rules(spark):
    rows = urls.judged(spark.createDataFrame([(i, u, "x") for i, u in enumerate(URLS)], "page_id long, url string, host string"), URL_RULES).collect()
    assert len(rows) == len(URLS)
    for r in rows:
        host, path, rule, verdict = plain(URLS[r["page_id"]])
        assert (r["host"], r["path"], r["rule"]) == (host, path, rule), URLS[r["page_id"]]
        assert r["verdict"] == verdict if verdict else r["verdict"] == ("block" if r["score"] >= 0.5 else "allow")


def test_pages(spark):
    for r in urls.judged(spark.read.parquet("/root/testdata/sf0.01/pages.parquet"), URL_RULES).collect():
        assert r["verdict"] in ("allow", "block") and (r["rule"] is None or (r["host"] + r["path"]).find(r["rule"].split("/")[0]) >= 0)


def test_model_on_unseen_urls():
    good = [("www.daily-news.test", "/2021/03/04/story.html"), ("tionsher.example.net", "/en/4711"), ("erland.test", "/de/12.html"), ("blog.thing.example", "/wiki/River"), ("", "")]
    bad = [("free-casino.test", "/poker/bonus"), ("adult-cams.test", "/xxx/video/7"), ("cheap-viagra.test", "/buy-pills"), ("click.tracker.test", "/ads/banner/1"), ("warez-torrent.test", "/crack")]
    p = urls.probabilities([h for h, _ in good + bad], [q for _, q in good + bad], urls.trained())
    assert (p[:len(good)] < 0.5).all() and (p[len(good):] >= 0.5).all()


def test_model_on_hosts_unlike_the_table():
    """Real-world style names of which no whole word is in the table."""
    table = {w for host, _, _ in urls.labelled_table() for w in re.split(r"[.-]", host)} - {"www", "com", "org", "net", "de", "fr", "en", "m", "blog"}
    good = [("www.nytimes.com", "/2020/01/01/world"), ("en.wikipedia.org", "/wiki/Essex"), ("arxiv.org", "/abs/1706.03762"), ("middlesex.ac.uk", "/"), ("lemonde.fr", "/planete"),
            ("zeit.de", "/kultur"), ("tionsher.example.net", "/en/4711"), ("stackoverflow.com", "/questions/1"), ("kwpzqlm.example.com", "/en/12345.html"), ("amazon.com", "/dp/B00")]
    bad = [("www.pornstars.tv", "/video"), ("bet777.com", "/sports"), ("thepiratebay-torrents.to", "/search"), ("rx-onlinepharmacy.biz", "/order"), ("luckyslotsking.win", ""),
           ("xxxvids.tube", "/sex/1"), ("megacasinos.se", "/poker/"), ("cheapviagras.ru", "/pills")]
    assert not any(w in table for host, _ in good + bad for w in re.split(r"[.-]", host) if len(w) > 4 and w != "example")
    p = urls.probabilities([h for h, _ in good + bad], [q for _, q in good + bad], urls.trained())
    assert (p[:len(good)] < 0.5).all() and (p[len(good):] >= 0.5).all()


def test_score_against_plain_sums():
    """The whole score by a loop over the n-grams."""
    weights, bias = urls.trained()
    for host, path in (("free-casino.test", "/poker"), ("a.org", ""), ("", ""), ("é.example", "/x")):
        total = bias
        for field, text in enumerate((host, path)):
            raw = b"\x02" + text.encode() + b"\x03"
            grams = [raw[i:i + n] for n in urls.GRAMS for i in range(len(raw) - n + 1)]
            for g in grams:
                key = 0
                for b in g:
                    key = (key * 0x9E3779B97F4A7C15 + b + 1 + 256 * field) % 2**64
                key = ((key ^ key >> 31) * 0xBF58476D1CE4E5B9) % 2**64
                total += float(weights[(key >> 48) % urls.BUCKETS]) / np.sqrt(len(grams))
        assert urls.probabilities([host], [path], urls.trained())[0] == np.float64(1 / (1 + np.exp(-total))).round(12) or abs(
            urls.probabilities([host], [path], urls.trained())[0] - 1 / (1 + np.exp(-total))) < 1e-6


def test_hashed_grams_against_loop():
    row, bucket = urls.hashed_grams(["ab", "", "abcdef"], 1)
    assert np.bincount(row, minlength=3).tolist() == [sum(max(0, n + 2 - g + 1) for g in urls.GRAMS) for n in (2, 0, 6)]
    one, two = urls.hashed_grams(["abcdef"], 1)
    assert sorted(bucket[row == 2].tolist()) == sorted(two.tolist())
    assert sorted(urls.hashed_grams(["abcdef"], 0)[1].tolist()) != sorted(two.tolist())


def test_nulls_and_repeats(spark):
    pages = spark.createDataFrame([(None, None), (1, "http://a.org/"), (1, "http://a.org/")], "page_id long, url string")
    rows = urls.judged(pages, URL_RULES).collect()
    assert len(rows) == 3 and sum(r["rule"] == "org/" for r in rows) == 2
    assert urls.judged(pages.limit(0), URL_RULES).count() == 0
