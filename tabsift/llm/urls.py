"""URL filter: fixed rules first, then logistic regression on hashed character n-grams of host and path.

Host and path are cut by SQL functions. The model is trained from the small labelled table below and is one vector of
``BUCKETS`` weights; n-grams of a whole batch are hashed as one byte array, so no Python runs per n-gram.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import arrow_schema, ascii_lower, batch_of

BUCKETS, GRAMS = 1 << 16, (3, 4, 5)
#: Rules a table may hold; they travel with every task.
MAX_RULES = 100_000
STEPS, RATE, DECAY = 1200, 0.5, 1e-4
#: How much a row to be blocked weighs beside one to be kept: most of the web is worth keeping.
BAD_WEIGHT = 0.6

#: The small labelled table is built from these words (fixed values): what sites worth keeping are about and called, what others are about.
GOOD_WORDS = ("news", "times", "daily", "post", "library", "museum", "university", "school", "academy", "garden", "recipes", "kitchen", "weather", "travel",
              "history", "science", "physics", "mathematics", "journal", "health", "hospital", "government", "city", "council", "bank", "insurance", "docs",
              "wiki", "encyclopedia", "dictionary", "forum", "blog", "music", "film", "theatre", "sports", "football", "tennis", "cycling", "books",
              "photo", "art", "design", "architecture", "engineering", "software", "computer", "open-source", "research", "institute", "market",
              "shop", "store", "fashion", "furniture", "cars", "railway", "airport", "hotel", "restaurant", "farm", "church", "family", "kids", "jobs")
NAMES = ("anna", "martin", "oliver", "sophie", "miller", "johnson", "schmidt", "weber", "garcia", "lopez", "moreau", "dubois", "rossi", "novak", "larsen",
         "london", "berlin", "madrid", "lyon", "chicago", "boston", "hamburg", "valencia", "toulouse", "vienna", "dublin", "ottawa", "seattle",
         "river", "mountain", "forest", "harbour", "bridge", "castle", "silver", "green", "northern", "western", "little", "grand", "central", "united",
         "wasser", "strasse", "haus", "freunde", "casa", "ciudad", "amigos", "maison", "jardin", "soleil")
BAD_WORDS = ("casino", "poker", "slots", "roulette", "blackjack", "jackpot", "lottery", "gambling", "betting", "bets", "bookmaker", "porn", "porno", "xxx",
             "sex", "nude", "cams", "webcams", "escorts", "adult", "hookup", "milf", "fetish", "erotic", "viagra", "cialis", "pills", "steroids",
             "pharmacy-online", "weight-loss", "payday", "quick-loans", "credit-repair", "torrent", "warez", "crack", "keygen", "serials", "nulled",
             "adserver", "adclick", "popunder", "tracker", "affiliate", "doorway", "spam", "replica-watches", "forex-signals", "crypto-giveaway", "get-rich")
BAD_WITH = ("", "cheap", "free", "best", "hot", "live", "online", "buy", "top", "24", "365", "x", "my", "real")
ENDINGS = (".com", ".net", ".org", ".de", ".fr", ".es", ".co.uk", ".info", ".edu", ".gov", ".example", ".io")
GOOD_PAGES = ("", "/", "/about", "/contact.html", "/2019/11/24/report.html", "/articles/spring-flowers", "/wiki/Suspension_bridge", "/guide/install", "/products/42",
              "/en/", "/de/impressum", "/fr/accueil", "/es/noticias/201", "/index.php", "/category/health", "/lessons/7", "/archive/88123", "/p/4711.html")
BAD_PAGES = ("/casino/free-spins", "/xxx/video/1", "/click?ad=5", "/poker/bonus", "/buy-viagra-online", "/adult/cams", "/lottery/win", "/porn/tube/77",
             "/ads/banner/728x90", "/warez/crack.zip", "/payday/apply-now", "/affiliate/track", "/sex/chat", "/betting/odds", "/pills/order")


def labelled_table() -> list[tuple[str, str, int]]:
    """(host, path, 1 if to be blocked), by rule: sites named after ordinary words and names, alone and joined, with ordinary pages;
    sites named after unwanted matter with any page; and ordinary sites with unwanted pages. A missing url (empty host and path)
    is nothing to block."""
    rows, plain = [("", "", 0)], (*GOOD_WORDS, *NAMES)
    n, g, b = len(plain), len(GOOD_PAGES), len(BAD_PAGES)
    for i in range(8 * n):
        first, second = plain[i % n], plain[(7 * i + 13 * (i // n) + 1) % n]
        name = (first, first + second, f"{first}-{second}", f"{second}{first}{i % 90 + 10}")[i // n % 4]
        host = f"{('', 'www.', 'blog.', 'm.', 'en.')[i % 5]}{name}{ENDINGS[i % len(ENDINGS)]}"
        rows.append((host, GOOD_PAGES[i % g], 0))
        if i % 12 == 0:
            rows.append((host, BAD_PAGES[i % b], 1))
    for i, word in enumerate(BAD_WORDS * 6):
        extra, other = BAD_WITH[(5 * i + i // len(BAD_WORDS)) % len(BAD_WITH)], plain[(11 * i + 3) % n]
        name = (extra + word, f"{word}{extra}", f"{extra}-{word}".strip("-"), word + other, f"{word}-{extra}".strip("-"), other + word)[i // len(BAD_WORDS)]
        host = f"{('', 'www.', 'm.')[i % 3]}{name}{ENDINGS[i % len(ENDINGS)]}"
        rows.append((host, (GOOD_PAGES + BAD_PAGES)[i % (g + b)], 1))
    return rows


def hashed_grams(texts: list[str], field: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every character n-gram of the texts, each between a start and an end mark; by UTF-8 bytes."""
    raw = [b"\x02" + t.encode() + b"\x03" for t in texts]
    sizes = np.fromiter(map(len, raw), dtype=np.int64, count=len(raw))
    row = np.repeat(np.arange(len(raw)), sizes)
    data = np.frombuffer(b"".join(raw), dtype=np.uint8).astype(np.uint64) + np.uint64(1 + 256 * field)
    rows, buckets = [], []
    with np.errstate(over="ignore"):
        for n in GRAMS:
            m = len(data) - n + 1
            if m <= 0:
                continue
            key = np.zeros(m, dtype=np.uint64)
            for i in range(n):
                key = key * np.uint64(0x9E3779B97F4A7C15) + data[i:i + m]
            key ^= key >> np.uint64(31)
            key *= np.uint64(0xBF58476D1CE4E5B9)
            whole = row[:m] == row[n - 1:]
            rows.append(row[:m][whole])
            buckets.append((key >> np.uint64(48))[whole].astype(np.int64) % BUCKETS)
    empty = np.zeros(0, dtype=np.int64)
    return np.concatenate([empty, *rows]), np.concatenate([empty, *buckets])


def _grams(hosts: list[str], paths: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, bucket, value): each field's n-grams weigh one over the root of their number."""
    parts = []
    for field, texts in enumerate((hosts, paths)):
        row, bucket = hashed_grams(texts, field)
        count = np.bincount(row, minlength=len(texts))
        parts.append((row, bucket, 1 / np.sqrt(count[row])))
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


@functools.lru_cache(maxsize=1)
def trained() -> tuple[np.ndarray, float]:
    """(weights, bias) by gradient steps on the regularised likelihood of the labelled table."""
    rows = labelled_table()
    row, bucket, value = _grams([r[0] for r in rows], [r[1] for r in rows])
    y = np.array([r[2] for r in rows], dtype=np.float64)
    w, b = np.zeros(BUCKETS), 0.0
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-(np.bincount(row, value * w[bucket], minlength=len(y)) + b)))
        miss = (y - p) * np.where(y > 0, BAD_WEIGHT, 1.0) / len(y)
        w += RATE * 20 * (np.bincount(bucket, value * miss[row], minlength=BUCKETS) - DECAY * w)
        b += RATE * miss.sum()
    return w.astype(np.float32), b


def probabilities(hosts: list[str], paths: list[str], model: tuple[np.ndarray, float]) -> np.ndarray:
    """The probability that each url is to be blocked."""
    row, bucket, value = _grams(hosts, paths)
    return 1 / (1 + np.exp(-(np.bincount(row, value * model[0][bucket], minlength=len(hosts)) + model[1])))


class Rules:
    """Rules by host: the longest rule (host and path together) that fits a url wins; on a tie the longer host."""

    def __init__(self, rules: list[tuple[str, str, str]]):
        if len(rules) > MAX_RULES:
            raise ValueError(f"more than {MAX_RULES} rules: raise the bound only if every task may hold them")
        self.by_host: dict[str, list[tuple[str, str]]] = {}
        for verdict, host, path in rules:
            if verdict not in ("allow", "block"):
                raise ValueError(f"a rule allows or blocks, not {verdict!r}")
            self.by_host.setdefault(host, []).append((path, verdict))

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        """(rule, verdict) for a url."""
        best, at = None, 0
        while at >= 0:
            suffix = host[at:]
            for start, verdict in self.by_host.get(suffix, ()):
                if path.startswith(start):
                    key = (len(suffix) + len(start), len(suffix), verdict == "block")
                    if best is None or key > best[0]:
                        best = (key, suffix + start, verdict)
            dot = host.find(".", at)
            at = dot + 1 if dot >= 0 else -1
        return best and best[1:]


def split_url(url):
    """(host, path) columns: host from after the first :// to the next / ? # or the end, A-Z lower-cased; path from there to ? or #."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + F.lit(3), F.length(url)))
    host = ascii_lower(F.regexp_extract(rest, r"^([^/?#]*)", 1))
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.coalesce(host, F.lit("")), F.coalesce(path, F.lit(""))


def judged(pages: DataFrame, rules: list[tuple[str, str, str]], url: str = "url", page_id: str = "page_id") -> DataFrame:
    """page_id, host, path, rule (null where none fits), verdict (allow or block), score (the model's probability to block).

    A null url, or one without ://, has an empty host and path, which no rule fits; the model judges it like any other.
    ``rules`` are (verdict, host, path). A null page_id and repeated rows keep their rows; only the two columns are read;
    an empty table gives an empty result.
    """
    held, model = Rules(rules), trained()
    host, path = split_url(F.col(url))
    cut = pages.select(F.col(page_id), host.alias("host"), path.alias("path"))
    schema = T.StructType([*cut.schema.fields, T.StructField("rule", T.StringType()), T.StructField("verdict", T.StringType()), T.StructField("score", T.DoubleType())])
    arrow = arrow_schema(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hosts, paths = batch.column("host").to_pylist(), batch.column("path").to_pylist()
            found = [held.find(h, p) for h, p in zip(hosts, paths, strict=True)]
            score = probabilities(hosts, paths, model)
            verdict = [f[1] if f else ("block" if p >= 0.5 else "allow") for f, p in zip(found, score, strict=True)]
            yield batch_of(arrow, {page_id: batch.column(page_id), "host": hosts, "path": paths, "rule": [f and f[0] for f in found],
                                   "verdict": verdict, "score": score})

    return cut.mapInArrow(run, schema)
