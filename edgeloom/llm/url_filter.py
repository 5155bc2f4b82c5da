"""URL filter: rules by host and path, and for the rest a classifier of the words in the URL.

The host's labels and the path are cut at marks, and each piece is split into words by the most likely sequence under a unigram
model (Viterbi). The model's words are those of the pages' visible text, counted over all pages, and the seed and plain words. A
multinomial naive Bayes model over host words and path words (kept apart; all numbers are one word) scores the URL.

No label says which pages are unwanted, so the classes come from a few seed words: in the first round, pages whose split host
holds one teach the class block, all others allow; in the second, the pages that the first round's model blocks do. What is learned
is which other words unwanted hosts and paths are made of: a URL of such words without any seed word is blocked, and one seed
word among wanted ones is not enough.

Words and features below a share of all occurrences (``word_share``, ``feature_share``) count as unknown; so both models are of
bounded size and alike at every size of the input.

A null url, or one without ``://``, has an empty host and path and no words: its verdict is the class that is more frequent. A score
of exactly 0 allows. A null html adds no words. Repeated rows are judged alike, and each counts. Very long URLs are split whole, in
time proportional to their length, and so is very long html, whatever marks it opens and does not close. Columns other than page_id, url and html are not looked at. Without pages there is nothing to
judge.
"""

import math
import re
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from edgeloom.llm.common import bounded_batches, discard, stage

# Seed words, of sites that filters of this kind name.
BLOCK_WORDS = "adult ads bets casino gambling pills poker porn spam viagra xxx".split()
# Common parts of host names that say nothing bad.
PLAIN_WORDS = "blog com de en es fr mail net news org shop site the web wiki www".split()
# Action, host, path.
RULES = (("block", "com", "/en/"), ("allow", "example.com", "/en/7"), ("allow", "net", "/de/"), ("block", "example.net", "/de/8"), ("block", "org", "/es/"))


@dataclass(frozen=True)
class UrlParams:
    """word_share, feature_share: least shares of all occurrences; rounds: how often the classes are learned."""

    word_share: float = 1e-5
    feature_share: float = 1e-5
    longest_word: int = 20
    smoothing: float = 0.5
    rounds: int = 2


def _lower_ascii(c):
    return F.translate(c, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def parts(pages: DataFrame) -> DataFrame:
    """pages with host and path."""
    url = F.coalesce(F.col("url"), F.lit(""))
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.expr("substring(coalesce(url, ''), instr(coalesce(url, ''), '://') + 3)")).otherwise("")
    host = F.regexp_extract(rest, r"\A([^/?#]*)", 1)
    path = F.regexp_extract(rest, r"\A[^/?#]*([^?#]*)", 1)
    return pages.withColumns({"host": _lower_ascii(host), "path": path})


def rule_of(rules=RULES):
    """Of host and path, the rule that fits and is longest (host and path written together), as a struct of rule and action."""
    fits = []
    for action, host, path in sorted(rules, key=lambda r: (-len(r[1] + r[2]), r[0])):
        own = (F.col("host") == host) | F.endswith("host", F.lit("." + host))
        fits.append((own & F.startswith("path", F.lit(path)), F.struct(F.lit(host + path).alias("rule"), F.lit(action).alias("action"))))
    out = F.when(*fits[0])
    for f in fits[1:]:
        out = out.when(*f)
    return out


_LETTER = 2.5
_PIECES = re.compile(r"[^\W_]+")


@dataclass
class UrlModel:
    """cost: negative log probability of a word; ratio: log odds of block for a feature."""

    cost: dict[str, float]
    unknown: float
    longest: int
    prior: float = 0.0
    ratio: dict[str, float] | None = None
    cache: dict[str, list[str]] = field(default_factory=dict)

    def split(self, piece: str) -> list[str]:
        """The most likely words of a piece; a stretch that is no known word costs ``unknown`` and _LETTER a letter.

        best: by end, the least cost and the begin of its last word; open_: the same of ways whose last word is an unknown stretch.
        Equal costs go to the longer last word.
        """
        got = self.cache.get(piece)
        if got is not None:
            return got
        best: list[tuple[float, int]] = [(0.0, 0)]
        open_ = (math.inf, 0)
        for end in range(1, len(piece) + 1):
            open_ = min((open_[0] + _LETTER, open_[1]), (best[end - 1][0] + self.unknown + _LETTER, end - 1))
            found = open_
            for start in range(max(0, end - self.longest), end):
                c = self.cost.get(piece[start:end])
                if c is not None:
                    found = min(found, (best[start][0] + c, start))
            best.append(found)
        words, end = [], len(piece)
        while end:
            start = best[end][1]
            words.append(piece[start:end])
            end = start
        words.reverse()
        if len(piece) <= 100:
            if len(self.cache) >= 100_000:
                self.cache.clear()
            self.cache[piece] = words
        return words

    def words(self, text: str) -> list[str]:
        return [w for p in _PIECES.findall(text.lower()) for w in ([NUMBER] if p.isdigit() else self.split(p))]

    def features(self, host: str, path: str) -> list[str]:
        return [f"h:{w}" for w in self.words(host)] + [f"p:{w}" for w in self.words(path)]

    def unwanted(self, host: str, path: str) -> bool:
        """By the seed words before anything is learned, then by what is."""
        if self.ratio is None:
            return not _SEEDS.isdisjoint(self.words(host))
        return self.odds(host, path) > 0

    def odds(self, host: str, path: str) -> float:
        return self.prior + sum(self.ratio.get(f, 0.0) for f in self.features(host, path))


NUMBER = "0"
_SEEDS = frozenset(BLOCK_WORDS)


_WORDS = regex.compile(r"\p{L}+").findall
_POINT = regex.compile(r"[\p{L}\p{N}]\.\p{L}").search  # names with points such as hosts
_HIDDEN = re.compile(r"(script|style)\b", re.IGNORECASE).match
_CLOSED = {name: re.compile(f"</{name}>", re.IGNORECASE).search for name in ("script", "style")}


def visible_text(html: str) -> str:
    """html without scripts, styles and marks. Each place is looked at once: where no end of a mark follows, none is looked for again."""
    out, at, open_ = [], 0, {"script", "style"}
    while (begin := html.find("<", at)) >= 0:
        out.append(html[at:begin])
        name = _HIDDEN(html, begin + 1)
        end = None
        if name and name[1].lower() in open_:
            end = _CLOSED[name[1].lower()](html, name.end())
            if end is None:  # never closed: only the mark itself goes
                open_.discard(name[1].lower())
        at = end.end() if end else html.find(">", begin) + 1
        if not at:
            out[-1] += html[begin:]
            return " ".join(out)
    out.append(html[at:])
    return " ".join(out)


def visible_words(html: str | None) -> list[str]:
    """Lower-cased words of the visible text; what holds a point between letters or digits, such as a host, is left out."""
    return [w for t in visible_text(html or "").lower().split() if "." not in t or not _POINT(t) for w in _WORDS(t)]


def unigrams(pages: DataFrame, p: UrlParams = UrlParams()) -> UrlModel:
    """The model of words, from the visible text of all pages."""
    bounded_batches(pages.sparkSession)

    def counted(batches):
        n: Counter = Counter()
        for b in batches:
            for html in b["html"]:
                n.update(w for w in visible_words(html) if 2 <= len(w) <= p.longest_word)
            if len(n) > 200_000:
                yield pd.DataFrame(list(n.items()), columns=["word", "n"])
                n.clear()
        yield pd.DataFrame(list(n.items()), columns=["word", "n"])

    words = pages.select(F.col("html").cast("string")).mapInPandas(counted, "word string, n long")
    words = stage(words.groupBy("word").agg(F.sum("n").alias("n")), "url-words")
    total = words.agg(F.sum("n")).first()[0] or 0
    counts = {r["word"]: float(r["n"]) for r in words.where(F.col("n") >= p.word_share * total).collect()}
    discard(words)
    top = max([1.0, *counts.values()])
    for w in (*BLOCK_WORDS, *PLAIN_WORDS):
        counts[w] = counts.get(w, 0.0) + top**0.5
    total = sum(counts.values())
    return UrlModel({w: -math.log(n / total) for w, n in counts.items()}, math.log(total), max(map(len, counts)))


def train(pages: DataFrame, p: UrlParams = UrlParams()) -> UrlModel:
    """From all rows of pages (url, html); what comes to the driver is bounded by the shares."""
    spark = pages.sparkSession
    bounded_batches(spark)
    model = unigrams(pages, p)
    urls = stage(parts(pages.select("url")).groupBy("host", "path").agg(F.count("*").alias("n")), "urls")
    for _ in range(p.rounds):
        shared = spark.sparkContext.broadcast(model)

        def counted(batches):
            m = shared.value  # noqa: B023
            n: dict[str, list[int]] = {}
            for b in batches:
                for host, path, times in zip(b["host"], b["path"], b["n"]):
                    bad = int(m.unwanted(host, path))
                    n.setdefault("", [0, 0])[bad] += times
                    for f in m.features(host, path):
                        n.setdefault(f, [0, 0])[bad] += times
                if len(n) > 200_000:
                    yield pd.DataFrame([(f, *c) for f, c in n.items()], columns=["feature", "allow", "block"])
                    n = {}
            yield pd.DataFrame([(f, *c) for f, c in n.items()], columns=["feature", "allow", "block"])

        each = stage(urls.mapInPandas(counted, "feature string, allow long, block long").groupBy("feature").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block")), "url-features")
        sums = each.where("feature <> ''").agg(F.sum("allow").alias("allow"), F.sum("block").alias("block"), F.count("*").alias("n")).first()
        docs = each.where("feature = ''").first()
        least = p.feature_share * ((sums["allow"] or 0) + (sums["block"] or 0))
        kept = each.where((F.col("feature") != "") & (F.col("allow") + F.col("block") >= least)).collect()
        discard(each)
        s, size = p.smoothing, sums["n"] or 1
        low, high = (sums["allow"] or 0) + s * size, (sums["block"] or 0) + s * size
        ratio = {r["feature"]: math.log((r["block"] + s) / high) - math.log((r["allow"] + s) / low) for r in kept}
        model = UrlModel(model.cost, model.unknown, model.longest, math.log((docs["block"] + s) / (docs["allow"] + s)) if docs else 0.0, ratio)
    discard(urls)
    return model


def judge(pages: DataFrame, model: UrlModel, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score (log odds of block), words of every row of pages."""
    shared = pages.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("score double, words string")
    def scored(host: pd.Series, path: pd.Series) -> pd.DataFrame:
        m = shared.value
        return pd.DataFrame({"score": np.array([m.odds(h, p) for h, p in zip(host, path)], float), "words": [" ".join(m.words(h)) for h in host]})

    out = parts(pages).withColumn("_rule", rule_of(rules)).withColumn("_s", scored("host", "path"))
    verdict = F.coalesce(F.col("_rule.action"), F.when(F.col("_s.score") > 0, "block").otherwise("allow"))
    return out.select("page_id", "host", "path", F.col("_rule.rule").alias("rule"), verdict.alias("verdict"), F.col("_s.score").alias("score"), F.col("_s.words").alias("host_words"))


def url_filter(pages: DataFrame, p: UrlParams = UrlParams()) -> DataFrame:
    return judge(pages.select("page_id", "url"), train(pages, p))
