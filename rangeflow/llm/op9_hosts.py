"""URL filtering by host words: unigram Viterbi segmentation, then multinomial naive Bayes.

Rules come first: a rule ``host/path`` fits its host and all subdomains of it where the url's path
starts with the rule's path; the longest fitting rule decides.  All other urls get the verdict of a
naive Bayes model over the words that their host and path are made of.

The word model and the classifier are trained on the whole table.  Word counts come from the visible text
of every page and from the names in distinct hosts that hyphens divide.  A page counts as unwanted for training when its segmented host
or path holds one of ``SEEDS``, words of the trades that url lists block; what the classifier learns from
them are the odds of all other tokens of those urls: the words beside a seed, and how many hyphens and
numbers a host has.  So it blocks hosts none of whose words are seeds, and a seed alone is no verdict.  Both
tables of counts are kept whole: a run of letters is segmented once, with the counts of those of its
substrings that are words, and a url is scored with the log-odds of its tokens, both looked up by joins.  A
token counts as often as it stands in a url.  Both classes have the same prior: pages marked by seeds are no
measure of how many are unwanted.

Cases: a null url, or one without ``://``, has empty host and path, no rule and the verdict "allow";
a null or empty page text adds no words; repeated rows are judged alike, each on its own; an empty
table gives an empty result; columns of the input other than ``page_id, url, html`` are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import discard, read_table, written

RULES = [
    ("org/", "allow"),
    ("example.org/es/", "block"),
    ("example.org/en/1", "block"),
    ("com/fr/", "allow"),
    ("com/de/", "block"),
]
#: Words of the trades that public url lists block (gambling, sex, drugs, fraud, malware), any of which marks a page for training.
SEEDS = [
    "adult", "baccarat", "betting", "blackjack", "bookmaker", "botnet", "camgirl", "casino", "cialis", "counterfeit", "crack", "escort", "erotic", "fetish", "gambling",
    "hentai", "hookup", "jackpot", "keygen", "levitra", "lottery", "malware", "milf", "nude", "payday", "phishing", "pills", "poker", "porn", "porno", "ransomware",
    "roulette", "scam", "sex", "slots", "spam", "steroids", "swingers", "torrent", "tramadol", "valium", "viagra", "warez", "webcam", "xanax", "xxx",
]
#: Substrings are looked up by up to so many letters; longer words by their first so many, and then compared whole.
LETTERS = 24
UNKNOWN = -16.0


def split_url(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path of a url; both empty for null or where ``://`` is missing."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return F.translate(host, upper, lower), path


def rule_col(host: Column, path: Column, rules: list[tuple[str, str]]) -> Column:
    """The longest rule that fits, as ``struct(rule, verdict)``; null if none does."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for text, verdict in sorted(rules, key=lambda r: (len(r[0]), r[0])):
        name, _, rest = text.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        out = F.when(fits, F.struct(F.lit(text).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def page_words(html: Column) -> Column:
    """Lower-case a-z words of a page's visible text."""
    text = F.regexp_replace(F.coalesce(html, F.lit("")), r"(?s)<(script|style)\b.*?</\1>|<[^>]*>", " ")
    return F.filter(F.split(F.lower(text), "[^a-z]+"), lambda w: w != "")


def lexicon(pages: DataFrame, hosts: DataFrame) -> tuple[DataFrame, dict[str, int], int]:
    """``w, n`` of every word of all pages and hosts; counts of seeds, raised to a floor; and the sum of all."""
    parts = F.filter(F.split("host", r"\."), lambda p: F.contains(p, F.lit("-")))
    of_hosts = F.filter(F.flatten(F.transform(parts, lambda p: F.split(p, "[^a-z]+"))), lambda w: w != "")
    each = pages.select(F.explode(page_words(F.col("html"))).alias("w")).unionAll(hosts.select(F.explode(of_hosts).alias("w")))
    counts = written(each.groupBy("w").agg(F.count(F.lit(1)).alias("n")), "op9-words")
    own = {r.w: r.n for r in counts.where(F.col("w").isin(SEEDS)).collect()}
    most, total = counts.agg(F.max("n"), F.sum("n")).first()
    floor = (most or 1) // 100 + 1
    base = {w: max(own.get(w, 0), floor) for w in SEEDS}
    return counts, base, (total or 0) + sum(base.values()) - sum(own.values())


def segment(name: str, logs: dict[str, float]) -> list[str]:
    """Best split of a run of letters into words (Viterbi); unknown letters pay a fixed price each, those side by side are one word."""
    n = len(name)
    sizes = sorted({len(w) for w in logs} | {1})
    best, back = [0.0] + [-math.inf] * n, [0] * (n + 1)
    for e in range(1, n + 1):
        for size in sizes:
            s = e - size
            if s < 0:
                break
            got = logs.get(name[s:e], UNKNOWN if size == 1 else None)
            if got is not None and best[s] + got > best[e]:
                best[e], back[e] = best[s] + got, s
    out: list[str] = []
    unknown = False
    while n:
        word = name[back[n] : n]
        if unknown and word not in logs:
            out[-1] = word + out[-1]
        else:
            out.append(word)
        unknown = word not in logs
        n = back[n]
    return out[::-1]


def letter_runs() -> list[tuple[str, Column]]:
    """Runs of letters a-z of host and path, each with its mark."""
    return [(mark, F.filter(F.split(part, "[^a-z]+"), lambda r: r != "")) for mark, part in (("h:", F.col("host")), ("p:", F.lower("path")))]


def segmented(runs: DataFrame, counts: DataFrame, base: dict[str, int], total: int) -> DataFrame:
    """``run, words`` of distinct runs of letters (``rid, run``)."""
    at = runs.select("rid", "run", F.explode(F.sequence(F.lit(1), F.length("run"))).alias("s"))
    sizes = F.sequence(F.lit(1), F.least(F.lit(LETTERS), F.length("run") - F.col("s") + 1))
    pieces = at.select("rid", F.explode(F.transform(sizes, lambda k: F.substr("run", F.col("s"), k))).alias("w"))
    short = pieces.join(counts, "w").select("rid", "w", "n")
    # a word of more letters begins with so many of them
    rests = at.where(F.length("run") - F.col("s") >= LETTERS).select("rid", F.substr("run", F.col("s")).alias("rest"))
    beyond = counts.where(F.length("w") > LETTERS).withColumn("start", F.substring("w", 1, LETTERS))
    long = rests.withColumn("start", F.substring("rest", 1, LETTERS)).join(beyond, "start").where(F.startswith("rest", "w")).select("rid", "w", "n")
    found = short.unionByName(long).groupBy("rid").agg(F.collect_set(F.struct("w", "n")).alias("found"))

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = {w: math.log(n / total) for w, n in base.items()}
        for b in batches:
            out = []
            for run, words in zip(b.column("run").to_pylist(), b.column("found").to_pylist(), strict=True):
                out.append(segment(run, known | {x["w"]: math.log(max(x["n"], base.get(x["w"], 0)) / total) for x in words or []}))
            yield pa.RecordBatch.from_arrays([b.column("run"), pa.array(out, pa.list_(pa.string()))], ["run", "words"])

    return runs.join(found, "rid", "left").select("run", "found").mapInArrow(split, "run string, words array<string>")


def _marked(mark: str, runs: Column) -> Column:
    return F.transform(runs, lambda r: F.struct(F.lit(mark).alias("mark"), r.alias("run")))


def url_tokens(urls: DataFrame, words: DataFrame) -> DataFrame:
    """``urls`` with the segmented words of host and path as ``tokens``; each hyphen and number of the host is one, all digits of the path are one."""
    marked = [_marked(mark, runs) for mark, runs in letter_runs()]
    each = urls.select("uid", F.explode(F.concat(*marked)).alias("m")).select("uid", "m.mark", "m.run")
    split = each.join(words, "run").select("uid", F.transform("words", lambda w: F.concat("mark", w)).alias("t"))
    bags = split.groupBy("uid").agg(F.flatten(F.collect_list("t")).alias("t"))
    none = F.array().cast("array<string>")
    digits = F.when(F.col("path").rlike(r"\p{Nd}"), F.array(F.lit("p:0"))).otherwise(none)
    marks = [F.array_repeat(F.lit(mark), F.regexp_count("host", F.lit(pattern))) for mark, pattern in (("h:-", "-"), ("h:0", "[0-9]+"))]
    tokens = F.concat(F.coalesce("t", none), *marks, digits)
    return urls.join(bags, "uid", "left").select("uid", "host", "path", "n", tokens.alias("tokens"))


def token_counts(bags: DataFrame) -> DataFrame:
    """``token, bad, good``: occurrences of each token in the pages of each training class."""
    each = bags.select("bad", "n", F.explode("tokens").alias("token"))
    return each.groupBy("token").agg(*[F.sum(F.when(F.col("bad") == k, F.col("n")).otherwise(0)).alias(c) for k, c in ((True, "bad"), (False, "good"))])


def bayes(counts: DataFrame) -> DataFrame:
    """Each token's log-odds of being unwanted (``token, odds``)."""
    size, bad, good = (x or 0 for x in counts.agg(F.count(F.lit(1)), F.sum("bad"), F.sum("good")).first())
    size += 1
    odds = F.log((F.col("bad") + 1) / F.lit(float(bad + size))) - F.log((F.col("good") + 1) / F.lit(float(good + size)))
    return counts.select("token", odds.alias("odds"))


def judge_urls(pages: DataFrame, rules: list[tuple[str, str]] = RULES) -> DataFrame:
    """``page_id, host, path, rule, verdict, score``; score is the model's log-odds of "block"."""
    host, path = split_url(F.col("url"))
    parts = pages.select("page_id", host.alias("host"), path.alias("path"))
    urls = written(
        parts.where("host <> ''").groupBy("host", "path").agg(F.count(F.lit(1)).alias("n")).withColumn("uid", F.monotonically_increasing_id()), "op9-urls"
    )
    runs = urls.select(F.explode(F.concat(*[r for _, r in letter_runs()])).alias("run")).distinct()
    runs = written(runs.withColumn("rid", F.monotonically_increasing_id()), "op9-runs")
    counts, base, total = lexicon(pages, urls.select("host").distinct())
    tokens = url_tokens(urls, segmented(runs, counts, base, total))
    bad = F.exists("tokens", lambda t: F.substring(t, 3, LETTERS + 1).isin(SEEDS))
    bags = written(tokens.withColumn("bad", bad), "op9-bags")
    discard(urls, runs, counts)
    counted = written(token_counts(bags), "op9-tokens")
    odds = bayes(counted)
    own = F.array_sort(F.collect_list(F.struct("token", "odds")))  # a fixed order of the sum
    sums = bags.select("uid", F.explode("tokens").alias("token")).join(odds, "token").groupBy("uid").agg(own.alias("own"))
    sums = sums.select("uid", F.aggregate("own", F.lit(0.0), lambda a, x: a + x.odds).alias("sum"))
    known = written(bags.join(sums, "uid", "left").select("host", "path", F.coalesce("sum", F.lit(0.0)).alias("score")), "op9-scores")
    discard(bags, counted)
    scored = parts.join(known, ["host", "path"], "left").withColumn("score", F.coalesce("score", F.lit(-1.0)))
    r = rule_col(F.col("host"), F.col("path"), rules)
    return scored.withColumn("r", r).select(
        "page_id",
        "host",
        "path",
        F.col("r.rule").alias("rule"),
        F.coalesce("r.verdict", F.when(F.col("score") > 0, "block").otherwise("allow")).alias("verdict"),
        "score",
    )


def op9_host_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(read_table(spark, sf_dir, "pages"))
