"""URL verdicts: rules first, then naive Bayes over words found inside host and path names.

A rule is ``host/path``. It fits its host and all subdomains, where the URL's path starts with
the rule's; the longest rule that fits decides (of equal ones with two verdicts, block). All
other URLs get the verdict of a multinomial naive Bayes model that learns from the URLs that
rules decide, and from ``SEEDS``, words of known meaning that count as ``SEED_URLS`` URLs each.

Names are often words run together, so every run of letters in host and path is split into
words by Viterbi: of all ways to cut it, the one of least cost, where a word costs
``log10(all words / its count)`` in the texts of the pages (tags and character references
aside), and a letter that is no word costs ten times a word seen once; such letters in a row
are one token. Of equal cuts, fewer words win, then the longer last word. Words of more than
``LONGEST`` letters are not in the dictionary. Tokens of host and path are counted apart;
what a rule names (as ``com`` and ``en``) is no evidence, nor is a token never learnt.

Costs and log odds are whole millionths, so sums do not depend on their order. The dictionary
is never collected or broadcast: the pieces of each different run are looked up by a join and
come back, with their costs, to the run. Learning sums runs before they are split; scoring
works on each different (host, path) once. Driver: the rules, the seeds, two rows of totals.

Defined results: a NULL URL, or one without ``://``, has an empty host and path; without
anything to learn from, or at even odds, the verdict is allow; rows repeated or with a NULL
id count and get verdicts like others; an empty table gives an empty result; other columns
are not read.
"""

from __future__ import annotations

from collections.abc import Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plenum.llm.arrow import map_batches
from plenum.operators.skew import grouped_for_join
from plenum.session import materialize

LONGEST = 24
SEED_URLS = 100
# Words that tell what a site offers.
SEEDS = {
    "block": ["adult", "ads", "bets", "casino", "pills", "spam"],
    "allow": ["archive", "docs", "library", "news", "school", "wiki"],
}
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
PIECE = "key binary, start int, word string"
MILLION = 1_000_000


def host_of(url: Column) -> Column:
    """Between the first ``://`` and ``/``, ``?`` or ``#``, with A to Z lower-cased."""
    host = F.regexp_extract(F.coalesce(url, F.lit("")), r"://([^/?#]*)", 1)
    return F.translate(host, UPPER, LOWER)


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"://[^/?#]*([^?#]*)", 1)


def longest_rule(rules: Sequence[tuple[str, str]], host: Column, path: Column) -> Column:
    """The struct (length, rule, verdict) of the longest rule that fits, or NULL."""
    if not rules:
        return F.lit(None).cast("struct<length: int, rule: string, verdict: string>")
    by_host: dict[str, list] = {}
    for verdict, rule in rules:
        name, slash, rest = rule.partition("/")
        by_host.setdefault(name.lower(), []).append((len(rule), rule, verdict, slash + rest))
    entry = lambda r: F.struct(F.lit(r[0]).alias("length"), F.lit(r[1]).alias("rule"), F.lit(r[2]).alias("verdict"), F.lit(r[3]).alias("path"))
    table = F.create_map(*[x for h, found in by_host.items() for x in (F.lit(h), F.array(*[entry(r) for r in found]))])
    deepest = max(h.count(".") + 1 for h in by_host)
    none = F.array().cast("array<struct<length: int, rule: string, verdict: string, path: string>>")
    suffixes = [F.coalesce(F.element_at(table, F.substring_index(host, ".", -k)), none) for k in range(1, deepest + 1)]
    fits = F.filter(F.concat(*suffixes), lambda r: F.startswith(path, r["path"]))
    plain = F.transform(fits, lambda r: F.struct(r["length"].alias("length"), r["rule"].alias("rule"), r["verdict"].alias("verdict")))
    return F.array_max(plain)


def runs(rules: Sequence[tuple[str, str]]) -> Column:
    """The runs of letters of ``host`` and ``path`` as structs (kind, run), without those
    that rules name."""
    hosts = sorted({x for _, r in rules for x in r.partition("/")[0].lower().split(".")})
    paths = sorted({x for _, r in rules for x in r.partition("/")[2].lower().split("/") if x})

    def of(kind: str, name: str, known: list[str]) -> Column:
        found = F.regexp_extract_all(F.lower(F.col(name)), F.lit(r"\p{L}+"), F.lit(0))
        found = F.filter(found, lambda r: ~r.isin(known)) if known else found
        return F.transform(found, lambda r: F.struct(F.lit(kind).alias("kind"), r.alias("run")))

    return F.concat(of("host", "host", hosts), of("path", "path", paths))


def dictionary(pages: DataFrame, html: str) -> DataFrame:
    """(word, n): how often each word stands in the texts of the pages."""
    text = F.regexp_replace(F.coalesce(F.col(html), F.lit("")), r"<[^<>]*>|&#?\w{1,32};", " ")
    words = pages.select(F.explode(F.split(F.lower(text), r"[^\p{L}]+")).alias("word"))
    return words.filter(F.char_length("word").between(1, LONGEST)).groupBy("word").agg(F.count("*").alias("n"))


def split_run(run: str, costs: dict[int, list[tuple[int, int]]], unknown: int) -> list[str]:
    """The words of a run; ``costs`` has (length, cost) of the words that start at a place."""
    best = [(0, 0, 0)] + [None] * len(run)  # cost, words, less the last word's length
    for at in range(len(run)):
        cost, count, _ = best[at]
        found = costs.get(at, [])
        if not any(size == 1 for size, _ in found):
            found = [*found, (1, unknown)]
        for size, price in found:
            new = (cost + price, count + 1, -size)
            if best[at + size] is None or new < best[at + size]:
                best[at + size] = new
    known = {(at, size): True for at, found in costs.items() for size, _ in found}
    words, at = [], len(run)
    while at:
        size = -best[at][2]
        words.append((at - size, at, (at - size, size) in known))
        at -= size
    out: list[list] = []
    for low, high, is_word in reversed(words):
        if out and not is_word and not out[-1][2]:
            out[-1][1] = high
        else:
            out.append([low, high, is_word])
    return [run[low:high] for low, high, _ in out]


def segmented(names: DataFrame, words: DataFrame) -> DataFrame:
    """(run, words) of each different run in ``names``."""
    total = words.agg(F.sum("n").alias("n")).first()["n"] or 1
    unknown = round(_log10(total) * MILLION) + MILLION
    keyed = materialize(names.select("run").distinct().withColumn("key", F.unhex(F.md5(F.encode("run", "UTF-8")))), "runs")

    def spans(batch):
        for key, run in zip(batch.column("key").to_pylist(), batch.column("run").to_pylist()):
            for low in range(0, len(run), 4096):
                places = [
                    (at, run[at : at + size])
                    for at in range(low, min(low + 4096, len(run)))
                    for size in range(1, min(LONGEST, len(run) - at) + 1)
                ]
                yield {"key": [key] * len(places), "start": [p[0] for p in places], "word": [p[1] for p in places]}

    priced = words.select("word", F.round(F.log10(F.lit(float(total)) / F.col("n")) * MILLION).cast("bigint").alias("cost"))
    met = map_batches(keyed.select("key", "run"), spans, PIECE).join(priced, "word")
    found = met.groupBy("key").agg(F.collect_list(F.struct("start", F.char_length("word").alias("size"), "cost")).alias("found"))

    def cut(batch):
        out = []
        for run, found in zip(batch.column("run").to_pylist(), batch.column("found").to_pylist()):
            costs: dict[int, list] = {}
            for f in found or []:
                costs.setdefault(f["start"], []).append((f["size"], f["cost"]))
            out.append(split_run(run, costs, unknown))
        yield {"run": batch.column("run"), "words": pa.array(out, pa.list_(pa.string()))}

    return map_batches(keyed.join(found, "key", "left").select("run", "found"), cut, "run string, words array<string>")


def _log10(x: float) -> float:
    import math

    return math.log10(x)


def token_odds(learnt: DataFrame, urls: dict[str, int], seeds: dict[str, list[str]]) -> tuple[DataFrame, int]:
    """(kind, word, odds) and the odds before any token: log10 of block against allow, in
    millionths, from counts (verdict, kind, word, n) and URLs of each verdict."""
    spark = learnt.sparkSession
    rows = [(v, "host", w, SEED_URLS) for v, found in seeds.items() for w in found]
    sown = spark.createDataFrame(rows, "verdict string, kind string, word string, n bigint")
    count = lambda v: F.sum(F.when(F.col("verdict") == v, F.col("n")).otherwise(0))
    counts = learnt.unionByName(sown).groupBy("kind", "word").agg(count("block").alias("block"), count("allow").alias("allow"))
    counts = materialize(counts, "tokens")
    sums = counts.agg(F.sum("block").alias("block"), F.sum("allow").alias("allow"), F.count("*").alias("kinds")).first()
    below = [float((sums[v] or 0) + sums["kinds"]) for v in ("block", "allow")]
    odds = F.log10((F.col("block") + 1) / F.lit(below[0])) - F.log10((F.col("allow") + 1) / F.lit(below[1]))
    given = {v: urls.get(v, 0) + SEED_URLS * len(seeds.get(v, [])) for v in ("block", "allow")}
    before = round((_log10(given["block"] + 1) - _log10(given["allow"] + 1)) * MILLION)
    return counts.select("kind", "word", F.round(odds * MILLION).cast("bigint").alias("odds")), before


def verdicts(
    pages: DataFrame, rules: Sequence[tuple[str, str]], id_="page_id", url="url", html="html", seeds=SEEDS
) -> DataFrame:
    """Per row: the id, host, path, the rule that decides (or NULL), the verdict, and the
    model's odds in millionths of log10 (NULL where a rule decides)."""
    parts = pages.select(F.col(id_).alias("id"), host_of(F.col(url)).alias("host"), path_of(F.col(url)).alias("path"))
    parts = parts.withColumn("hit", longest_rule(rules, F.col("host"), F.col("path")))
    decided = parts.filter("hit is not null").withColumn("verdict", F.col("hit.verdict"))
    rest = parts.filter("hit is null")

    given = {r["verdict"]: r["n"] for r in decided.groupBy("verdict").agg(F.count("*").alias("n")).collect()}  # two rows
    seen = decided.select("verdict", F.explode(runs(rules)).alias("r")).groupBy("verdict", "r.kind", "r.run")
    seen = materialize(seen.agg(F.count("*").alias("n")), "seen")
    urls = materialize(rest.select("host", "path").distinct(), "urls")
    named = urls.select("host", "path", F.explode(runs(rules)).alias("r")).select("host", "path", "r.kind", "r.run")

    words = materialize(dictionary(pages, html), "dictionary")
    cut = materialize(segmented(seen.select("run").union(named.select("run")), words), "segmented")
    tokens = cut.select("run", F.explode("words").alias("word"))
    learnt = seen.join(tokens, "run").groupBy("verdict", "kind", "word").agg(F.sum("n").alias("n"))
    odds, before = token_odds(learnt, given, seeds)

    scored = named.select("kind", "run").distinct().join(tokens, "run").join(odds, ["kind", "word"])
    # Written, so that both sides of the next join are shuffled for it and a hot run is split.
    scored = materialize(scored.groupBy("kind", "run").agg(F.sum("odds").alias("odds")), "scored")
    judged = grouped_for_join(named.join(scored, ["kind", "run"]), ["host", "path"], F.sum("odds").alias("odds"))
    open_ = rest.join(judged, ["host", "path"], "left").withColumn("odds", F.coalesce("odds", F.lit(0)) + before)
    open_ = open_.withColumn("verdict", F.when(F.col("odds") > 0, "block").otherwise("allow"))
    columns = [F.col("id").alias(id_), "host", "path", F.col("hit.rule").alias("rule"), "verdict", "odds"]
    return decided.withColumn("odds", F.lit(None).cast("bigint")).select(*columns).union(open_.select(*columns))
