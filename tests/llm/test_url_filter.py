"""URL verdicts against the same model computed without Spark."""

import math
import re
from collections import Counter
from itertools import combinations

import regex
from plenum.llm.url_filter import LONGEST, SEED_URLS, SEEDS, split_run, verdicts

RULES = [
    ("allow", "com/"), ("block", "example.com/en/"), ("allow", "www.example.com/en/"), ("block", "net/es/"), ("block", "net/fr/")
]
SCHEMA = "page_id bigint, url string, html string"
HTML = "<p class='pills'>the cheap pills the news free bets the a bets</p> news &amp; school the free Ärger <b>win win casino"
URLS = [
    None, "", "no scheme", "://", "http://A.Com", "http://A.Com/", "http://x.example.com/en/1", "http://www.example.com/en/1?x=/en/",
    "https://m.www.example.com/en/cheappills", "http://myexample.com/en/", "http://net/es/a", "http://x.net/es", "http://cheappills.net/fr/winwin",
    "http://freebets.org/en/casinowin#x", "http://schoolnews.org/a/b", "http://thenews.net/en/", "ftp://zzzqq.org?x://y/", "http://ärger.de/Ärger/x9y",
    "http://schoolnews.com/en/the", "http://freebets.example.com/en/the", "http://a.example.com/EN/1", "http://h/" + "newsbets" * 4000,
]


def cheapest_split(run, price, unknown):
    best = None
    for count in range(len(run)):
        for cuts in combinations(range(1, len(run)), count):
            ends = (0, *cuts, len(run))
            words = [run[a:b] for a, b in zip(ends, ends[1:])]
            if all(w in price or len(w) == 1 for w in words):
                cost = sum(price.get(w, unknown) for w in words)
                best = min(best or (math.inf,), (cost, len(words), [-len(w) for w in reversed(words)], words))
    out, last = [], None
    for w in best[3]:
        if w not in price and last is False:
            out[-1] += w
        else:
            out.append(w)
        last = w in price
    return out


def expected(rows):
    """(host, path, rule, verdict) of each row."""
    counts = Counter()
    for _, _, html in rows:
        text = re.sub(r"<[^<>]*>|&#?\w{1,32};", " ", html or "", flags=re.ASCII)
        counts.update(w for w in regex.split(r"[^\p{L}]+", text.lower()) if 0 < len(w) <= LONGEST)
    total = sum(counts.values()) or 1
    unknown = round(math.log10(total) * 1e6) + 1_000_000
    price = {w: round(math.log10(total / n) * 1e6) for w, n in counts.items()}
    named = ({"com", "example", "www", "net"}, {"en", "es", "fr"})
    cache = {}

    def tokens(host, path):
        for kind, name, known in zip(("host", "path"), (host, path), named):
            for run in regex.findall(r"\p{L}+", name.lower()):
                if run in known:
                    continue
                if run not in cache:
                    starts = {}
                    for at in range(len(run)):
                        starts[at] = [(s, price[run[at : at + s]]) for s in range(1, LONGEST + 1) if at + s <= len(run) and run[at : at + s] in price]
                    cache[run] = split_run(run, starts, unknown)
                    if len(run) < 13:
                        assert cache[run] == cheapest_split(run, price, unknown)
                for word in cache[run]:
                    yield kind, word

    parts = []
    for _, url, _ in rows:
        met = re.search(r"://([^/?#]*)([^?#]*)", url or "")
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in met[1]) if met else ""
        path = met[2] if met else ""
        hits = []
        for verdict, rule in RULES:
            name, _, rest = rule.partition("/")
            if (host == name or host.endswith("." + name)) and path.startswith("/" + rest):
                hits.append((len(rule), rule, verdict))
        parts.append((host, path, *(max(hits)[1:] if hits else (None, None))))
    learnt, urls = {"block": Counter(), "allow": Counter()}, Counter()
    for host, path, rule, verdict in parts:
        if rule:
            urls[verdict] += 1
            learnt[verdict].update(tokens(host, path))
    for verdict, found in SEEDS.items():
        urls[verdict] += SEED_URLS * len(found)
        learnt[verdict].update({("host", w): SEED_URLS for w in found})
    kinds = set(learnt["block"]) | set(learnt["allow"])
    size = {v: sum(c.values()) + len(kinds) for v, c in learnt.items()}
    odds = {
        k: round((math.log10((learnt["block"][k] + 1) / size["block"]) - math.log10((learnt["allow"][k] + 1) / size["allow"])) * 1e6)
        for k in kinds
    }
    before = round((math.log10(urls["block"] + 1) - math.log10(urls["allow"] + 1)) * 1e6)
    out = []
    for host, path, rule, verdict in parts:
        if not rule:
            verdict = "block" if before + sum(odds.get(t, 0) for t in tokens(host, path)) > 0 else "allow"
        out.append((host, path, rule, verdict))
    return out


def test_verdicts(spark):
    rows = [(i if i % 6 else None, url, HTML if i % 3 else None) for i, url in enumerate(URLS + URLS[5:9])]
    rows.append((3, "http://x.org/", "the " * 50_000 + "<" * 50_000))
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "1 AS host", "2 AS path", "'c' AS verdict", "'d' AS run", "0 AS id")
    found = sorted((tuple(r)[:5] for r in verdicts(df, RULES).collect()), key=repr)
    want = sorted(((r[0], *e) for r, e in zip(rows, expected(rows))), key=repr)
    assert found == want
    assert {r[4] for r in found if r[3] is None} == {"allow", "block"}


def test_no_rules_and_no_seeds_allow(spark):
    df = spark.createDataFrame([(1, "http://spam.org/x", None), (2, None, "")], SCHEMA)
    assert [r.verdict for r in verdicts(df, [], seeds={}).collect()] == ["allow", "allow"]


def test_empty_table(spark):
    assert verdicts(spark.createDataFrame([], SCHEMA), RULES).collect() == []
