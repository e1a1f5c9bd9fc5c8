import math
from collections import Counter

from lektra.llm import urls


def slow(url):
    if url is None or "://" not in url:
        return "", "", None, None
    rest = url.split("://", 1)[1]
    cut = min([rest.find(c) for c in "/?#" if c in rest], default=len(rest))
    host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:cut])
    rest = rest[cut:]
    path = rest[: min([rest.find(c) for c in "?#" if c in rest], default=len(rest))]
    fits = [r for r in urls.RULES if (host == r.host or host.endswith("." + r.host)) and path.startswith(r.path)]
    best = max(fits, key=lambda r: len(r.name), default=None)
    return host, path, best and best.name, best and best.verdict


def symbols(host, path):
    low = (host + path).lower()
    return "^" + "".join("0" if c.isdigit() else c if c in "abcdefghijklmnopqrstuvwxyz/._-" else "~" for c in low) + "$"


def slow_scores(train, texts):
    """Witten-Bell with recursion, and the longest sequence that was seen at each place."""
    counts = {x: Counter(s[i : i + n] for t, label in train if label == x for s in [symbols(*t)] for i in range(len(s)) for n in range(1, 5) if i + n <= len(s)) for x in ("allow", "block")}
    total, kinds = {x: Counter() for x in counts}, {x: Counter() for x in counts}
    for x in counts:
        for s, n in counts[x].items():
            total[x][s[:-1], len(s)] += n
            kinds[x][s[:-1], len(s)] += 1

    def p(x, s):
        shorter = 1 / urls.ALPHABET if len(s) == 1 else p(x, s[1:])
        n, k = total[x][s[:-1], len(s)], kinds[x][s[:-1], len(s)]
        return (counts[x][s] + k * shorter) / (n + k) if n else shorter

    out = []
    for t in texts:
        s, score = symbols(*t), 0.0
        for end in range(1, len(s) + 1):
            for n in range(min(4, end), 0, -1):
                seq = s[end - n : end]
                if counts["allow"][seq] or counts["block"][seq]:
                    score += math.log(p("allow", seq) / p("block", seq))
                    break
        out.append(score / len(s))
    return out


def test_against_brute_force(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    rows = {r.page_id: r for r in urls.judged(pages).collect()}
    held = {r.page_id for r in spark.createDataFrame([(k, r.host, r.path) for k, r in rows.items()], "page_id long, host string, path string").filter("pmod(xxhash64(host, path), 5) = 0").collect()}
    train = [((r.host, r.path), r.verdict) for k, r in rows.items() if r.rule is not None and k not in held]
    wanted = slow_scores(train, [(r.host, r.path) for r in rows.values()])
    for r, score in zip(rows.values(), wanted):
        assert abs(r.score - score) < 1e-9
        assert r.rule is not None or r.verdict == ("allow" if r.score >= r.threshold else "block")
    for p in pages.select("page_id", "url").collect():
        r = rows[p.page_id]
        host, path, rule, verdict = slow(p.url)
        assert (r.host, r.path, r.rule) == (host, path, rule) and (verdict is None or r.verdict == verdict)
    tested = [r for k, r in rows.items() if r.rule is not None and k in held]
    assert sum((r.score >= r.threshold) == (r.verdict == "allow") for r in tested) >= 0.9 * len(tested)


def test_odd_urls(spark):
    odd = ["HTTP://EXAMPLE.net/en/x", "http://a.net", "http://a.net?x/", "http://notnet/en/", "http://net/", "x://y://net/", "://net/#", "example.net/en/", "http://xexample.com/de/", "http://B.example.com/de/?q#r", "http://x.org/fr/\nz?a", "", "http://", "http://Ünet.net/É", None]
    docs = spark.createDataFrame([(i % 3 if i else None, u, "v") for i, u in enumerate(odd)], "page_id long, url string, verdict string")
    got = urls.judged(docs).collect()
    assert sorted((r.host, r.path, r.rule or "") for r in got) == sorted((h, p, r or "") for h, p, r, _ in map(slow, odd))
    assert all(r.verdict in ("allow", "block") for r in got)
    assert urls.judged(spark.createDataFrame([], docs.schema)).count() == 0


def test_plan_is_native(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    plan = urls.judged(pages)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
