from __future__ import annotations

import random

from pyspark.sql import functions as F

from marquee.llm import url_lists


def plain(captures, entries):
    log: dict[str, dict[int, str]] = {}
    order = {"block": 2, "allow": 1, "remove": 0}
    for pattern, action, at in entries:
        if None not in (pattern, action, at):
            day = log.setdefault(pattern, {})
            day[at] = max(day.get(at, action), action, key=order.get)
    out = []
    for key, url, at in captures:
        best, n = None, 0
        if url and "://" in url and at is not None:
            host, _, path = url.partition("://")[2].partition("?")[0].partition("#")[0].partition("/")
            host = host.rpartition("@")[2].partition(":")[0].lower().rstrip(".")
            whole = "/".join([host, *[p for p in path.split("/") if p]]) + "/"
            for pattern, days in log.items():
                fits = whole.startswith(pattern + "/") or ("/" not in pattern and host.endswith("." + pattern))
                past = [d for d in days if d <= at]
                if host and fits and past and days[max(past)] != "remove":
                    n += 1
                    best = max(best or (-1,), (pattern.count("/"), len(pattern), pattern, days[max(past)]))
        out.append((key, url, at, best[3] if best else "none", best[2] if best else None, n))
    return out


def test_against_brute_force(spark):
    rng = random.Random(1)
    hosts = ["a.x.org", "x.org", "b.a.x.org", "y.net", "org", "localhost"]
    paths = ["", "/", "/p", "/p/q", "/p//q/r", "/pq"]
    captures = [
        (i, rng.choice(["http://", "HTTPS://u:p@"]) + rng.choice(hosts).upper() + rng.choice(["", ":80"]) + rng.choice(paths) + rng.choice(["", "?u=/p", "#f"]), rng.randint(0, 400))
        for i in range(400)
    ]
    captures += [(1, *captures[1][1:]), (500, None, 5), (501, "http://x.org/p", None), (502, "nothing", 5), (None, "http://x.org", 399)]
    patterns = [h + p for h in hosts for p in ("", "/p", "/p/q")]
    entries = [(rng.choice(patterns), rng.choice(["block", "allow", "remove"]), rng.randint(0, 400)) for _ in range(300)]
    entries += [(None, "block", 1), ("x.org", None, 1), ("x.org", "block", None), entries[0]]
    cap = spark.createDataFrame(captures, "page_id long, url string, fetched long").withColumn("pattern", F.lit("clash"))
    ent = spark.createDataFrame(entries, "pattern string, action string, at long")
    got = [tuple(r) for r in url_lists.judge(cap, ent).collect()]
    assert sorted(got, key=str) == sorted(plain(captures, entries), key=str)
    assert url_lists.judge(cap.limit(0), ent).collect() == []
    assert {r.verdict for r in url_lists.judge(cap, ent.limit(0)).collect()} == {"none"}
