"""Planted bad hosts, domains and suffixes against a plain version of the three levels of shrinkage."""

import collections
import math
import random

import pytest

from quillspark.llm import reputation


def parts(host):
    labels = host.split(".")
    two = ".".join(labels[-2:])
    if two in reputation.LONG_SUFFIXES:
        return two, ".".join(labels[-3:]), host
    return labels[-1], two, host


def brute(outcomes):
    """Posterior (a, b) of every suffix, domain and host, and of the corpus."""
    counts = collections.Counter(), collections.Counter()
    for host, bad in outcomes:
        counts[0][host] += bad
        counts[1][host] += 1
    k, n = sum(counts[0].values()) + 0.5, sum(counts[1].values()) + 1
    known = {"": (k, n - k)}
    for level in range(3):
        groups = collections.defaultdict(lambda: [0, 0])
        for host in counts[1]:
            own = groups[parts(host)[level], parts(host)[level - 1] if level else ""]
            own[0] += counts[0][host]
            own[1] += counts[1][host]
        mean = {key: known[key[1]][0] / sum(known[key[1]]) for key in groups}
        over = sum((k - n * mean[key]) ** 2 - n * mean[key] * (1 - mean[key]) for key, (k, n) in groups.items())
        room = sum(n * (n - 1) * mean[key] * (1 - mean[key]) for key, (k, n) in groups.items())
        strength = 1 / (min(0.9, max(1e-3, over / room)) if room else 0.5) - 1
        # a name that is its own parent is judged at the lower level
        known |= {key[0]: (mean[key] * strength + k, (1 - mean[key]) * strength + n - k) for key, (k, n) in groups.items()}
    return known


def test_planted_bad_hosts_are_blocked(spark):
    rng = random.Random(12)
    rates = {"bad.mixed.com": 0.9, "ok.mixed.com": 0.1, "rare.mixed.com": 0.9, "a.rotten.net": 0.8, "b.rotten.net": 0.85, "x.one.zz": 0.7, "y.two.zz": 0.75, "z.three.zz": 0.8, "f.fine.co.uk": 0.05}
    sizes = {"rare.mixed.com": 2}
    rates |= {f"h{k}.clean{k % 9}.org": 0.1 for k in range(40)}
    outcomes = [(host, int(rng.random() < rate)) for host, rate in rates.items() for _ in range(sizes.get(host, 80))]
    rows = [(f"http://{host}/p{k}", bad) for k, (host, bad) in enumerate(outcomes)]
    hosts = [*rates, "new.rotten.net", "new.two.zz", "new.four.zz", "new.mixed.com", "new.clean1.org", "g.other.co.uk", "unseen.qq"]
    pages = spark.createDataFrame([(k, f"https://{h.upper()}/x?y") for k, h in enumerate(hosts)] + [(900, None)], "page_id long, url string")
    got = {r.page_id: r for r in reputation.judge(pages, spark.createDataFrame(rows, "url string, bad int"), []).collect()}
    known = brute(outcomes)
    limit = 1.5 * known[""][0] / sum(known[""])
    verdicts = {}
    for k, host in [*enumerate(hosts), (900, "")]:
        suffix, domain, _ = parts(host) if host else ("", "", "")
        a, b = next(known[x] for x in (host, domain, suffix, "") if x in known)
        rate = a / (a + b)
        bound = rate - 1.645 * math.sqrt(rate * (1 - rate) / (a + b + 1))
        assert got[k].bad_rate == pytest.approx(rate) and got[k].bad_bound == pytest.approx(bound), host
        verdicts[host] = got[k].verdict
        assert got[k].verdict == ("block" if bound > limit else "allow"), host
    blocked = {h for h, v in verdicts.items() if v == "block"}
    assert {"bad.mixed.com", "a.rotten.net", "b.rotten.net", "x.one.zz", "new.rotten.net"} <= blocked
    assert not blocked & {"ok.mixed.com", "f.fine.co.uk", "new.clean1.org", "unseen.qq", "", *(h for h in rates if "clean" in h)}
