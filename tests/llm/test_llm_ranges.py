"""Stated ranges, notices edited at their ends, and site posteriors in plain Python."""

import math
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tidewatt.llm import license_scan, site_quality, suffix_dedup

NOTICES = [n for n in (license_scan.Notice(p, label) for p, label in (license_scan.BASE | license_scan.NOTICES).items()) if n.edits]
EDIT = st.tuples(st.sampled_from("ids"), st.one_of(st.sampled_from([0, 1, -1]), st.integers(0, 60)), st.sampled_from("abcglx "))


@settings(max_examples=1500, deadline=None)
@given(st.sampled_from(NOTICES), st.lists(EDIT, min_size=1, max_size=4), st.sampled_from(["", "x ", "some words "]), st.sampled_from(["", " y", " and more"]))
def test_a_notice_in_the_line_is_found(notice, edits, before, after):
    letters = list(notice.phrase)
    for kind, at, letter in edits[: notice.edits]:
        at = at % (len(letters) + 1) if at >= 0 else len(letters)
        if kind == "i":
            letters.insert(at, letter)
        elif at < len(letters):
            letters[at : at + 1] = [] if kind == "d" else [letter]
    line = " " + " ".join((before + "".join(letters) + after).split()) + " "
    whole = notice.bounded.search(line)
    found = notice.spans(line.encode())
    if whole and whole.group().strip():
        assert found and min(e for e, _ in found.values()) <= sum(whole.fuzzy_counts)


def windows_gone(rows, length):
    seen, gone = set(), defaultdict(set)
    for doc, text in sorted(rows):
        data = text.encode()
        for i in range(len(data) - length + 1):
            w = data[i : i + length]
            if w in seen:
                gone[doc] |= set(range(i, i + length))
            seen.add(w)
    return {doc: len(gone[doc]) for doc, _ in rows}


@pytest.mark.parametrize("length", [32, 100, 286])
def test_lengths_in_range(spark, length):
    base = " ".join(f"word{i * i % 97} and {i}" for i in range(120))
    rows = [(1, base), (2, "before " + base[50:700] + " after"), (3, base[:300] + "!" + base[300:]), (4, "ab" * 400), (5, base[5 : 5 + length]), (6, base[5 : 4 + length])]
    got = suffix_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length=length, parts=2).collect()
    assert {r["doc_id"]: sum(s["end"] - s["start"] for s in r["removed"]) for r in got} == windows_gone(rows, length)


@pytest.mark.parametrize("length", [0, 31, 287, 400])
def test_lengths_out_of_range(spark, length):
    with pytest.raises(ValueError):
        suffix_dedup.remove_repeats(spark.createDataFrame([(1, "x")], "doc_id long, text string"), length=length)


def test_posterior_in_plain_python(spark):
    rows = [(i, f"h{i % 4}" if i % 11 else None, f"p{i % 3}", 0.02 + 0.95 * ((i * 37) % 89) / 89 * (0.3 + 0.2 * (i % 4))) for i in range(240)]
    got = {r["i"]: (r["post"], r["post_path"]) for r in site_quality.posterior(spark.createDataFrame(rows, "i long, host string, path string, p double"), "p", "post").collect()}
    by_path, by_host = defaultdict(list), defaultdict(list)
    for _, h, q, p in rows:
        by_path[h, q].append(p)
        by_host[h].append(p)

    def strength(groups, centre):
        n, total = sum(map(len, groups)), sum(map(sum, groups))
        mu = total / n
        within = sum(sum(p * p for p in g) - sum(g) ** 2 / len(g) for g in groups)
        noise = within / (n - len(groups))
        spread = sum(len(g) * (sum(g) / len(g) - c) ** 2 for g, c in zip(groups, centre))
        tau = (spread - (len(groups) - 1) * noise) / (n - sum(len(g) ** 2 for g in groups) / n)
        kappa = mu * (1 - mu) / tau - 1 if tau > 0 else 1e6
        return mu, min(1e6, max(1.0, kappa))

    everything = sum(by_host.values(), [])
    mu, host_kappa = strength(list(by_host.values()), [sum(everything) / len(everything)] * len(by_host))
    _, path_kappa = strength(list(by_path.values()), [sum(by_host[h]) / len(by_host[h]) for h, _ in by_path])
    logit = lambda x: math.log(x / (1 - x))
    for i, h, q, p in rows:
        host = (host_kappa * mu + sum(by_host[h]) - p) / (host_kappa + len(by_host[h]) - 1)
        path = (path_kappa * host + sum(by_path[h, q]) - p) / (path_kappa + len(by_path[h, q]) - 1)
        want = 1 / (1 + math.exp(-(logit(p) + logit(path) - logit(mu))))
        assert got[i] == (pytest.approx(want, abs=1e-9), pytest.approx(path, abs=1e-9))
