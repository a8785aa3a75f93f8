"""Allow and block lists for URLs, with boosted trees for the URLs no rule speaks of.

A rule is a host and a path: it fits the host and its subdomains where the URL's path starts with the
rule's path, and the longest fitting rule decides. The URLs that rules decide are the labelled ones: on lexical
features (length, depth, digit ratio, entropy, parameter counts, statistics of host and file suffixes)
gradient-boosted trees learn from them and judge the rest. Features are SQL expressions and the trees
are Spark's own; suffix statistics are counted over every labelled URL.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.functions import vector_to_array
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidewatt.plans.sizing import attach, measured

from .common import durable, slim

#: Labelled URLs the trees are fitted on, at most (smallest hashes of the URL).
TRAIN_ROWS = 20_000
TREES, DEPTH, RATE = 20, 4, 0.2
#: Pseudo-counts of the overall rate in the rate of a suffix.
PRIOR = 5.0
SUFFIXES = ("tld", "site", "file", "folder")
ALLOW, BLOCK = "allow", "block"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host, A-Z lower-cased, and path of a URL; both empty without ``://``."""
    text = F.coalesce(url, F.lit(""))
    at = F.locate("://", text)
    rest = F.when(at > 0, F.substring(text, at + 3, F.length(text))).otherwise(F.lit(""))
    host = F.regexp_extract(rest, r"^([^/?#]*)", 1)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^([^?#]*)", 1)
    return F.translate(host, _UPPER, _LOWER), path


def split_rule(rule: str) -> tuple[str, str]:
    host, slash, path = rule.partition("/")
    return host, slash + path


def longest_rule(host: Column, path: Column, rules: dict[str, str]) -> tuple[Column, Column]:
    """The longest fitting rule and its verdict, null where none fits.

    ``rules`` maps texts like ``example.com/en/`` to a verdict. It is a list written by hand: each rule is one
    branch of an expression.
    """
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for rule in sorted(rules, key=lambda r: (len(r), r)):
        where, start = split_rule(rule)
        fits = ((host == where) | host.endswith(f".{where}")) & path.startswith(start)
        name, verdict = F.when(fits, F.lit(rule)).otherwise(name), F.when(fits, F.lit(rules[rule])).otherwise(verdict)
    return name, verdict


def entropy(text: Column) -> Column:
    """Shannon entropy in bits of the characters; all beyond ASCII count as one character."""
    plain = F.regexp_replace(text, r"[^\x00-\x7F]", "\u007f")
    n = F.length(plain)
    letters = F.array_distinct(F.filter(F.split(plain, ""), lambda c: c != ""))

    def share(c):
        return (n - F.length(F.replace(plain, c, F.lit("")))) / n

    bits = F.aggregate(letters, F.lit(0.0), lambda s, c: s - share(c) * F.log2(share(c)))
    return F.when(n > 0, bits).otherwise(0.0)


def lexical(url: Column, host: Column, path: Column) -> dict[str, Column]:
    """Features of the text alone, as doubles."""
    text = F.coalesce(url, F.lit(""))
    query = F.regexp_extract(text, r"^[^?#]*\?([^#]*)", 1)
    segments = F.size(F.filter(F.split(path, "/"), lambda s: s != ""))
    labels = F.size(F.filter(F.split(host, r"\."), lambda s: s != ""))

    def kept(pattern):
        return F.length(F.regexp_replace(text, pattern, ""))

    values = {
        "length": F.length(text), "host_length": F.length(host), "path_length": F.length(path), "depth": segments, "labels": labels,
        "digit_ratio": kept("[^0-9]") / F.greatest(F.lit(1), F.length(text)), "entropy": entropy(text), "host_entropy": entropy(host),
        "parameters": F.size(F.filter(F.split(query, "[&;]"), lambda p: p != "")), "query_length": F.length(query),
        "hyphens": kept("[^-]"), "fragment": text.contains("#").cast("int"), "secure": F.lower(F.substring(text, 1, 6)).eqNullSafe(F.lit("https:")).cast("int"),
    }
    return {k: v.cast("double") for k, v in values.items()}


def suffixes(host: Column, path: Column) -> dict[str, Column]:
    """Last label of the host, its last two labels, what follows the last dot of the path's last segment, and the path's first folder."""
    last = F.substring_index(F.when(path.endswith("/"), F.substring(path, F.lit(1), F.length(path) - 1)).otherwise(path), "/", -1)
    file = F.when(last.contains("."), F.concat(F.lit("."), F.substring_index(last, ".", -1))).otherwise("")
    return {"tld": F.substring_index(host, ".", -1), "site": F.substring_index(host, ".", -2), "file": file, "folder": F.regexp_extract(path, "^/([^/]*)/", 1)}


def with_features(pages: DataFrame, rules: dict[str, str]) -> DataFrame:
    """(page_id, url) with host, path, rule, ruled, lexical features and suffixes."""
    host, path = host_and_path(F.col("url"))
    rows = pages.withColumns({"host": host, "path": path})
    rule, verdict = longest_rule(F.col("host"), F.col("path"), rules)
    rows = rows.withColumns({"rule": rule, "ruled": verdict})
    return rows.withColumns(lexical(F.col("url"), F.col("host"), F.col("path")) | suffixes(F.col("host"), F.col("path")))


def fold(url: Column) -> Column:
    return F.pmod(F.xxhash64(url), F.lit(2))


def suffix_rates(rows: DataFrame) -> dict[str, tuple]:
    """Per kind of suffix and half of the URLs (by hash): how many labelled URLs have it, how many are blocked."""
    labelled = rows.where("ruled is not null").withColumn("half", fold(F.col("url")))
    out = {}
    for kind in SUFFIXES:
        counts = {}
        for i in (0, 1):
            mine = F.col("half") == i
            counts |= {f"{kind}_seen{i}": F.count_if(mine), f"{kind}_blocked{i}": F.count_if(mine & (F.col("ruled") == BLOCK))}
        seen, profile = measured(labelled, [kind], **counts)
        out[kind] = (seen.drop("n_obs"), profile)
    return out


def with_rates(rows: DataFrame, rates: dict, overall: float, teach: bool) -> tuple[DataFrame, list[str]]:
    """Shrunken share of blocked URLs and log count of each suffix.

    A row to ``teach`` with takes them from the other half of the URLs, so that its own label is not in
    them; other rows take the mean of both halves.
    """
    names = []
    for kind, (table, profile) in rates.items():
        rows = attach(rows, table, [kind], profile)

        def half(what):
            one, two = (F.coalesce(F.col(f"{kind}_{what}{i}"), F.lit(0)).cast("double") for i in (0, 1))
            return F.when(fold(F.col("url")) == 0, two).otherwise(one) if teach else (one + two) / 2

        seen, blocked = half("seen"), half("blocked")
        rows = rows.withColumns({f"{kind}_rate": (blocked + PRIOR * overall) / (seen + PRIOR), f"{kind}_count": F.log1p(seen)})
        rows = rows.drop(*[f"{kind}_{what}{i}" for what in ("seen", "blocked") for i in (0, 1)])
        names += [f"{kind}_rate", f"{kind}_count"]
    return rows, names


def judge(
    pages: DataFrame, rules: dict[str, str], train_rows: int = TRAIN_ROWS, trees: int = TREES, id_col: str = "page_id", url_col: str = "url",
    held_out: Column | None = None,
) -> DataFrame:
    """One row per row: page_id, host, path, rule, verdict, score.

    ``score`` is the trees' probability of ``block``, given for every row; ``verdict`` is the rule's where one fits, else
    ``block`` from one half on. The trees are fitted on at most ``train_rows`` URLs that rules decide (the smallest hashes);
    ``held_out`` (an expression over page_id, url, host, path) keeps rows out of the fit and of the suffix
    statistics. If all labelled URLs have one verdict it is given to all; without labelled URLs the score is zero: allow. Null
    URLs and those without ``://`` have an empty host and path, fit no rule and are judged on the features of their text. URLs of any length are read
    whole. Repeated rows and null ids are kept, equal URLs get equal verdicts; an empty table gives an
    empty result; other columns are ignored.
    """
    rows = with_features(slim(pages, page_id=id_col, url=url_col), rules)
    lexicals = list(lexical(F.col("url"), F.col("host"), F.col("path")))
    taught = rows if held_out is None else rows.withColumn("ruled", F.when(~F.coalesce(held_out, F.lit(False)), F.col("ruled")))
    blocked, labelled = taught.agg(F.count_if(F.col("ruled") == BLOCK), F.count("ruled")).first()
    result = ["page_id", "host", "path", "rule"]
    if blocked in (0, labelled):
        score = F.lit(1.0 if blocked else 0.0)
        scored = rows.withColumn("score", score)
    else:
        rates = suffix_rates(taught)
        seen, names = with_rates(taught.where("ruled is not null"), rates, blocked / labelled, teach=True)
        columns = [*lexicals, *names]
        chosen = seen.select(*columns, (F.col("ruled") == BLOCK).cast("double").alias("label"), F.xxhash64("url").alias("at"), "url")
        # One partition in a fixed order, so that the trees do not depend on how the rows were dealt.
        chosen = durable(chosen.orderBy("at", "url").limit(train_rows).coalesce(1).drop("at", "url"))
        assembler = VectorAssembler(inputCols=columns, outputCol="features")
        booster = GBTClassifier(maxIter=trees, maxDepth=DEPTH, stepSize=RATE, seed=1)
        model = booster.fit(assembler.transform(chosen).select("features", "label"))
        open_rows, _ = with_rates(rows, rates, blocked / labelled, teach=False)
        scored = model.transform(assembler.transform(open_rows)).withColumn("score", vector_to_array("probability")[1])
    own = F.when(F.col("score") >= 0.5, BLOCK).otherwise(ALLOW)
    return scored.select(*result, F.coalesce("ruled", own).alias("verdict"), "score")
