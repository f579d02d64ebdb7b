"""URL filters: host and path rules, and a character language-model ratio for the other URLs.

Two smoothed variable-order Markov models, of URLs that rules allow and of
URLs that rules block, predict each character from the two before it, backing
off to one and to none. A URL without a rule is judged by the difference of
the two log likelihoods per character against a calibrated threshold. Counting,
smoothing, scoring and calibration are joins and aggregations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortab.llm.common import stage

# (verdict, host, path prefix): fixed values of the contract.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"),
         ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
SYMBOLS = "abcdefghijklmnopqrstuvwxyz0-./:?=&_"  # digits fold to 0, other characters to ~
ALPHABET = len(SYMBOLS) + 2                        # with ~ and the start mark ^


def host_of(url: Column) -> Column:
    return F.translate(_split(url, "host"), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return _split(url, "path")


def _split(url: Column, part: str) -> Column:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + F.lit(3))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    if part == "host":
        return F.coalesce(host, F.lit(""))
    tail = F.substr(rest, F.char_length(host) + F.lit(1))
    return F.coalesce(F.regexp_extract(tail, r"^[^?#]*", 0), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """(rule, verdict) struct of the longest rule that fits; null where none does."""
    ordered = sorted(rules, key=lambda r: -len(r[1] + r[2]))

    def fits(r):
        return ((host == r[1]) | host.endswith("." + r[1])) & path.startswith(r[2])

    cases = [F.when(fits(r), F.struct(F.lit(r[1] + r[2]).alias("rule"), F.lit(r[0]).alias("verdict"))) for r in ordered]
    return F.coalesce(*cases)


def grams(df: DataFrame, url: str = "url") -> DataFrame:
    """One row per character of the folded URL: the two characters before it (a, b) and itself (c)."""
    folded = F.regexp_replace(F.regexp_replace(F.lower(F.col(url)), "[0-9]", "0"),
                              "[^" + SYMBOLS.replace("-", "\\-").replace(".", "\\.") + "]", "~")
    padded = F.concat(F.lit("^^"), folded)
    starts = F.when(F.char_length(folded) > 0, F.sequence(F.lit(1), F.char_length(folded))).otherwise(F.array())
    return (df.withColumn("__p", padded).withColumn("__i", F.explode(starts))
            .withColumn("__g", F.substr("__p", F.col("__i"), F.lit(3))).drop("__p", "__i"))


def gram_table(counts: DataFrame) -> DataFrame:
    """Log-likelihood ratio of every counted trigram, at most ALPHABET ** 3 rows.

    ``counts``: g (three characters), ok and bad (times in allowed and blocked
    URLs). Each class's probability is Witten-Bell smoothed: a context's own
    estimate is mixed with that of the context one shorter by the number of
    different characters seen after it, down to a uniform distribution, so a
    context never seen passes the shorter one's estimate on unchanged.
    """
    t = counts.select("g", F.substring("g", 1, 2).alias("ab"), F.substring("g", 2, 1).alias("b"),
                      F.substring("g", 2, 2).alias("bc"), F.substring("g", 3, 1).alias("c"), "ok", "bad")

    def sums(df, keys, name):
        out = [F.sum(k).alias(f"{name}_{k}") for k in ("ok", "bad")]
        return df.groupBy(*keys).agg(*out)

    def context(df, keys, char, name):
        per = df.groupBy(*keys, char).agg(F.sum("ok").alias("ok"), F.sum("bad").alias("bad"))
        out = [f(k).alias(f"{name}_{k}") if kind == "n" else F.sum((F.col(k) > 0).cast("long")).alias(f"{name}t_{k}")
               for k in ("ok", "bad") for kind, f in (("n", F.sum), ("t", F.sum))]
        return per.groupBy(*keys).agg(*out) if keys else per.agg(*out)

    uni = sums(t, ["c"], "c1")
    pair = sums(t, ["b", "c"], "c2").withColumn("bc", F.concat("b", "c")).drop("b", "c")
    one = context(t, ["b"], "c", "x2")
    two = context(t, ["ab"], "c", "x3")
    total = context(t.withColumn("k", F.lit(1)), ["k"], "c", "x1")
    j = (t.withColumn("k", F.lit(1)).join(F.broadcast(uni), "c").join(F.broadcast(pair), "bc")
         .join(F.broadcast(one), "b").join(F.broadcast(two), "ab").join(F.broadcast(total), "k"))

    def p(cls):
        low = F.lit(1.0 / ALPHABET)
        for n, num in ((1, f"c1_{cls}"), (2, f"c2_{cls}"), (3, cls)):
            seen, types = F.col(f"x{n}_{cls}"), F.col(f"x{n}t_{cls}")
            low = F.when(seen > 0, (F.col(num) + types * low) / (seen + types)).otherwise(low)
        return low

    return j.select("g", (F.log(p("ok")) - F.log(p("bad"))).alias("llr"))


def url_scores(urls: DataFrame, table: DataFrame) -> DataFrame:
    """Mean log-likelihood ratio per character of each distinct URL (0 for an empty one)."""
    g = grams(urls.select("url"))
    return (g.join(F.broadcast(table), g["__g"] == table["g"], "left").groupBy("url")
            .agg((F.sum(F.coalesce("llr", F.lit(0.0))) / F.count("*")).alias("score")))


def url_filter(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES) -> DataFrame:
    """Per row: id, host, path, rule (null where none fits), verdict, score (null where a rule decides).

    The models learn from the distinct URLs that rules allow and block. The
    threshold is calibrated on them: the point as many standard deviations
    below the allowed mean as above the blocked one. A score at or above it
    allows. Only the trigram table is broadcast; it has at most ALPHABET ** 3
    (about 50,000) rows however many pages there are.

    Defined results: a null URL or one without ``://`` has empty host and path
    and is judged by its characters; an empty or null URL scores 0; without
    both allowed and blocked URLs the threshold is 0 and URLs of score 0 are
    allowed. Repeated rows get equal results, null ids stay, an empty table
    gives an empty one, other columns are not read.
    """
    src = pages.select(F.col(id_col).alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"))
    url = F.col("url")
    urls = stage(src.groupBy("url").agg(F.lit(1).alias("one"))
                 .select("url", host_of(url).alias("host"), path_of(url).alias("path"))
                 .withColumn("r", rule_of(F.col("host"), F.col("path"), rules)), "urls")
    known = urls.where("r IS NOT NULL").select("url", (F.col("r.verdict") == "allow").cast("long").alias("ok"))
    rest = grams(urls.where("r IS NULL").select("url", F.lit(None).cast("long").alias("ok")))
    seen = grams(known)
    counts = (seen.unionByName(rest).groupBy(F.col("__g").alias("g"))
              .agg(F.coalesce(F.sum("ok"), F.lit(0)).alias("ok"), F.coalesce(F.sum(1 - F.col("ok")), F.lit(0)).alias("bad")))
    table = stage(gram_table(counts), "url-grams")
    scored = stage(url_scores(urls, table), "url-scores")
    joined = urls.join(scored, "url", "left").withColumn("score", F.coalesce("score", F.lit(0.0)))
    by = joined.where("r IS NOT NULL").groupBy().agg(
        *[f(F.when(F.col("r.verdict") == v, F.col("score"))).alias(f"{n}_{v}")
          for v in ("allow", "block") for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    cut = 0.0
    if by["m_allow"] is not None and by["m_block"] is not None:
        spread = by["s_allow"] + by["s_block"]
        weight = by["s_block"] / spread if spread > 0 else 0.5
        cut = by["m_block"] + weight * (by["m_allow"] - by["m_block"])
    verdict = F.coalesce(F.col("r.verdict"), F.when(F.col("score") >= F.lit(cut), "allow").otherwise("block"))
    judged = joined.select("url", "host", "path", F.col("r.rule").alias("rule"), verdict.alias("verdict"),
                           F.when(F.col("r").isNull(), F.col("score")).alias("score"))
    return (src.join(judged, "url").select(F.col("id").alias(id_col), "host", "path", "rule", "verdict", "score"))


__all__ = ["RULES", "url_filter", "gram_table", "grams", "host_of", "path_of", "rule_of"]
