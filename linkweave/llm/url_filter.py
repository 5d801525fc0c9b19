"""URL filter by the ratio of two character language models (operator 10), DataFrame functions only.

Rules decide the URLs they fit, by host and path.  The URLs that rules accept
and reject train two smoothed variable-order Markov models over characters;
every URL without a rule gets the mean per-character difference of the two
models' log-likelihoods and is allowed when it reaches a threshold calibrated on
the ruled URLs.

Counts are taken over all URLs.  Equal model strings are merged first (digits
are read as one class), positions are pre-aggregated to distinct n-grams, and
lower orders are summed from the highest, so the shuffles carry distinct grams.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from linkweave.llm.common import fixed, lower_ascii, small

ORDER = 5  # longest n-gram: four characters of context
STRENGTH = 2.0  # pseudo-counts that the next lower order contributes
BROADCAST_GRAMS = 200_000  # rows of (gram, ratio), under 20 MB
#: (verdict, host, path)
RULES = (
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
)


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lowered) and path of a URL; both empty without ``://``."""
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    return lower_ascii(F.regexp_extract(rest, r"^([^/?#]*)", 1)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def best_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """(rule string, verdict) of the longest rule that fits, else nulls."""
    name, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for v, h, p in sorted(rules, key=lambda r: len(r[1] + r[2])):  # the longest is tested first, hence wrapped last
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        name, verdict = F.when(fits, F.lit(h + p)).otherwise(name), F.when(fits, F.lit(v)).otherwise(verdict)
    return name, verdict


def _positions(strings: DataFrame) -> DataFrame:
    """One row per character after the start mark: the n-gram that ends there, up to ORDER characters."""
    at = F.posexplode(F.sequence(F.lit(2), F.length("s")))
    rows = strings.where(F.length("s") >= 2).select("*", at.alias("_p", "i")).drop("_p")
    begin = F.greatest(F.col("i") - (ORDER - 1), F.lit(1))
    return rows.withColumn("gram", F.substring(F.col("s"), begin, F.col("i") - begin + 1)).drop("i")


def _suffix(k: int) -> Column:
    return F.expr(f"right(gram, {k})")


def model(strings: DataFrame) -> DataFrame:
    """(gram, ratio): log p_allow - log p_block of a gram's last character after its context.

    ``strings`` has (s, n_allow, n_block).  The probability of order k blends the
    counts with STRENGTH pseudo-counts of order k - 1; order 0 is uniform.
    """
    grams = fixed(_positions(strings).groupBy("gram").agg(F.sum("n_allow").cast("double").alias("allow"), F.sum("n_block").cast("double").alias("block")))
    letters = max(1, grams.select(_suffix(1)).distinct().count())
    out = grams.select("gram").withColumns({"p_allow": F.lit(1.0 / letters), "p_block": F.lit(1.0 / letters)})
    for k in range(1, ORDER + 1):
        long = grams.where(F.length("gram") >= k)
        seen = long.groupBy(_suffix(k).alias(f"g{k}")).agg(F.sum("allow").alias("na"), F.sum("block").alias("nb"))
        ctx = long.groupBy(F.expr(f"left(right(gram, {k}), {k - 1})").alias(f"c{k}")).agg(F.sum("allow").alias("ca"), F.sum("block").alias("cb"))
        table = seen.join(ctx, F.expr(f"left(g{k}, {k - 1})") == F.col(f"c{k}")).select(f"g{k}", "na", "nb", "ca", "cb")
        out = out.join(table, (F.length("gram") >= k) & (_suffix(k) == F.col(f"g{k}")), "left")

        def blend(n: str, c: str, p: str) -> Column:
            return F.when(F.col(f"g{k}").isNull(), F.col(p)).otherwise((F.col(n) + STRENGTH * F.col(p)) / (F.col(c) + STRENGTH))

        out = out.select("gram", blend("na", "ca", "p_allow").alias("p_allow"), blend("nb", "cb", "p_block").alias("p_block"))
    return fixed(out.select("gram", (F.log("p_allow") - F.log("p_block")).alias("ratio")))


def judge(pages: DataFrame, rules=RULES, whole_url: bool = False) -> DataFrame:
    """One row per page: page_id, host, path, rule, verdict, ratio.

    The models read host and path, or with ``whole_url`` (as the query does) the
    URL as it stands, scheme, query string and fragment included.  ``ratio``
    is the mean per-character log-likelihood difference (null when a class has
    no ruled URL to learn from; such URLs are allowed).  Null URLs have
    empty host and path and are judged like the empty string.  Repeated rows are
    judged alike; an empty table gives an empty result.
    """
    rows = pages.select(F.col("page_id").alias("page_id"), F.col("url").cast("string").alias("url"))
    host, path = host_and_path(F.col("url"))
    read = F.coalesce("url", F.lit("")) if whole_url else F.concat("host", "path")
    rows = rows.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = best_rule(F.col("host"), F.col("path"), rules)
    text = F.concat(F.lit("\x02"), F.regexp_replace(read, "[0-9]", "0"), F.lit("\x03"))
    rows = rows.select("page_id", "host", "path", rule.alias("rule"), verdict.alias("ruled"), text.alias("s"))
    strings = fixed(rows.groupBy("s").agg(F.count_if(F.col("ruled") == "allow").alias("n_allow"), F.count_if(F.col("ruled") == "block").alias("n_block")))
    ratios = model(strings)
    n = ratios.count()
    scored = _positions(strings).join(small(ratios, n, BROADCAST_GRAMS), "gram")
    scored = fixed(scored.groupBy("s", "n_allow", "n_block").agg(F.avg("ratio").alias("ratio")))

    def moments(weight: str):
        w, x = F.col(weight), F.col("ratio")
        return [F.sum(w), F.sum(w * x) / F.sum(w), F.sqrt(F.greatest(F.sum(w * x * x) / F.sum(w) - F.pow(F.sum(w * x) / F.sum(w), 2), F.lit(0.0)))]

    na, ma, sa, nb, mb, sb = scored.agg(*[m.alias(f"m{i}") for i, m in enumerate([*moments("n_allow"), *moments("n_block")])]).first()
    learned = bool(na) and bool(nb)
    # Between the class means, nearer to the class that spreads less.
    threshold = ((ma * (sb + 1e-9) + mb * (sa + 1e-9)) / (sa + sb + 2e-9)) if learned else 0.0
    by_string = scored.select(F.col("s").alias("_s"), (F.col("ratio") if learned else F.lit(None).cast("double")).alias("ratio"))
    out = rows.join(by_string, F.col("s") == F.col("_s"), "left")
    own = F.when(F.col("ratio").isNull() | (F.col("ratio") >= threshold), "allow").otherwise("block")
    return out.select("page_id", "host", "path", "rule", F.coalesce("ruled", own).alias("verdict"), "ratio")
