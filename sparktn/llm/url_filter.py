"""URL filters by association rules: Spark's FP-growth mines combinations of URL tokens that imply a verdict.

Labels come with the URLs, in the query from a list of known (host, path) rules; URLs that no known rule fits
are judged by the mined ones. Those are counted in all labelled URLs, pruned by support and confidence, and matched, all by
an inverted index: a rule fits where as many of its tokens meet the URL's as it has.
"""

from __future__ import annotations

from pyspark.ml.fpm import FPGrowth
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import small, stored

#: Least share of the labelled URLs and least confidence of a rule; tokens of a rule at most; the verdict where no rule fits.
SUPPORT, CONFIDENCE, LONGEST, DEFAULT = 0.002, 0.8, 3, "allow"
#: Labelled URLs that a rule must fit at least, however few there are in all.
LEAST = 3
#: Tokens that FP-growth takes (those that tell most about the verdict), and how many of them a labelled URL is mined by, so
#: that it has at most 2^(BASKET + 1) combinations. Combinations of URLs with more frequent tokens are found by `beyond`.
VOCABULARY, BASKET = 1000, 10
BLOCK, ALLOW = "=block", "=allow"


def host_of(url: Column) -> Column:
    return F.translate(F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def known_rule(host: Column, path: Column, rules: list[tuple[str, str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; rules are (verdict, host, path)."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for kind, h, p in sorted(rules, key=lambda r: (len(r[1] + r[2]), r)):
        fits = ((host == h) | host.endswith(f".{h}")) & path.startswith(p)
        rule, verdict = F.when(fits, h + p).otherwise(rule), F.when(fits, kind).otherwise(verdict)
    return rule, verdict


def tokens(host: Column, path: Column, query: Column) -> Column:
    """Different tokens of a URL: labels of the host with suffixes, words of the path, the shape of its numbers and the query's names."""
    parts = F.split(host, r"\.")
    names = F.transform(F.filter(parts, lambda x: x != ""), lambda x: F.concat(F.lit("h:"), x))
    words = F.transform(F.filter(F.split(F.lower(path), "[^a-z0-9]+"), lambda x: x != ""), lambda x: F.when(F.rlike(x, F.lit("^[0-9]+$")), F.concat(F.lit("p:#"), F.length(x))).otherwise(F.concat(F.lit("p:"), x)))
    asked = F.transform(F.filter(F.split(query, "[?&#]"), lambda x: x != ""), lambda x: F.concat(F.lit("q:"), F.regexp_extract(x, "^([^=]*)", 1)))
    return F.array_distinct(F.concat(names, words, asked))


def judged(pages: DataFrame, rules: list[tuple[str, str, str]]) -> DataFrame:
    """page_id, host, path, rule, known (its verdict or null) and tokens of every row."""
    host, path = host_of(F.col("url")), path_of(F.col("url"))
    rest = F.regexp_extract(F.coalesce(F.col("url"), F.lit("")), r"(?s)^.*?://[^?#]*(.*)$", 1)
    df = pages.select("page_id", host.alias("host"), path.alias("path"), rest.alias("rest"))
    rule, known = known_rule(F.col("host"), F.col("path"), rules)
    return df.select("page_id", "host", "path", rule.alias("rule"), known.alias("known"), tokens(F.col("host"), F.col("path"), F.col("rest")).alias("tokens"))


def telling(labelled: DataFrame, least: float, most: int = VOCABULARY) -> list[str]:
    """The tokens of at least so many labelled URLs that tell most about the verdict, the best first.

    Ranked by how far the count of blocked URLs is from that of a token that tells nothing, in deviations, then
    by count and name.
    """
    share = labelled.agg(F.avg((F.col("known") == "block").cast("double"))).first()[0]
    seen = labelled.select(F.explode("tokens").alias("t"), (F.col("known") == "block").cast("bigint").alias("b")).groupBy("t").agg(F.count("*").alias("n"), F.sum("b").alias("b"))
    far = F.abs(F.col("b") - F.col("n") * share) / F.sqrt(F.col("n") * (share * (1 - share) + 1e-9))
    return [r["t"] for r in seen.where(F.col("n") >= least).orderBy(F.round(far, 6).desc(), F.col("n").desc(), "t").limit(most).collect()]


def mine(labelled: DataFrame, support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """rule_id, tokens, verdict, confidence and support of the rules kept, from the table (tokens, known).

    Mining finds the combinations: a basket holds a labelled URL's most telling tokens, a bounded number, and its verdict.
    Combinations that URLs with more frequent tokens hold are found level by level, so that none is missed. What a combination
    is worth is then counted over all tokens of all labelled URLs, by an inverted index, so support and confidence are true ones. A rule is
    pruned below the support (LEAST rows at least) or the confidence, with more than LONGEST tokens, or if a part of it has
    the same verdict with no less confidence.
    """
    spark = labelled.sparkSession
    n = labelled.count()
    least = max(LEAST, support * n)
    words = telling(labelled, least) if n >= least else []
    if not words:
        return spark.createDataFrame([], "rule_id bigint, tokens array<string>, verdict string, confidence double, support double")
    tokens = F.slice(F.array_intersect(F.lit(words), "tokens"), 1, BASKET)  # in the order of the words
    basket = labelled.select(F.concat(tokens, F.array(F.when(F.col("known") == "block", BLOCK).otherwise(ALLOW))).alias("items"))
    model = FPGrowth(itemsCol="items", minSupport=least / n, minConfidence=confidence).fit(basket)
    sets = model.freqItemsets.select(F.sort_array(F.array_except("items", F.array(F.lit(BLOCK), F.lit(ALLOW)))).alias("tokens"))
    long = longer(labelled, tokens, least)
    sets = sets if long.isEmpty() else sets.unionByName(beyond(long, labelled, n, least))
    rules = stored(counted(sets, labelled, n, least, confidence), "rules")
    part = rules.select(F.explode("tokens").alias("t"), F.col("tokens").alias("small"), F.col("verdict").alias("v"), F.col("confidence").alias("c"))
    larger = rules.select(F.explode("tokens").alias("t"), "tokens", "verdict", "confidence")
    beaten = larger.join(part, "t").where((F.col("v") == F.col("verdict")) & (F.col("c") >= F.col("confidence")) & (F.size("small") < F.size("tokens")) & (F.size(F.array_except("small", "tokens")) == 0)).select("tokens", "verdict").distinct()
    return rules.join(beaten, ["tokens", "verdict"], "left_anti").select(F.xxhash64("tokens").alias("rule_id"), "tokens", "verdict", "confidence", "support")


def longer(labelled: DataFrame, held: Column, least: float) -> DataFrame:
    """url and t: the frequent tokens of the labelled URLs that have more of them than their basket `held`; URLs of equal tokens are one."""
    frequent = labelled.select(F.explode("tokens").alias("t")).groupBy("t").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("t")
    urls = labelled.groupBy("tokens").agg(F.lit(0)).select(F.xxhash64("tokens").alias("url"), "tokens", F.size(held).alias("held"))
    rows = urls.select("url", "held", F.explode("tokens").alias("t")).join(frequent, "t")
    more = rows.groupBy("url").agg(F.count("*").alias("n"), F.min("held").alias("held")).where("n > held").select("url")
    return stored(rows.select("url", "t").join(more, "url"), "longer")


def beyond(long: DataFrame, labelled: DataFrame, n: int, least: float) -> DataFrame:
    """tokens: all sets of LONGEST tokens at most that URLs of `longer` hold and that imply a verdict in enough labelled URLs.

    Sets grow by one token a level, from those that all labelled URLs show to be frequent, so none is missed. A set that no
    such URL holds is in baskets alone, where FP-growth finds it.
    """
    level, found = long.select("url", F.array("t").alias("tokens")), None
    for size in range(1, LONGEST + 1):
        if size > 1:
            level = level.join(long, "url").where(F.col("t") > F.element_at("tokens", -1)).select("url", F.concat("tokens", F.array("t")).alias("tokens"))
        level = stored(level, "level")
        frequent = stored(counted(level.select("tokens").distinct(), labelled, n, least, 0.0).select("tokens").distinct(), "frequent")
        found = frequent if found is None else found.unionByName(frequent)
        level = level.join(frequent, "tokens", "left_semi").select("url", "tokens")
    return found


def counted(sets: DataFrame, labelled: DataFrame, n: int, least: float, confidence: float) -> DataFrame:
    """tokens, verdict, confidence and support of the sets of tokens that are rules, counted in all labelled URLs that hold them.

    Labelled URLs with the same tokens are one row with a count, and meet the sets token by token.
    """
    sets = stored(sets.where(F.size("tokens").between(1, LONGEST)).distinct().select(F.xxhash64("tokens").alias("id"), "tokens"), "sets")
    posted = sets.select("id", F.size("tokens").alias("need"), F.explode("tokens").alias("token"))
    urls = labelled.groupBy("tokens").agg(F.count("*").alias("urls"), F.sum((F.col("known") == "block").cast("bigint")).alias("blocks"))
    urls = stored(urls.select(F.xxhash64("tokens").alias("url"), "*"), "labelled")
    met = urls.select("url", F.explode("tokens").alias("token")).join(small(posted, 200_000), "token")
    held = met.groupBy("url", "id", "need").agg(F.count("*").alias("met")).where("met = need").select("url", "id")
    total = held.join(urls.drop("tokens"), "url").groupBy("id").agg(F.sum("urls").alias("urls"), F.sum("blocks").alias("blocks"))
    verdicts = F.array(F.struct(F.lit("block").alias("verdict"), F.col("blocks").alias("hits")), F.struct(F.lit("allow").alias("verdict"), (F.col("urls") - F.col("blocks")).alias("hits")))
    rules = total.select("id", "urls", F.explode(verdicts).alias("r")).select("id", "r.verdict", "r.hits", (F.col("r.hits") / F.col("urls")).alias("confidence"))
    kept = rules.where((F.col("hits") >= least) & (F.col("confidence") >= confidence)).select("id", "verdict", "confidence", (F.col("hits") / n).alias("support"))
    return kept.join(sets, "id").select("tokens", "verdict", "confidence", "support")


def url_verdicts(pages: DataFrame, rules: list[tuple[str, str, str]], support: float = SUPPORT, confidence: float = CONFIDENCE) -> DataFrame:
    """page_id, host, path, rule, verdict for every row.

    A null URL or one without `://` has an empty host and path, fits no rule and gets the method's verdict for
    no token. Null and repeated keys each give a row. Equal URLs are judged once; long ones are matched by all their
    tokens. Of equally sure rules the longer decides, then block. An empty table gives no rows.
    """
    rows = judged(pages, rules)
    mined = mine(rows.where("known is not null").select("tokens", "known"), support, confidence)
    posted = mined.select("rule_id", F.size("tokens").alias("need"), "verdict", "confidence", F.explode("tokens").alias("token"))
    open_sets = stored(rows.where("known is null").select("tokens").distinct().select(F.xxhash64("tokens").alias("set_id"), "tokens"), "token_sets")
    met = open_sets.select("set_id", F.explode("tokens").alias("token")).join(small(posted, 200_000), "token")
    fits = met.groupBy("set_id", "rule_id", "need", "verdict", "confidence").agg(F.count("*").alias("n")).where("n = need")
    # the surest rule decides, the longer of two equally sure ones, block before allow
    best = fits.groupBy("set_id").agg(F.max(F.struct("confidence", "need", "verdict")).alias("best")).select("set_id", F.col("best.verdict").alias("method"))
    answer = rows.withColumn("set_id", F.xxhash64("tokens")).join(best, "set_id", "left")
    return answer.select("page_id", "host", "path", "rule", F.coalesce("known", "method", F.lit(DEFAULT)).alias("verdict"))
