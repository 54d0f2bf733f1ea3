"""URL filter: rules first, then the ratio of two character language models.

The urls that the rules allow and block train two variable-order Markov models over characters (orders 0 to 3, Witten-Bell
smoothing: where a context was never seen the shorter one speaks alone). A url without a rule is judged by the
log-likelihood difference per character against a threshold calibrated on the training urls. DataFrame expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gridspark.llm.common import cut, lower_ascii, table

#: (verdict, host, path): the longest rule that fits wins.
RULES = (("block", "net", "/"), ("allow", "example.net", "/en/"), ("block", "example.com", "/de/"), ("allow", "org", "/fr/"))
HOST = r"^(?s:.*?)://([^/?#]*)"
PATH = r"^(?s:.*?)://[^/?#]*([^?#]*)"
#: The models' characters: letters, digits as 0, these signs, * for all others, ^ and ; for the edges. Longest context: 3.
SIGNS = r"./:?#=&_%~@+-"
ORDER = 3
#: So many different grams are possible, which bounds the broadcast model.
SIZE = 26 + 1 + len(SIGNS) + 3
MAX_GRAMS = SIZE ** (ORDER + 1)


def host_of(url: Column) -> Column:
    return F.coalesce(lower_ascii(F.regexp_extract(url, HOST, 1)), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(url, PATH, 1), F.lit(""))


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest fitting rule as a struct (rule, verdict), null if none fits; equal lengths: the later text."""
    fits = []
    for verdict, h, p in rules:
        fit = ((host == h) | F.endswith(host, F.lit("." + h))) & F.startswith(path, F.lit(p))
        fits.append(F.when(fit, F.struct(F.lit(len(h + p)).alias("n"), F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))))
    return F.array_max(F.array_compact(F.array(*fits)))


def grams_of(url: Column) -> Column:
    """The url's characters, each with the three before it."""
    plain = F.regexp_replace(F.regexp_replace(lower_ascii(url), "[0-9]", "0"), f"[^a-z0{SIGNS}]", "*")
    s = F.concat(F.lit("^" * ORDER), plain, F.lit(";"))
    return F.transform(F.sequence(F.lit(1), F.length(plain) + 1), lambda i: F.substring(s, i, ORDER + 1))


def gram_ratios(grams: DataFrame) -> DataFrame:
    """From (gram, a, r), counts in allowed and blocked urls, to (gram, ratio) = log p_allow - log p_block of its last character.

    From order to order, the counts of the grams' endings are summed, and joined with their contexts' sums and with the shorter ending's
    probabilities. Both of these have at most MAX_GRAMS / the alphabet's size rows, 80 thousand, whatever the input, and are broadcast.
    """
    both = ("a", "r")
    tails = [grams.select(F.col("gram").alias("tail"), *both)]
    for k in range(ORDER, 0, -1):
        tails.insert(0, tails[0].groupBy(F.expr(f"right(tail, {k})").alias("tail")).agg(*(F.sum(c).alias(c) for c in both)))
    below = None
    for k, t in enumerate(tails):
        t = t.withColumn("ctx", F.expr(f"substring(tail, 1, {k})"))
        ctx = t.groupBy("ctx").agg(*(F.sum(c).alias(f"all_{c}") for c in both), *(F.count_if(F.col(c) > 0).alias(f"kinds_{c}") for c in both))
        t = t.join(F.broadcast(ctx), "ctx")
        if below is None:
            t = t.select("*", *(F.lit(1.0 / SIZE).alias(f"below_{c}") for c in both))
        else:
            t = t.withColumn("short", F.expr(f"right(tail, {k})")).join(F.broadcast(below), "short")
        n, total, kinds, less = ({c: F.col(name.format(c)) for c in both} for name in ("{}", "all_{}", "kinds_{}", "below_{}"))
        p = [F.when(total[c] + kinds[c] > 0, (n[c] + kinds[c] * less[c]) / (total[c] + kinds[c])).otherwise(less[c]).alias(f"below_{c}") for c in both]
        below = t.select(F.col("tail").alias("short"), *p)
    return below.select(F.col("short").alias("gram"), (F.ln("below_a") - F.ln("below_r")).alias("ratio"))


def judge(pages: DataFrame, url: str = "url", rules=RULES, host: str = "host", path: str = "path", rule: str = "rule", verdict: str = "verdict", score: str = "url_score") -> DataFrame:
    """pages plus host, path, rule, verdict and the score (null where a rule decides).

    A null url or one without :// has an empty host and path; without a rule it is judged by its characters (null: none, so
    score 0); a very long url is judged by all its characters. Equal urls get equal verdicts, ties with the threshold are allowed. When no url is allowed or none blocked by a rule, all others are allowed. An
    empty table stays empty; other columns pass through, those named like an added column are replaced, names that begin with __ are taken.
    """
    pages = pages.drop(*({host, path, rule, verdict, score} - {url}))
    u = F.col(url).cast("string")
    seen = pages.select(F.coalesce(u, F.lit("")).alias("__u")).groupBy("__u").agg(F.count("*").alias("__n"))
    # A url has some sixty grams: they are made in as many tasks as shuffles have, however few bytes the urls take.
    seen = cut(seen.repartition(int(pages.sparkSession.conf.get("spark.sql.shuffle.partitions")), "__u"))
    seen = seen.withColumn("__v", rule_of(host_of(F.col("__u")), path_of(F.col("__u")), rules)["verdict"])
    pieces = seen.select("__u", "__n", "__v", F.explode(grams_of(F.col("__u"))).alias("gram"))
    counts = pieces.groupBy("gram").agg(*(F.sum(F.when(F.col("__v") == v, F.col("__n")).otherwise(0)).alias(c) for c, v in (("a", "allow"), ("r", "block"))))
    ratios = gram_ratios(cut(counts))  # at most MAX_GRAMS rows by the alphabet's size, whatever the input: 3.4 million
    scored = pieces.join(F.broadcast(ratios), "gram").groupBy("__u", "__n", "__v").agg(F.avg("ratio").alias(score))
    stat = lambda f, v: f(F.when(F.col("__v") == v, F.col(score)))
    ma, mr, sa, sr = stat(F.avg, "allow"), stat(F.avg, "block"), stat(F.stddev_pop, "allow"), stat(F.stddev_pop, "block")
    # Equal numbers of standard deviations from either class; equal spreads of 0 give the middle.
    level = scored.agg(F.coalesce(F.when(sa + sr > 0, (ma * sr + mr * sa) / (sa + sr)), (ma + mr) / 2).alias("__t"))
    verdicts = scored.where("__v is null").crossJoin(F.broadcast(level)).select("__u", score, F.when(F.col("__t").isNull() | (F.col(score) >= F.col("__t")), "allow").otherwise("block").alias("__m"))
    own = pages.withColumn(host, host_of(u)).withColumn(path, path_of(u)).withColumn("__rule", rule_of(F.col(host), F.col(path), rules)).withColumn("__u", F.coalesce(u, F.lit("")))
    out = own.join(verdicts, "__u", "left")
    return out.select(*pages.columns, host, path, F.col("__rule.rule").alias(rule), F.coalesce(F.col("__rule.verdict"), F.col("__m")).alias(verdict), score)


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages").select("page_id", "url")).select("page_id", "host", "path", "rule", "verdict")


def _sql() -> str:
    host = f"coalesce(translate(regexp_extract(u, '{HOST}', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '')"
    path = f"coalesce(regexp_extract(u, '{PATH}', 1), '')"
    rules = sorted(RULES, key=lambda x: -len(x[1] + x[2]))
    fit = lambda what: "CASE " + " ".join(f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{what(v, h, p)}'" for v, h, p in rules) + " END"
    steps, prev = [], "g"
    for k in range(ORDER + 1):
        cols = []
        for c in "ar":
            cols.append(f"sum({c}) OVER (PARTITION BY right(gram, {k + 1})) AS n_{c}{k}, sum({c}) OVER (PARTITION BY left(right(gram, {k + 1}), {k})) AS all_{c}{k}")
        steps.append(f"s{k} AS (SELECT *, {', '.join(cols)}, row_number() OVER (PARTITION BY right(gram, {k + 1}) ORDER BY gram) AS f{k} FROM {prev})")
        cols = [f"sum(CASE WHEN f{k} = 1 AND n_{c}{k} > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY left(right(gram, {k + 1}), {k})) AS kinds_{c}{k}" for c in "ar"]
        steps.append(f"t{k} AS (SELECT *, {', '.join(cols)} FROM s{k})")
        below = {c: f"{1.0 / (len(SIGNS) + 30)!r}::DOUBLE" if k == 0 else f"p_{c}{k - 1}" for c in "ar"}
        cols = [f"CASE WHEN all_{c}{k} + kinds_{c}{k} > 0 THEN (n_{c}{k}::DOUBLE + kinds_{c}{k}::DOUBLE * {below[c]}) / (all_{c}{k} + kinds_{c}{k})::DOUBLE ELSE {below[c]} END AS p_{c}{k}" for c in "ar"]
        steps.append(f"p{k} AS (SELECT *, {', '.join(cols)} FROM t{k})")
        prev = f"p{k}"
    return f"""
WITH b AS (SELECT page_id, coalesce(url, '') AS u FROM pages), hp AS (SELECT page_id, u, {host} AS host, {path} AS path FROM b),
v AS (SELECT *, {fit(lambda v, h, p: h + p)} AS rule, {fit(lambda v, h, p: v)} AS verdict FROM hp),
x AS (SELECT u, any_value(verdict) AS v, count(*) AS n, regexp_replace(regexp_replace(translate(u, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9]', '0', 'g'), '[^a-z0{SIGNS}]', '*', 'g') AS s FROM v GROUP BY u),
e AS (SELECT u, v, n, substring('{'^' * ORDER}' || s || ';', i, {ORDER + 1}) AS gram FROM x, unnest(range(1, length(s) + 2)) t(i)),
g AS (SELECT gram, sum(CASE WHEN v = 'allow' THEN n ELSE 0 END) AS a, sum(CASE WHEN v = 'block' THEN n ELSE 0 END) AS r FROM e GROUP BY gram),
{', '.join(steps)},
sc AS (SELECT u, any_value(v) AS v, avg(ln(p_a{ORDER}) - ln(p_r{ORDER})) AS s FROM e JOIN {prev} USING (gram) GROUP BY u),
m AS (SELECT avg(s) FILTER (v = 'allow') AS ma, avg(s) FILTER (v = 'block') AS mr, stddev_pop(s) FILTER (v = 'allow') AS sa, stddev_pop(s) FILTER (v = 'block') AS sr FROM sc),
t AS (SELECT coalesce(CASE WHEN sa + sr > 0 THEN (ma * sr + mr * sa) / (sa + sr) END, (ma + mr) / 2) AS t FROM m)
SELECT page_id, host, path, rule, coalesce(verdict, CASE WHEN t IS NULL OR s >= t THEN 'allow' ELSE 'block' END) AS verdict FROM v JOIN sc USING (u), t
"""


SQL = _sql()
