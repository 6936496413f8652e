"""URL filter: host and path rules, and for the rest the ratio of two character
language models.

The URLs that a rule accepts and those that a rule rejects each train a smoothed
variable-order Markov model over a folded alphabet: the probability of a character
after two others leans on that after one, and that on the character's own, the more the
less often the longer context was seen.  A URL's score is the log-likelihood
difference of the two models over its number of characters; the threshold is
calibrated on labelled URLs that were left out of the counts.  DataFrame operations only.

The model is one integer (millionths) per character triple: a table of
``len(SYMBOLS) ** 3`` rows, whatever the data, so it may be broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

RULES = (("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/"))
SYMBOLS = "^abcdefghijklmnopqrstuvwxyz0./-_?=&%:#*"  # ^ begins; 0 is any digit; * is any other
LEAN = 2.0  # how many observations the shorter context counts for
FOLD = "3"  # labelled URLs whose md5 begins below it (3 in 16) calibrate the threshold

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    """Host (A-Z lower-cased) and path; both empty without ``://`` or for null."""
    at = F.locate("://", url)
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise("")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    path = F.regexp_extract(F.substring(rest, F.length(host) + 1, F.length(rest)), r"^[^?#]*", 0)
    return F.translate(host, _UPPER, _LOWER), path


def fitting_rule(host: Column, path: Column, rules=RULES) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict; null without one."""
    rule, verdict = F.lit(None).cast("string"), F.lit(None).cast("string")
    for action, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        of, slash, below = text.partition("/")
        fits = ((host == of) | host.endswith("." + of)) & path.startswith(slash + below)
        rule = F.when(fits, text).otherwise(rule)
        verdict = F.when(fits, action).otherwise(verdict)
    return rule, verdict


def with_triples(pages: DataFrame) -> DataFrame:
    """Adds ``triples``: the number of every character triple of ``^^`` and the
    folded URL, in order."""
    folded = F.translate(F.coalesce("url", F.lit("")), _UPPER + "123456789^", _LOWER + "000000000*")
    folded = F.concat(F.lit("^^"), F.regexp_replace(folded, r"[^a-z0./\-_?=&%:#]", "*"))
    codes = F.transform(F.split(folded, ""), lambda c: F.call_function("locate", c, F.lit(SYMBOLS)) - 1)
    n, code = len(SYMBOLS), F.col("codes")
    triple = F.transform(
        F.sequence(F.lit(0), F.size("codes") - 3),
        lambda i: (F.get(code, i) * n + F.get(code, i + 1)) * n + F.get(code, i + 2),
    )
    empty = F.array().cast("array<int>")
    coded = pages.withColumn("codes", codes)
    return coded.withColumn("triples", F.when(F.size("codes") > 2, triple).otherwise(empty)).drop("codes")


def model_table(labelled: DataFrame) -> DataFrame:
    """triple (0 to len(SYMBOLS)**3 - 1), weight: millionths of the log ratio of
    accepted to rejected.  ``labelled``: triples, verdict."""
    n = len(SYMBOLS)
    spark = labelled.sparkSession
    seen = labelled.select("verdict", F.explode("triples").alias("triple")).groupBy("triple").agg(
        F.count_if(F.col("verdict") == "allow").alias("a"), F.count_if(F.col("verdict") == "block").alias("b")
    )
    every = spark.range(n**3).select(F.col("id").cast("int").alias("triple")).join(seen, "triple", "left").fillna(0)
    every = every.withColumns({
        "last": F.col("triple") % n, "pair": F.col("triple") % (n * n), "two": F.floor(F.col("triple") / n),
        "one": F.floor(F.col("triple") / n) % n,
    })

    def summed(by: str) -> DataFrame:
        return every.groupBy(by).agg(F.sum("a").alias(f"a_{by}"), F.sum("b").alias(f"b_{by}"))

    table = every
    for by in ("last", "pair", "two", "one"):
        table = table.join(summed(by), by)
    total = every.agg(F.sum("a").alias("a"), F.sum("b").alias("b")).first()

    def probability(x: str) -> Column:
        own = (F.col(f"{x}_last") + 1.0) / (float(total[x]) + n)
        after_one = (F.col(f"{x}_pair") + LEAN * own) / (F.col(f"{x}_one") + LEAN)
        return (F.col(x) + LEAN * after_one) / (F.col(f"{x}_two") + LEAN)

    weight = F.round((F.ln(probability("a")) - F.ln(probability("b"))) * 1e6, 0).cast("long")
    return table.select("triple", weight.alias("weight"))


def _scored(pages: DataFrame, model: DataFrame) -> DataFrame:
    """Adds ``score``: thousandths of the log-likelihood difference a character.
    The model has a fixed number of rows, so it may be broadcast.  A URL's triples meet again
    before they leave their task."""
    rows = pages.withColumn("row", F.monotonically_increasing_id())
    columns = [c for c in rows.columns if c != "triples"]
    each = rows.select(*columns, F.explode_outer("triples").alias("triple"))
    weighed = each.join(F.broadcast(model), "triple", "left")
    sums = weighed.groupBy(*columns).agg(F.sum("weight").alias("total"), F.count("triple").alias("characters"))
    score = F.floor(F.coalesce("total", F.lit(0)) / (F.greatest("characters", F.lit(1)) * 1000.0))
    return sums.withColumn("score", score).drop("row", "total", "characters")


def _threshold(held_out: DataFrame) -> Column:
    """The least score to accept: between the neighbouring scores where the
    balanced error is least; 0 without both kinds."""
    counts = held_out.groupBy("score").agg(
        F.count_if(F.col("verdict") == "allow").alias("a"), F.count_if(F.col("verdict") == "block").alias("b")
    )
    # Scores are whole thousandths of a bounded log ratio, so these rows are bounded too.
    rows = sorted((r.score, r.a, r.b) for r in counts.collect())
    allowed, blocked = sum(r[1] for r in rows), sum(r[2] for r in rows)
    if not allowed or not blocked:
        return F.lit(0)
    best, below, above, last = None, 0, blocked, rows[0][0]
    for score, a, b in rows:
        error = above / blocked + below / allowed
        if best is None or error < best[0]:
            best = (error, (last + score) // 2)
        below, above, last = below + a, above - b, score
    return F.lit(best[1])


def judge_urls(pages: DataFrame, rules=RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, score per row of ``pages`` (page_id, url).

    A null url or one without ``://`` has empty host and path; no rule fits it and
    its characters are judged (a null or empty one scores 0).  Repeated rows are judged
    alike and each counts in the models; without labelled URLs the models are
    equal and all scores 0, which is accepted.  Other columns are ignored; an empty table gives no rows.
    """
    host, path = host_and_path(F.col("url"))
    split = pages.select("page_id", "url", host.alias("host"), path.alias("path"))
    rule, verdict = fitting_rule(F.col("host"), F.col("path"), rules)
    ruled = with_triples(split.withColumns({"rule": rule, "ruled": verdict}))
    labelled = ruled.filter("ruled IS NOT NULL").withColumnRenamed("ruled", "verdict")
    calibrates = F.substring(F.md5(F.col("url").cast("binary")), 1, 1) < FOLD
    model = model_table(labelled.filter(~calibrates))
    least = _threshold(_scored(labelled.filter(calibrates), model))
    scored = _scored(ruled, model)
    judged = F.coalesce("ruled", F.when(F.col("score") >= least, "allow").otherwise("block"))
    return scored.select("page_id", "host", "path", "rule", judged.alias("verdict"), "score")


ORACLE = r"""
WITH split AS (
  SELECT row_number() OVER () AS r, page_id, url,
         CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest
  FROM pages),
hosts AS (SELECT *, regexp_extract(rest, '^[^/?#]*') AS h FROM split),
parts AS (
  SELECT r, page_id, url, translate(h, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(substr(rest, length(h) + 1), '^[^?#]*') AS path
  FROM hosts),
rules(action, rule, suffix, below) AS (
  VALUES ('block', 'net/', 'net', '/'), ('allow', 'example.net/en/', 'example.net', '/en/'),
         ('block', 'example.com/de/', 'example.com', '/de/'), ('allow', 'org/fr/', 'org', '/fr/')),
ruled AS (
  SELECT r, any_value(page_id) AS page_id, any_value(url) AS url, any_value(host) AS host,
         any_value(path) AS path, arg_max(rule, length(rule)) AS rule, arg_max(action, length(rule)) AS ruled
  FROM parts LEFT JOIN rules
    ON (host = suffix OR ends_with(host, '.' || suffix)) AND starts_with(path, below)
  GROUP BY r),
folded AS (
  SELECT r, ruled, coalesce(substr(md5(url), 1, 1) < '3', false) AS held,
    '^^' || regexp_replace(translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ123456789^',
      'abcdefghijklmnopqrstuvwxyz000000000*'), '[^a-z0./\-_?=&%:#]', '*', 'g') AS f
  FROM ruled),
grams AS (
  SELECT r, ruled, held, substr(f, i, 3) AS g FROM (SELECT *, unnest(range(1, length(f) - 1)) AS i FROM folded)),
counted AS (
  SELECT g, count(*) FILTER (ruled = 'allow') AS a, count(*) FILTER (ruled = 'block') AS b
  FROM grams WHERE ruled IS NOT NULL AND NOT held GROUP BY g),
total AS (SELECT coalesce(sum(a), 0)::DOUBLE AS a, coalesce(sum(b), 0)::DOUBLE AS b FROM counted),
lasts AS (SELECT substr(g, 3, 1) AS k, sum(a) AS a, sum(b) AS b FROM counted GROUP BY 1),
pairs AS (SELECT substr(g, 2, 2) AS k, sum(a) AS a, sum(b) AS b FROM counted GROUP BY 1),
twos AS (SELECT substr(g, 1, 2) AS k, sum(a) AS a, sum(b) AS b FROM counted GROUP BY 1),
ones AS (SELECT substr(g, 2, 1) AS k, sum(a) AS a, sum(b) AS b FROM counted GROUP BY 1),
weights AS (
  SELECT t.g, CAST(round((ln(
      (coalesce(c.a, 0) + 2.0::DOUBLE * ((coalesce(p.a, 0) + 2.0::DOUBLE *
        ((coalesce(l.a, 0) + 1.0::DOUBLE) / (total.a + 39))) / (coalesce(o.a, 0) + 2.0::DOUBLE)))
      / (coalesce(w.a, 0) + 2.0::DOUBLE)) - ln(
      (coalesce(c.b, 0) + 2.0::DOUBLE * ((coalesce(p.b, 0) + 2.0::DOUBLE *
        ((coalesce(l.b, 0) + 1.0::DOUBLE) / (total.b + 39))) / (coalesce(o.b, 0) + 2.0::DOUBLE)))
      / (coalesce(w.b, 0) + 2.0::DOUBLE))) * 1e6::DOUBLE) AS BIGINT) AS weight
  FROM (SELECT DISTINCT g FROM grams) t LEFT JOIN counted c ON c.g = t.g
    LEFT JOIN lasts l ON l.k = substr(t.g, 3, 1) LEFT JOIN pairs p ON p.k = substr(t.g, 2, 2)
    LEFT JOIN twos w ON w.k = substr(t.g, 1, 2) LEFT JOIN ones o ON o.k = substr(t.g, 2, 1), total),
sums AS (SELECT r, sum(weight) AS s, count(*) AS n FROM grams JOIN weights USING (g) GROUP BY r),
scored AS (
  SELECT ruled.*, folded.held,
         CAST(floor(coalesce(s, 0)::DOUBLE / (coalesce(n, 1) * 1000.0::DOUBLE)) AS BIGINT) AS score
  FROM ruled JOIN folded USING (r) LEFT JOIN sums USING (r)),
marks AS (
  SELECT score, count(*) FILTER (ruled = 'allow') AS a, count(*) FILTER (ruled = 'block') AS b
  FROM scored WHERE held AND ruled IS NOT NULL GROUP BY score),
errors AS (
  SELECT score, (SELECT sum(a) FROM marks) AS na, (SELECT sum(b) FROM marks) AS nb,
         coalesce(sum(a) OVER (ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below,
         sum(b) OVER (ORDER BY score ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS above,
         coalesce(lag(score) OVER (ORDER BY score), score) AS last
  FROM marks),
threshold AS (
  SELECT CAST(floor((last + score) / 2.0::DOUBLE) AS BIGINT) AS score FROM errors WHERE na > 0 AND nb > 0
  ORDER BY above::DOUBLE / nb::DOUBLE + below::DOUBLE / na::DOUBLE, errors.score LIMIT 1)
SELECT page_id, host, path, rule,
       coalesce(ruled, CASE WHEN score >= coalesce((SELECT score FROM threshold), 0) THEN 'allow' ELSE 'block' END)
         AS verdict, score
FROM scored
"""
