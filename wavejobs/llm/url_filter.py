"""URL filter by a character language-model ratio (operator 4, native).

Method: the whole text of every url that a rule decides teaches one of two variable-order
Markov models of characters, accepted or rejected. Each smooths contexts of two, one and
no characters by Witten-Bell: a context gives the share t / (n + t) to the shorter one,
n being its number of characters and t its number of different ones. A url's score is the
difference of its log-likelihoods per character, and the cut between allow and block is
calibrated on the decided urls, between the means of both kinds, nearer to the one that
spreads less. Rules always go first.

Only DataFrame functions are used. Characters are mapped to an alphabet of ``SYMBOLS``,
so the table of all trigrams has 45 ** 3 = 91,125 rows for any input. It becomes one array
that every task has, and a url is scored where it is read, by looking up its trigrams there:
no url is shuffled or joined, so urls that many pages share are no hot key, and the work is
linear in a url's length. Counts cover all decided urls.

Cases: a null url, or one without ``://``, has an empty host and path; a null url is scored
as an empty one; equal urls get equal scores; urls of any length count whole; other columns
of ``pages`` are ignored; where rules decide no url of one kind, the other kind is the verdict, and
``allow`` where there is none at all.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import saved

# Rule (host, then path), verdict.
RULES = {
    "org/": "allow",
    "example.org/es/": "block",
    "example.org/en/1": "block",
    "com/fr/": "allow",
    "com/de/": "block",
}

SYMBOLS = "abcdefghijklmnopqrstuvwxyz0123456789./-_:?=&~"
N = len(SYMBOLS)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    has = F.coalesce(F.contains(url, F.lit("://")), F.lit(False))
    host = F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER)
    path = F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1)
    return F.when(has, host).otherwise(""), F.when(has, path).otherwise("")


def matching_rule(host: Column, path: Column, rules: dict[str, str]) -> Column:
    """The longest rule that fits; equally long ones in alphabetical order."""

    def fits(rule: str) -> Column:
        name, slash, rest = rule.partition("/")
        return ((host == name) | host.endswith("." + name)) & path.startswith(slash + rest)

    ordered = sorted(rules, key=lambda r: (-len(r), r))
    return reduce(lambda c, r: c.when(fits(r), r), ordered[1:], F.when(fits(ordered[0]), ordered[0]))


def plain(url: Column) -> Column:
    """A url in the alphabet; its last symbol stands for all others."""
    small = F.translate(F.coalesce(url, F.lit("")), UPPER, LOWER)
    return F.regexp_replace(small, r"[^a-z0-9./_:?=&-]", "~")


def trigrams(text: Column) -> Column:
    """The code of each character with the two before it; the last symbol stands before and after the text."""
    padded = F.concat(F.lit("~~"), text, F.lit("~"))
    n = F.length(padded)
    codes = F.transform(F.slice(F.split(padded, ""), 1, n), lambda c: F.instr(F.lit(SYMBOLS), c) - 1)
    pairs = F.zip_with(codes, F.slice(codes, 2, n), lambda a, b: a * N + b)
    return F.slice(F.zip_with(pairs, F.slice(codes, 3, n), lambda ab, c: ab * N + c), 1, n - 2)


def language_models(decided: DataFrame) -> DataFrame:
    """One row with ``ratios``: log-likelihood of allow less that of block, for every trigram in order."""
    spark = decided.sparkSession
    both = decided.select("verdict", F.explode(trigrams(F.col("plain"))).alias("gram")).groupBy("gram").agg(*(F.count_if(F.col("verdict") == v).alias(v) for v in ("allow", "block")))
    grams = spark.range(N**3).select(F.col("id").alias("gram"), F.floor(F.col("id") / (N * N)).alias("a"), F.floor(F.col("id") / N % N).alias("b"), (F.col("id") % N).alias("c"))
    table = grams.join(both, "gram", "left").fillna(0)
    ab, bc, c, b = (Window.partitionBy(*k) for k in (("a", "b"), ("b", "c"), ("c",), ("b",)))
    everything = Window.partitionBy(F.lit(0))
    for v in ("allow", "block"):
        table = table.withColumn(f"{v}_bc", F.sum(v).over(bc))
        # Each pair (b, c) stands in the table once for every a.
        t_b = F.sum((F.col(f"{v}_bc") > 0).cast("double")).over(b) / N
        n_b = F.sum(v).over(b)
        p0 = (F.sum(v).over(c) + 1.0) / (F.sum(v).over(everything) + N)
        p1 = F.when(n_b > 0, (F.col(f"{v}_bc") + t_b * p0) / (n_b + t_b)).otherwise(p0)
        t_ab = F.sum((F.col(v) > 0).cast("double")).over(ab)
        n_ab = F.sum(v).over(ab)
        table = table.withColumn(f"{v}_p1", p1)
        table = table.withColumn(f"{v}_p", F.when(n_ab > 0, (F.col(v) + t_ab * F.col(f"{v}_p1")) / (n_ab + t_ab)).otherwise(F.col(f"{v}_p1")))
    ratio = F.struct("gram", (F.log("allow_p") - F.log("block_p")).alias("ratio"))
    return table.agg(F.array_sort(F.collect_list(ratio)).alias("all")).select(F.transform("all", lambda x: x["ratio"]).alias("ratios"))


def judge(pages: DataFrame, rules: dict[str, str] | None = None) -> DataFrame:
    """page_id, host, path, rule, verdict and the model's score of every row of ``pages``."""
    rules = rules or RULES
    host, path = host_and_path(F.col("url"))
    rows = pages.select("page_id", host.alias("host"), path.alias("path"), plain(F.col("url")).alias("plain"))
    rows = rows.withColumn("rule", matching_rule(F.col("host"), F.col("path"), rules))
    of_rule = reduce(lambda c, r: c.when(F.col("rule") == r, rules[r]), list(rules)[1:], F.when(F.col("rule") == list(rules)[0], rules[list(rules)[0]]))
    rows = rows.select("*", of_rule.alias("of_rule"))
    models = saved(language_models(rows.where("of_rule is not null").select("plain", F.col("of_rule").alias("verdict"))), "url-models")
    # The array is a constant of the plan, so the next step must not write it into rows.
    grams = rows.select("*", trigrams(F.col("plain")).alias("grams"), models.scalar().alias("ratios"))
    score = F.aggregate("grams", F.lit(0.0), lambda s, g: s + F.get("ratios", g)) / F.size("grams")
    scored = saved(grams.select("page_id", "host", "path", "rule", "of_rule", score.alias("score")), "urls")
    kinds = scored.where("of_rule is not null").groupBy("of_rule").agg(F.avg("score").alias("m"), (F.stddev_pop("score") + 1e-9).alias("s"))
    cut = kinds.agg(
        *(F.max(F.when(F.col("of_rule") == v, F.col(x))).alias(f"{x}_{v}") for v in ("allow", "block") for x in ("m", "s"))
    ).select(
        F.when(F.col("m_block").isNull(), float("-inf"))
        .when(F.col("m_allow").isNull(), float("inf"))
        .otherwise((F.col("m_block") * F.col("s_allow") + F.col("m_allow") * F.col("s_block")) / (F.col("s_allow") + F.col("s_block")))
        .alias("cut")
    )
    by_model = F.when(F.col("score") >= cut.scalar(), "allow").otherwise("block")
    return scored.select("page_id", "host", "path", "rule", F.coalesce("of_rule", by_model).alias("verdict"), "score")


def oracle(rules: dict[str, str] | None = None) -> str:
    """The same rows in DuckDB."""
    rules = rules or RULES
    cases = " ".join(
        f"when (host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '/{p}') then '{r}'"
        for r in sorted(rules, key=lambda r: (-len(r), r))
        for h, _, p in [r.partition("/")]
    )
    verdicts = " ".join(f"when '{r}' then '{v}'" for r, v in rules.items())
    model = ", ".join(
        f"case when nab_{v} > 0 then (n_{v} + tab_{v} * p1_{v}) / (nab_{v} + tab_{v}) else p1_{v} end as p_{v}" for v in ("allow", "block")
    )
    p1 = ", ".join(
        f"case when nb_{v} > 0 then (nbc_{v} + tb_{v} * (nc_{v} + 1.0::double) / (nall_{v} + {N})) / (nb_{v} + tb_{v}) else (nc_{v} + 1.0::double) / (nall_{v} + {N}) end as p1_{v}"
        for v in ("allow", "block")
    )
    sums = ", ".join(
        f"sum(n_{v}) over (partition by a, b)::double as nab_{v}, sum((n_{v} > 0)::int) over (partition by a, b)::double as tab_{v}, sum(n_{v}) over (partition by c)::double as nc_{v}, "
        f"sum(n_{v}) over (partition by b)::double as nb_{v}, sum(n_{v}) over ()::double as nall_{v}, sum((nbc_{v} > 0)::int) over (partition by b)::double / {N} as tb_{v}"
        for v in ("allow", "block")
    )
    return f"""
    with u as (select page_id, url, case when contains(url, '://') then translate(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), '{UPPER}', '{LOWER}') else '' end as host,
        case when contains(url, '://') then regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1) else '' end as path from pages),
    r as (select *, case {cases} end as rule, regexp_replace(translate(coalesce(url, ''), '{UPPER}', '{LOWER}'), '[^a-z0-9./_:?=&-]', '~', 'g') as plain from u),
    d as (select *, case rule {verdicts} end as of_rule from r),
    g as (select plain, of_rule, page_id, ((instr('{SYMBOLS}', s[i]) - 1) * {N} + instr('{SYMBOLS}', s[i + 1]) - 1) * {N} + instr('{SYMBOLS}', s[i + 2]) - 1 as gram
        from (select *, '~~' || plain || '~' as s from d), unnest(range(1, len(plain) + 2)) x(i)),
    n as (select gram, count(*) filter (of_rule = 'allow') as n_allow, count(*) filter (of_rule = 'block') as n_block from g group by gram),
    t as (select i as gram, i // {N * N} as a, i // {N} % {N} as b, i % {N} as c, coalesce(n_allow, 0)::double as n_allow, coalesce(n_block, 0)::double as n_block from range({N**3}) x(i) left join n on gram = i),
    t1 as (select *, sum(n_allow) over (partition by b, c) as nbc_allow, sum(n_block) over (partition by b, c) as nbc_block from t),
    t2 as (select *, {sums} from t1), t3 as (select *, {p1} from t2), t4 as (select gram, {model} from t3),
    s as (select plain, avg(ln(p_allow) - ln(p_block)) as score from (select distinct plain, i, gram from (select plain, gram, row_number() over (partition by plain, page_id) as i from g)) join t4 using (gram) group by plain),
    f as (select d.*, score from d join s using (plain)),
    k as (select avg(score) filter (of_rule = 'allow') as ma, stddev_pop(score) filter (of_rule = 'allow') + 1e-9 as sa, avg(score) filter (of_rule = 'block') as mb, stddev_pop(score) filter (of_rule = 'block') + 1e-9 as sb from f)
    select page_id, host, path, rule, coalesce(of_rule, case when score >= (mb * sa + ma * sb) / (sa + sb) then 'allow' else 'block' end) as verdict from f, k"""
