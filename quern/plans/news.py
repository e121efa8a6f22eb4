"""Queries over news records, articles and event streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quern.functions import text as tx
from quern.functions.windows import as_of
from quern.operators import dedupe
from quern.plans.base import query
from quern.sources import payloads, views
from quern.sources.articles import ARTICLES, articles
from quern.sources.views import RECORDS
from quern.streaming import daily


def r6(x: Column) -> Column:
    return F.round(x, 6)


_TONE = "count(*) AS article_count, round(avg(tone), 6) AS tone_mean, round(coalesce(stddev_samp(tone), 0), 6) AS tone_std, count_if(tone > 1) AS pos_count, count_if(tone < -1) AS neg_count"


def tone_block() -> list[Column]:
    """Count, mean, deviation (0 for one) and numbers above 1 and below -1."""
    t = F.col("tone")
    return [F.count(F.lit(1)).alias("article_count"), r6(F.avg(t)).alias("tone_mean"), r6(F.coalesce(F.stddev_samp(t), F.lit(0.0))).alias("tone_std"), F.count_if(t > 1).alias("pos_count"), F.count_if(t < -1).alias("neg_count")]


def per_ticker(records: DataFrame) -> DataFrame:
    """Daily tone of each ticker; a record counts for each of its tickers, none for none."""
    return records.select("day", "tone", F.explode("tickers").alias("ticker")).groupBy("day", "ticker").agg(*tone_block())


PER_TICKER = f"{RECORDS}, per_ticker AS (SELECT day, ticker, {_TONE} FROM (SELECT day, tone, unnest(tickers) AS ticker FROM records) GROUP BY day, ticker)"


@query(f"WITH {PER_TICKER} SELECT * FROM per_ticker")
def news_daily_per_ticker(spark, sf_dir):
    """Daily tone statistics of each ticker."""
    return per_ticker(views.records(spark, sf_dir))


def market(records: DataFrame) -> DataFrame:
    """Daily political, policy and presidential statistics of days with any of them; an absent kind has zeros."""
    pol, pres = F.when(F.col("political"), F.col("tone")), F.when(F.col("presidential"), F.col("tone"))
    zero = lambda x: r6(F.coalesce(x, F.lit(0.0)))
    return (
        records.groupBy("day")
        .agg(F.count_if("political").alias("pol_article_count"), zero(F.avg(pol)).alias("pol_tone_mean"), zero(F.stddev_samp(pol)).alias("pol_tone_std"), F.count_if("epu").alias("epu_count"), F.count_if("presidential").alias("pres_article_count"), zero(F.avg(pres)).alias("pres_tone_mean"))
        .where("pol_article_count + epu_count + pres_article_count > 0")
    )


MARKET = f"""{RECORDS}, market AS (SELECT day, count_if(political) AS pol_article_count, round(coalesce(avg(CASE WHEN political THEN tone END), 0), 6) AS pol_tone_mean, round(coalesce(stddev_samp(CASE WHEN political THEN tone END), 0), 6) AS pol_tone_std,
  count_if(epu) AS epu_count, count_if(presidential) AS pres_article_count, round(coalesce(avg(CASE WHEN presidential THEN tone END), 0), 6) AS pres_tone_mean FROM records GROUP BY day HAVING count_if(political OR epu OR presidential) > 0)"""


@query(f"WITH {MARKET} SELECT * FROM market")
def news_daily_market(spark, sf_dir):
    """Daily market-wide statistics of three kinds of coverage."""
    return market(views.records(spark, sf_dir))


@query(f"WITH {RECORDS}, hits AS (SELECT day, tone, unnest(list_filter([CASE WHEN political THEN 'politics' END, CASE WHEN epu THEN 'economy' END, CASE WHEN presidential THEN 'president' END, CASE WHEN tone > 10 THEN 'extreme' END], lambda x: x IS NOT NULL)) AS topic FROM records) SELECT day, topic, {_TONE} FROM hits GROUP BY day, topic")
def news_daily_topics_unpivot(spark, sf_dir):
    """Daily tone by topic; one scan, a record counts in every topic it meets."""
    c = F.col
    flags = F.array(F.when(c("political"), "politics"), F.when(c("epu"), "economy"), F.when(c("presidential"), "president"), F.when(c("tone") > 10, "extreme"))
    return views.records(spark, sf_dir).select("day", "tone", F.explode(F.array_compact(flags)).alias("topic")).groupBy("day", "topic").agg(*tone_block())


#: What a source's titles are given at their end, by the source's number: events, and words that only look like them.
_TITLE_ENDS = (" Revenue guidance", " FTC lawsuit", " upgrades to outperform", " Downgraded: SELL", " misses secular finery", "")
_TITLED = "title || CASE TRY_CAST(substring(source, 4) AS INT) % 6 " + " ".join(f"WHEN {k} THEN '{x}'" for k, x in enumerate(_TITLE_ENDS[:-1])) + " ELSE '' END"


@query(
    f"""WITH {ARTICLES} SELECT source, count(*) AS n, round(coalesce(avg(sentiment), 0), 6) AS mean_sentiment, round(count(sentiment) / count(*), 6) AS coverage, round(count(*) FILTER (sentiment > 0.15) / count(*), 6) AS pct_positive, round(count(*) FILTER (sentiment < -0.15) / count(*), 6) AS pct_negative,
    {', '.join(f"bool_or(regexp_matches({_TITLED}, '(?i){p}')) AS {n}" for n, p in tx.TITLE_EVENTS.items())} FROM articles GROUP BY source"""
)
def news_feature_block(spark, sf_dir):
    """Sentiment shares over all articles of a source, and which events their titles name."""
    a, s, n = articles(spark, sf_dir), F.col("sentiment"), F.count(F.lit(1))
    kind = F.substring("source", 4, 9).try_cast("int") % 6
    end = F.coalesce(*(F.when(kind == k, F.lit(x)) for k, x in enumerate(_TITLE_ENDS)), F.lit(""))
    flags = [F.bool_or(F.concat("title", end).rlike(f"(?i){p}")).alias(k) for k, p in tx.TITLE_EVENTS.items()]
    return a.groupBy("source").agg(n.alias("n"), r6(F.coalesce(F.avg(s), F.lit(0.0))).alias("mean_sentiment"), r6(F.count(s) / n).alias("coverage"), r6(F.count_if(s > 0.15) / n).alias("pct_positive"), r6(F.count_if(s < -0.15) / n).alias("pct_negative"), *flags)


def dense(daily_rows: DataFrame, key: str, last: Column) -> DataFrame:
    """Every day from each key's first to ``last``, with the day's row where there is one."""
    span = daily_rows.groupBy(key).agg(F.min("day").alias("a")).select(key, F.explode(F.sequence("a", last)).alias("day"))
    return span.join(daily_rows, [key, "day"], "left")


_END = "2024-02-15"
DENSE = f"""{PER_TICKER}, span AS (SELECT ticker, CAST(unnest(generate_series(min(day), DATE '{_END}', INTERVAL 1 DAY)) AS DATE) AS day FROM per_ticker GROUP BY ticker), dense AS (SELECT * FROM span LEFT JOIN per_ticker USING (ticker, day))"""


@query(f"WITH {DENSE} SELECT ticker, day, coalesce(article_count, 0) AS article_count, tone_mean FROM dense")
def calendar_densify(spark, sf_dir):
    """A ticker's days without gaps: no coverage counts 0, its tone stays unknown."""
    d = dense(per_ticker(views.records(spark, sf_dir)), "ticker", F.lit(_END).cast("date"))
    return d.select("ticker", "day", F.coalesce("article_count", F.lit(0)).alias("article_count"), "tone_mean")


def buzz(count: Column, key: str, window: int = 60) -> Column:
    """A day's count over the mean of the days before, from max(5, window / 4) days on; NULL over a mean of 0."""
    w = Window.partitionBy(key).orderBy("day").rowsBetween(-window, -1)
    return F.when(F.count(count).over(w) >= max(5, window // 4), F.try_divide(count, F.avg(count).over(w)))


_BUZZ = "CASE WHEN count(n) OVER (PARTITION BY ticker ORDER BY day ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING) >= 15 THEN n / nullif(avg(n) OVER (PARTITION BY ticker ORDER BY day ROWS BETWEEN 60 PRECEDING AND 1 PRECEDING), 0) END"


@query(f"WITH {DENSE} SELECT ticker, day, round({_BUZZ}, 6) AS buzz FROM (SELECT *, coalesce(article_count, 0) AS n FROM dense)")
def news_buzz(spark, sf_dir):
    """A day's coverage against the 60 days before."""
    d = dense(per_ticker(views.records(spark, sf_dir)), "ticker", F.lit(_END).cast("date")).withColumn("n", F.coalesce("article_count", F.lit(0)).cast("double"))
    return d.select("ticker", "day", r6(buzz(F.col("n"), "ticker")).alias("buzz"))


def history(per_ticker_rows: DataFrame, days: DataFrame, lag: int = 1) -> DataFrame:
    """(ticker, day) rows with buzz, tone and shares known ``lag`` days before; levels carry over quiet days."""
    d = dense(per_ticker_rows, "ticker", F.lit(_END).cast("date")).withColumn("n", F.coalesce("article_count", F.lit(0)).cast("double"))
    so_far = Window.partitionBy("ticker").orderBy("day").rowsBetween(Window.unboundedPreceding, 0)
    carry = lambda x: F.last(x, ignorenulls=True).over(so_far)
    f = d.select("ticker", F.date_add("day", lag).alias("day"), buzz(F.col("n"), "ticker").alias("news_buzz"), carry(F.col("tone_mean")).alias("news_tone"), carry(F.try_divide("pos_count", "n")).alias("news_pos_frac"), carry(F.try_divide("neg_count", "n")).alias("news_neg_frac"))
    return as_of(days, f, ["ticker"], "day", ["news_buzz", "news_tone", "news_pos_frac", "news_neg_frac"])


_TRADING = f"SELECT t.ticker, d.day FROM (SELECT DISTINCT ticker FROM per_ticker) t, (SELECT CAST(unnest(generate_series(DATE '2024-01-02', DATE '{_END}', INTERVAL 1 DAY)) AS DATE) AS day) d WHERE dayofweek(d.day) BETWEEN 1 AND 5"


@query(
    f"""WITH {DENSE}, counted AS (SELECT *, coalesce(article_count, 0) AS n FROM dense), feats AS (SELECT ticker, day + 1 AS day, {_BUZZ} AS news_buzz, last_value(tone_mean IGNORE NULLS) OVER w AS news_tone,
    last_value(pos_count / nullif(n, 0) IGNORE NULLS) OVER w AS news_pos_frac, last_value(neg_count / nullif(n, 0) IGNORE NULLS) OVER w AS news_neg_frac FROM counted WINDOW w AS (PARTITION BY ticker ORDER BY day)), trading AS ({_TRADING})
    SELECT t.ticker, t.day, round(news_buzz, 6) AS news_buzz, round(news_tone, 6) AS news_tone, round(news_pos_frac, 6) AS news_pos_frac, round(news_neg_frac, 6) AS news_neg_frac FROM trading t ASOF LEFT JOIN feats f ON t.ticker = f.ticker AND t.day >= f.day"""
)
def news_history_features(spark, sf_dir):
    """Each ticker's news features on trading days, a day late and as of that day."""
    rows = per_ticker(views.records(spark, sf_dir))
    days = rows.select("ticker").distinct().select("ticker", F.explode(F.sequence(F.lit("2024-01-02").cast("date"), F.lit(_END).cast("date"))).alias("day")).where("dayofweek(day) between 2 and 6")
    h = history(rows, days)
    return h.select("ticker", "day", *(r6(F.col(x)).alias(x) for x in ("news_buzz", "news_tone", "news_pos_frac", "news_neg_frac")))


# articles --------------------------------------------------------------------------------


@query(f"WITH {ARTICLES} SELECT doc_id, trim(regexp_replace(title, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) AS title, CAST(epoch(published) AS BIGINT) AS ts FROM articles WHERE trim(regexp_replace(title, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')) <> ''")
def articles_clean(spark, sf_dir):
    """Articles with collapsed titles, none without a title, times in UTC."""
    a = articles(spark, sf_dir).withColumn("title", tx.clean(F.col("title")))
    return a.where("title <> ''").select("doc_id", "title", F.unix_timestamp("published").alias("ts"))


_CANON = """'https://news.' || lower(source) || '.example.com/a/' || (doc_id % 300) || CASE WHEN doc_id % 2 = 0 THEN '?id=1' ELSE '?b=2' END"""


@query(
    rf"""WITH {ARTICLES}, u AS (SELECT doc_id, regexp_replace(url, '#.*$', '') AS u FROM articles),
    p AS (SELECT doc_id, lower(regexp_extract(u, '^[A-Za-z]+://[^/?]+')) AS head, regexp_replace(regexp_extract(u, '^[A-Za-z]+://[^/?]+([^?]*)', 1), '/+$', '') AS path,
      list_filter(string_split(regexp_extract(u, '\?(.*)$', 1), '&'), lambda q: regexp_matches(q, '=.') AND NOT regexp_matches(lower(q), '^({"|".join(tx.TRACKING)})')) AS qs FROM u)
    SELECT doc_id, head || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN len(qs) > 0 THEN '?' || array_to_string(qs, '&') ELSE '' END AS url FROM p"""
)
def canonical_url(spark, sf_dir):
    """URLs without case, tracking, fragments and closing slashes."""
    return articles(spark, sf_dir).select("doc_id", tx.canonical_url(F.col("url")).alias("url"))


def ranked(a: DataFrame, needle: str, now: int, days: int = 30) -> DataFrame:
    """Articles with relevance: half recency, 0.4 mention (title 1, summary 0.6), 0.1 for a summary."""
    age = (F.lit(now) - F.unix_timestamp("published")) / 86400.0
    recency = F.greatest(F.lit(0.0), F.least(F.lit(1.0), 1 - age / days))
    low = lambda c: F.lower(F.coalesce(c, F.lit("")))
    mention = F.when(F.contains(low("title"), F.lit(needle)), 1.0).when(F.contains(low("summary"), F.lit(needle)), 0.6).otherwise(0.0)
    has = F.when(F.coalesce("summary", F.lit("")) != "", 0.1).otherwise(0.0)
    return a.withColumn("relevance", F.round(0.5 * recency + 0.4 * mention + has, 4))


_NOW = 1704067200 + 86400 * 20


@query(
    f"""WITH {ARTICLES} SELECT doc_id, round(CAST(0.5 AS DOUBLE) * greatest(0, least(1, 1 - ({_NOW} - epoch(published)) / 86400.0::DOUBLE / 30)) + CASE WHEN contains(lower(title), 'the') THEN 0.4::DOUBLE WHEN contains(lower(coalesce(summary, '')), 'the') THEN CAST(0.4 AS DOUBLE) * 0.6 ELSE 0 END + CASE WHEN coalesce(summary, '') <> '' THEN 0.1::DOUBLE ELSE 0 END, 4) AS relevance
    FROM articles ORDER BY relevance DESC, published DESC, doc_id LIMIT 25"""
)
def article_rank(spark, sf_dir):
    """The 25 most relevant articles for a name."""
    a = ranked(articles(spark, sf_dir), "the", _NOW)
    return a.orderBy(F.desc("relevance"), F.desc("published"), "doc_id").limit(25).select("doc_id", "relevance")


_TOKENS = "list_distinct(regexp_extract_all(lower(title), '[a-z0-9]+'))"


@query(
    f"""WITH {ARTICLES}, t AS (SELECT doc_id, list_sort({_TOKENS}) AS x FROM articles), g AS (SELECT x, min(doc_id) AS id FROM t WHERE len(x) > 0 GROUP BY x), tok AS (SELECT id, unnest(x) AS w FROM g),
    pairs AS (SELECT a.id AS a, b.id AS b, count(*) AS n FROM tok a JOIN tok b ON a.w = b.w AND a.id < b.id GROUP BY 1, 2)
    SELECT a, b, round(n / (len(x.x) + len(y.x) - n), 6) AS jaccard FROM pairs JOIN g x ON x.id = a JOIN g y ON y.id = b WHERE n / (len(x.x) + len(y.x) - n) >= 0.85
    UNION ALL SELECT g.id, t.doc_id, 1.0 FROM t JOIN g USING (x) WHERE t.doc_id > g.id"""
)
def jaccard_pairs_blocked(spark, sf_dir):
    """Titles alike by 0.85 or more: each title with the first of its token set, and pairs of these first ones."""
    return dedupe.similar_titles(articles(spark, sf_dir).select("doc_id", "title"), 0.85)


@query()
def article_greedy_dedupe(spark, sf_dir):
    """Articles after the merge, in their order, of equal URLs and titles alike by 0.85: rounds that no fixed SQL has, tested against brute force."""
    return dedupe.merge_articles(articles(spark, sf_dir).withColumn("url", tx.canonical_url(F.col("url"))), 0.85)


_ALIASES = {"AAA": ["than", "thanea"], "BBB": ["eau", "la reaux"], "CCC": ["ich", "und"], "DDD": ["nowhere"], "EEE": []}
_ALIAS_SQL = " UNION ALL ".join(f"SELECT '{t}' AS ticker, '(^|[^a-z0-9])({'|'.join(sorted(a, key=lambda x: (-len(x), x)))})([^a-z0-9]|$)' AS pattern" for t, a in _ALIASES.items() if a)


def alias_patterns(spark, aliases: dict[str, list[str]]) -> DataFrame:
    """(ticker, pattern): each ticker's aliases as one alternation, longest first; tickers without any have none."""
    rows = [(t, x) for t, names in aliases.items() for x in names]
    df = spark.createDataFrame(rows, "ticker string, alias string")
    esc = F.regexp_replace("alias", r"([\\.+*?\[^\]$(){}=!<>|:#/-])", r"\\$1")
    ordered = F.transform(F.array_sort(F.collect_list(F.struct((-F.length("alias")).alias("n"), F.col("alias"), esc.alias("e")))), lambda s: s["e"])
    return df.groupBy("ticker").agg(F.concat(F.lit("(^|[^a-z0-9])("), F.array_join(ordered, "|"), F.lit(")([^a-z0-9]|$)")).alias("pattern"))


@query(f"WITH aliases AS ({_ALIAS_SQL}), {ARTICLES} SELECT ticker, CAST(published AS DATE) AS day, count(*) AS article_count, round(avg(sentiment), 6) AS tone_mean FROM articles JOIN aliases ON regexp_matches(lower(title || ' ' || coalesce(summary, '')), pattern) GROUP BY ticker, CAST(published AS DATE)")
def alias_regex_join(spark, sf_dir):
    """Articles joined to the tickers whose aliases they name, by day: they meet on the longest word of an alias, and its pattern decides."""
    a = articles(spark, sf_dir).withColumn("body", F.lower(F.concat("title", F.lit(" "), F.coalesce("summary", F.lit("")))))
    names = spark.createDataFrame([(t, x) for t, xs in _ALIASES.items() for x in xs], "ticker string, alias string")
    hit = mentions(a.select("doc_id", "published", "sentiment", "body"), names)
    return hit.groupBy("ticker", F.to_date("published").alias("day")).agg(F.count(F.lit(1)).alias("article_count"), r6(F.avg("sentiment")).alias("tone_mean"))


def mentions(rows: DataFrame, names: DataFrame) -> DataFrame:
    """``rows`` (doc_id, body in lower case, ...) with each ticker of ``names`` (ticker, alias) that they name, once.

    An alias stands between characters that are no letters or digits, so its words are whole words of the body: rows and names meet on an
    alias's longest word, and the alias itself is then looked for.  A name without a letter or digit is met by none.
    """
    word = F.element_at(F.array_sort(F.transform(tx.tokens(F.col("alias")), lambda w: F.struct(F.length(w).alias("n"), w.alias("w")))), -1)["w"]
    named = names.where(F.size(tx.tokens(F.col("alias"))) > 0).select("ticker", F.lower("alias").alias("alias"), word.alias("w"))
    quoted = F.regexp_replace("alias", r"([\\.+*?\[^\]$(){}=!<>|:#/-])", r"\\$1")
    named = named.withColumn("pattern", F.concat(F.lit("(^|[^a-z0-9])"), quoted, F.lit("([^a-z0-9]|$)"))).drop("alias")
    met = rows.withColumn("w", F.explode(F.array_distinct(tx.tokens(F.col("body"))))).join(named, "w").where(F.expr("body rlike pattern"))
    return met.drop("w", "pattern", "body").distinct()


# payloads --------------------------------------------------------------------------------


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events WHERE CAST(json_extract(props, '$.k') AS BIGINT) >= 50")
def json_props_extract(spark, sf_dir):
    """A field of a JSON column."""
    e = views.table(spark, sf_dir, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))
    return e.where("k >= 50")


@query(
    """WITH lists AS (SELECT o_custkey, list(o_orderpriority ORDER BY o_orderkey) AS form, list(CAST(o_orderdate AS DATE) ORDER BY o_orderkey) AS day, list(o_orderkey ORDER BY o_orderkey) AS acc FROM orders GROUP BY o_custkey),
    rows_ AS (SELECT o_custkey, unnest(form) AS form, unnest(day) AS day, unnest(acc) AS acc FROM lists) SELECT o_custkey, form, day, acc FROM rows_ WHERE form = '1-URGENT' AND day >= DATE '1996-01-01' QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY day DESC, acc DESC) <= 3"""
)
def parallel_array_zip(spark, sf_dir):
    """Filings out of parallel arrays: one form, a floor of dates, the newest three."""
    o = views.table(spark, sf_dir, "orders")
    rows = F.array_sort(F.collect_list(F.struct("o_orderkey", "o_orderpriority", F.to_date("o_orderdate").alias("day"))))
    lists = o.groupBy("o_custkey").agg(rows.alias("r")).select("o_custkey", F.col("r.o_orderpriority").alias("form"), F.col("r.day").alias("day"), F.col("r.o_orderkey").alias("acc"))
    return payloads.filings(lists, ["o_custkey"], "1-URGENT", "1996-01-01", 3)


@query("SELECT DISTINCT upper(trim(split_part(r_name || CASE WHEN r_regionkey % 2 = 0 THEN ' # note' ELSE '' END, '#', 1))) AS ticker FROM region WHERE r_name <> ''")
def universe_dim(spark, sf_dir):
    """Names of a list file: comments and blanks gone, upper case."""
    lines = views.table(spark, sf_dir, "region").select(F.concat("r_name", F.when(F.col("r_regionkey") % 2 == 0, " # note").otherwise("")).alias("value"))
    return payloads.universe(lines)


@query(f"WITH {PER_TICKER} SELECT * FROM per_ticker")
def csv_roundtrip(spark, sf_dir):
    """A stream's table written as CSV under its schema and read again."""
    return payloads.csv_round_trip(per_ticker(views.records(spark, sf_dir)))


@query(f"WITH {MARKET} SELECT * FROM market UNION ALL SELECT * FROM market")
def json_append_log(spark, sf_dir):
    """A log appended twice as JSON lines and read past broken lines."""
    return payloads.json_log(market(views.records(spark, sf_dir)))


@query()
def html_to_text(spark, sf_dir):
    """Text of HTML pages without scripts and styles, one line for each block: a parser, tested on its own."""
    return payloads.page_texts(views.table(spark, sf_dir, "pages"))


@query(f"WITH {RECORDS} SELECT day, event_type, count(*) AS n, round(sum(tone), 6) AS total FROM records JOIN events USING (event_id) GROUP BY day, event_type")
def events_daily_stream(spark, sf_dir):
    """Daily counts of an event stream: watermark, tumbling days, all available files, then the batch table."""
    return daily.daily_totals(spark, sf_dir)
