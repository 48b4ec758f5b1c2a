"""Brand-mention monitor, review trend and the marketing-state snapshot
(B1–B12, C6)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.ranking import global_row_number
from ..functions.text import alias_pattern, extract_domains, js_number, js_trim

# Question templates (id, text with {category} / {city}), the
# brand-probe keys, the excerpt context and the campaigns of a state.
TEMPLATES = [("best", "best {category} services in {city}"),
             ("book", "how do I book {category} online in {city}")]
BRAND_PROBES = [("brand|what-is", "what is {brand}?"),
                ("brand|legit-check", "is {brand_domain} a legit home services company in India?")]
EXCERPT_CONTEXT = 60
TOP_CAMPAIGNS = 10


def question_grid(cities: DataFrame, categories: DataFrame, brand: str, brand_domain: str,
                  max_questions: int | None = None) -> DataFrame:
    """B1: the brand probes first, then template × category × city in input
    order (``cities``/``categories`` have ``name`` and ``ord``); with a budget
    of ``max_questions`` its first ones only. Key ``template|category|city``.

    The grid is an index range of the size of the result, equi-joined to the
    numbered dimensions."""
    spark = cities.sparkSession
    cities = global_row_number(cities.select("name", "ord"), [], ["ord"], out="_ci").withColumn("_ci", (F.col("_ci") - 1).cast("int"))
    cats = global_row_number(categories.select("name", "ord"), [], ["ord"], out="_ki").withColumn("_ki", (F.col("_ki") - 1).cast("int"))
    ny, nc = cities.count(), cats.count()
    size = len(TEMPLATES) * nc * ny
    if max_questions is not None:
        size = min(size, max(max_questions - len(BRAND_PROBES), 0))
    ny, nc = F.lit(max(ny, 1)), F.lit(max(nc, 1))
    i = F.col("id")
    grid = (spark.range(size)
            .select(i.alias("i"), F.floor(i / (nc * ny)).cast("int").alias("_ti"),
                    (F.floor(i / ny) % nc).cast("int").alias("_ki"), (i % ny).cast("int").alias("_ci")))
    tmpl = spark.createDataFrame([(i, t, s) for i, (t, s) in enumerate(TEMPLATES)], "_ti int, tid string, tmpl string")
    g = (grid.join(F.broadcast(tmpl), "_ti").join(cats.select("_ki", F.col("name").alias("category")), "_ki")
         .join(cities.select("_ci", F.col("name").alias("city")), "_ci"))
    text = F.replace(F.replace("tmpl", F.lit("{category}"), "category"), F.lit("{city}"), "city")
    qs = g.select((F.col("i") + len(BRAND_PROBES)).alias("ordinal"),
                  F.concat_ws("|", "tid", "category", "city").alias("key"), text.alias("text"), "city", "category")
    probes = spark.createDataFrame(
        [(i, k, t.format(brand=brand, brand_domain=brand_domain), None, None) for i, (k, t) in enumerate(BRAND_PROBES)],
        "ordinal long, key string, text string, city string, category string")
    all_ = probes.unionByName(qs)
    if max_questions is not None:
        all_ = all_.where(F.col("ordinal") < max_questions)
    return all_.orderBy("ordinal")


def detect_mention(text: Column, aliases: list[str]) -> Column:
    """B2: struct(mentioned, excerpt). The first alias **in list order** that
    matches decides; the excerpt is ±60 characters around its first match,
    trimmed."""
    result = F.lit(None).cast("struct<mentioned:boolean,excerpt:string>")
    for alias in reversed([a for a in aliases if a.strip()]):
        pat = alias_pattern(alias)
        pos = F.regexp_instr(text, F.lit(pat))
        mlen = F.length(F.regexp_extract(text, pat, 0))
        start = F.greatest(F.lit(1), pos - EXCERPT_CONTEXT)
        end = F.least(F.length(text) + 1, pos + mlen + EXCERPT_CONTEXT)
        hit = F.struct(F.lit(True).alias("mentioned"), js_trim(F.substring(text, start, end - start)).alias("excerpt"))
        result = F.when(text.isNotNull() & (pos > 0), hit).otherwise(result)
    return F.coalesce(result, F.struct(F.lit(False).alias("mentioned"), F.lit(None).cast("string").alias("excerpt")))


def _matches_any(c: Column, aliases: list[str]) -> Column:
    out = F.lit(False)
    for a in aliases:
        if a.strip():
            out = out | c.rlike(alias_pattern(a))
    return out


def classify_citations(domains: Column, aliases: list[str]) -> Column:
    """struct(brand_domain = first domain naming the brand, competitors =
    every domain that does not)."""
    brand = F.try_element_at(F.filter(domains, lambda d: _matches_any(d, aliases)), F.lit(1))
    others = F.filter(domains, lambda d: ~_matches_any(d, aliases))
    return F.struct(brand.alias("brand_domain"), others.alias("competitors"))


def build_observations(answers: DataFrame, aliases: list[str], app: str,
                       native_citations: str | None = None) -> DataFrame:
    """One observation per answer: mention flag, brand-cited domain,
    competitor domains and the whole answer text. Cited
    domains come from the URLs in the text, plus a native citation array
    column when the engine provides one."""
    doms = extract_domains(F.col("text"))
    if native_citations:
        doms = F.array_union(F.coalesce(F.col(native_citations), F.array().cast("array<string>")), doms)
    cit = classify_citations(doms, aliases)
    m = detect_mention(F.col("text"), aliases)
    cols = [F.lit(app).alias("app"), "run_at", "engine", F.col("prompt_key"),
            m["mentioned"].alias("brand_mentioned"), m["excerpt"].alias("excerpt"),
            cit["brand_domain"].alias("cited_url"), cit["competitors"].alias("competitors"),
            F.col("text").alias("raw_response")]
    keep = [c for c in ("conv_id", "turn") if c in answers.columns]
    return answers.select(*keep, *cols)


def _rate_aggs() -> list[Column]:
    n = F.count(F.lit(1))
    m = F.count_if(F.col("brand_mentioned"))
    return [n.cast("double").alias("observations"), m.cast("double").alias("mentions"),
            F.when(n > 0, F.round(m.cast("decimal(20,0)") / n.cast("decimal(20,0)"), 4).cast("double"))
            .alias("mention_rate")]


def _window(obs: DataFrame, app: str, day_from: str, day_to: str) -> DataFrame:
    d = F.to_date("run_at")
    return obs.where((F.col("app") == app) & d.between(F.lit(day_from).cast("date"), F.lit(day_to).cast("date")))


def mention_totals(obs, app, day_from, day_to) -> DataFrame:
    """B5."""
    return _window(obs, app, day_from, day_to).agg(*_rate_aggs())


def mention_rate_by(obs, app, day_from, day_to, by: str) -> DataFrame:
    """By ``engine``, ``category`` (key part 2) or ``city`` (part 3);
    brand probes are excluded from the key-part breakdowns."""
    o = _window(obs, app, day_from, day_to)
    if by == "engine":
        dim = F.col("engine")
    else:
        part = 2 if by == "category" else 3
        o = o.where(F.split_part("prompt_key", F.lit("|"), F.lit(1)) != "brand")
        dim = F.split_part("prompt_key", F.lit("|"), F.lit(part))
    return o.groupBy(dim.alias("dimension")).agg(*_rate_aggs()).orderBy("dimension")


def latest_run(obs, app) -> DataFrame:
    """Totals of the most recent run."""
    o = obs.where(F.col("app") == app)
    last = o.agg(F.max("run_at").alias("run_at"))          # one row
    return o.join(F.broadcast(last), "run_at").groupBy("run_at").agg(*_rate_aggs())


def reviews_trend(reviews: DataFrame, app: str, day_from: str, day_to: str, source: str | None = None) -> DataFrame:
    """Daily review snapshots, by date then source."""
    r = reviews.where((F.col("app") == app) & F.col("snapshot_date").between(
        F.lit(day_from).cast("date"), F.lit(day_to).cast("date")))
    if source:
        r = r.where(F.col("source") == source)
    return r.select("source", F.col("snapshot_date").cast("string").alias("snapshot_date"),
                    F.col("rating_avg").cast("double").alias("rating_avg"),
                    F.col("rating_count").cast("int").alias("rating_count"),
                    F.col("new_reviews_count").cast("int").alias("new_reviews_count")).orderBy("snapshot_date", "source")


def marketing_state(cac: DataFrame, cpfo: DataFrame, by_engine: DataFrame, app: str,
                    day_from: str, day_to: str, top: int = TOP_CAMPAIGNS) -> DataFrame:
    """One nested row: performance (M5), the ``top`` campaigns by spend
    (M6), the list of anomalies (empty until an alert layer fills it) and the
    by-engine mention summary with its window (B6, NULL without
    observations). Each list is bounded (``top`` campaigns, one entry per engine)."""
    top = (cpfo.orderBy(F.desc("spend_inr"), "campaign").limit(top)
           .agg(F.collect_list(F.struct("spend_inr", "campaign", "first_orders", "cost_per_first_order_inr"))
                .alias("_top"))
           .select(F.transform(F.sort_array("_top", asc=False), lambda x: F.struct(
               x["campaign"].alias("campaign"), x["spend_inr"].alias("spend_inr"),
               x["first_orders"].alias("first_orders"),
               x["cost_per_first_order_inr"].alias("cost_per_first_order_inr"))).alias("top_campaigns")))
    geo = by_engine.agg(
        F.sum("observations").alias("total_observations"),
        F.sort_array(F.collect_list(F.struct(F.col("dimension").alias("engine"), "observations", "mentions",
                                             "mention_rate"))).alias("by_engine"))
    geo = geo.select(F.when(F.col("total_observations").isNotNull(),
                            F.struct(F.struct(F.lit(day_from).alias("from"), F.lit(day_to).alias("to")).alias("window"),
                                     "total_observations", "by_engine")).alias("geo_snapshot"))
    return cac.select(F.lit(app).alias("app"), F.lit(day_from).alias("window_from"), F.lit(day_to).alias("window_to"),
                      F.struct(F.col("spend_inr"), F.col("first_orders"), F.col("blended_cac_inr")).alias("performance"),
                      top.scalar().alias("top_campaigns"), F.array().cast("array<string>").alias("anomalies"),
                      geo.scalar().alias("geo_snapshot"))


def state_summary(state: DataFrame) -> DataFrame:
    """The deterministic one-line summary of a B11 row."""
    p = F.col("performance")
    top = F.try_element_at("top_campaigns", F.lit(1))
    cac = F.when(p["blended_cac_inr"].isNull(), F.lit("n/a")).otherwise(
        F.concat(F.lit("₹"), js_number(p["blended_cac_inr"])))
    cpfo = F.when(top["cost_per_first_order_inr"].isNull(), F.lit("n/a")).otherwise(
        F.concat(F.lit("₹"), js_number(top["cost_per_first_order_inr"])))
    top_line = F.when(F.size("top_campaigns") > 0, F.concat(
        F.lit("Top-spend campaign: "), F.coalesce(top["campaign"], F.lit("unknown")), F.lit(" (₹"),
        js_number(top["spend_inr"]), F.lit(", CPFO "), cpfo, F.lit(")."))).otherwise(
        F.lit("No campaign spend yet — connect Meta/Google to populate."))
    line = F.concat_ws(" ",
                       F.concat(F.lit("Window "), F.col("window_from"), F.lit(".."), F.col("window_to"),
                                F.lit(" ("), F.col("app"), F.lit(").")),
                       F.concat(F.lit("Spend ₹"), js_number(p["spend_inr"]), F.lit(", first orders "),
                                js_number(p["first_orders"], 0), F.lit(", blended CAC "), cac, F.lit(".")),
                       top_line)
    return state.select("app", line.alias("summary"))
