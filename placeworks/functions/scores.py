"""Scores of search demand, freshness and links (C03-C36). Bands have the gaps they are defined with."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from placeworks.functions.geo import clamp, half_up
from placeworks.functions.text import contains_any


def banded(c: Column, bands: list[tuple[float, float, float]], default: float, closed: bool = True) -> Column:
    """Value of the first band (low, high, value) that holds c; with ``closed`` the upper end belongs to it."""
    out = None
    for low, high, value in bands:
        hit = (c >= low) & ((c <= high) if closed else (c < high))
        out = F.when(hit, F.lit(float(value))) if out is None else out.when(hit, F.lit(float(value)))
    return out.otherwise(F.lit(float(default)))


def labelled(c: Column, values: dict[str, float], default: float) -> Column:
    out = None
    for label, value in values.items():
        out = F.when(c == label, F.lit(float(value))) if out is None else out.when(c == label, F.lit(float(value)))
    return out.otherwise(F.lit(float(default)))


#: Multipliers by band or label.
POSITION = [(1, 3, 0.6), (4, 7, 1.0), (8, 20, 1.6), (21, 50, 1.2)]
CTR = [(0, 1, 1.6), (1, 3, 1.3), (3, 8, 1.0)]
INTENT = {"high": 1.4, "medium": 1.15, "low": 0.7}
IMPACT_POSITION = [(1, 3, 0.8), (4, 10, 1.6), (11, 20, 2.0), (21, 50, 1.4)]
IMPACT_CTR = [(0, 1, 2.0), (1, 3, 1.6), (3, 8, 1.2)]
ENGAGEMENT = [(0, 10, 0.5), (10, 30, 1.0), (30, 90, 1.5)]
THEME_VALUE = {"shisha": 1.6, "date": 1.5, "private": 1.25, "bar": 1.2}
THEME = {"date": 1.7, "shisha": 1.8, "private": 1.35, "bar": 1.3, "night": 1.25, "pub": 1.1, "smoking area": 0.45}
COST = {"ctr": 1.0, "near win": 1.2, "links": 1.5, "article": 3.0, "shops": 5.0}


def position_multiplier(c: Column) -> Column:
    return banded(c, POSITION, 0.7)


def ctr_multiplier(c: Column) -> Column:
    return banded(c, CTR, 0.7, closed=False)


def intent_multiplier(c: Column) -> Column:
    return labelled(c, INTENT, 1.0)


def page_value(views: Column, users: Column, seconds: Column, events: Column, theme: Column) -> Column:
    """0 without any traffic."""
    per_user = F.when(users > 0, events / users).otherwise(events.cast("double"))
    base = views + users * 3 + per_user * 5 + banded(seconds, ENGAGEMENT, 2.0, closed=False) * 20
    return F.when((views <= 0) & (users <= 0) & (events <= 0), 0.0).otherwise(half_up(base * labelled(theme, THEME_VALUE, 1.0)))


def theme_multiplier(c: Column) -> Column:
    return labelled(c, THEME, 1.0)


def total_opportunity(expected: Column, value: Column, theme: Column) -> Column:
    return (expected + value * 1.8) * theme_multiplier(theme)


def expected_impact(impressions: Column, position: Column, ctr: Column, supply: Column, fit: Column, intent: Column) -> Column:
    """C13."""
    shortage = F.when(supply <= 20, 2.0).when(supply <= 60, 1.5).otherwise(1.0)
    return half_up(impressions * banded(position, IMPACT_POSITION, 0.8) * banded(ctr, IMPACT_CTR, 0.8, closed=False) * shortage * fit * intent_multiplier(intent))


def supply(shops: Column, confirmed: Column, articles: Column) -> Column:
    return F.greatest(shops + confirmed * 2 + articles * 20, F.lit(5))


def action(position: Column, impressions: Column, ctr: Column, shops: Column, articles: Column, views: Column, seconds: Column) -> Column:
    """The first that applies."""
    return (
        F.when((position >= 8) & (position <= 20) & (impressions >= 30), "near win")
        .when((position <= 10) & (ctr < 1.5), "ctr")
        .when(shops <= 15, "shops")
        .when(articles <= 1, "article")
        .when((views > 0) & (seconds < 15), "links")
        .otherwise("maintain")
    )


def work_cost(c: Column) -> Column:
    return labelled(c, COST, 2.0)


def roi(expected: Column, act: Column) -> Column:
    return half_up(expected / work_cost(act))


def next_move(seo: Column, page: Column, roi_score: Column, intent: Column, strategy: Column) -> Column:
    """C18."""
    boost = labelled(intent, {"high": 1.35, "medium": 1.15}, 1.0) * labelled(strategy, {"improve": 1.25, "local": 1.2, "theme": 1.15}, 1.0)
    return half_up((seo * 0.45 + page * 0.35 + roi_score * 0.2) * boost)


def strategy(general: Column, specific: Column, relevance: Column, landing: Column, position: Column, ctr: Column, articles: Column, local: Column, theme: Column) -> Column:
    """C19."""
    strong = relevance >= 70
    return (
        F.when(~general | specific, "none")
        .when(landing & strong & (position <= 15) & (ctr < 2), "improve")
        .when(local & ~strong, "local")
        .when(theme & ~strong & (articles <= 1), "theme")
        .when(landing & strong, "improve")
        .otherwise("new")
    )


def next_move_type(strat: Column, ctr: Column, value: Column, theme: Column, confirmed: Column, shops: Column, act: Column) -> Column:
    """C20."""
    return (
        F.when((strat == "improve") & (ctr < 2), "improve ctr")
        .when(strat.isin("local", "theme", "new"), "new article")
        .when((value >= 100) & theme, "circulation")
        .when((confirmed < 10) & (shops > 0), "confirm shops")
        .when(act == "links", "links")
        .otherwise(F.coalesce(act, F.lit("maintain")))
    )


def freshness(as_of: Column, confirmed_on: Column, approved: Column, linked: Column, updated_on: Column, unverified: Column, area_unknown: Column, type_unknown: Column) -> Column:
    """0 to 100 (C25)."""
    days = F.datediff(as_of, confirmed_on)
    tier = F.when(confirmed_on.isNull(), 0).when(days <= 30, 60).when(days <= 90, 45).when(days <= 180, 30).when(days <= 365, 15).otherwise(5)
    add = lambda c, n: F.when(c, n).otherwise(0)
    total = tier + add(approved, 20) + add(linked, 10) + add(F.datediff(as_of, updated_on) <= 30, 10) - add(unverified, 25) - add(area_unknown, 10) - add(type_unknown, 10)
    return clamp(total, 0, 100).cast("int")


def freshness_band(c: Column) -> Column:
    """C26."""
    return F.when(c.between(80, 100), "high").when(c.between(50, 79), "middle").when(c.between(1, 49), "low").otherwise("unknown")


def badge(n: Column) -> Column:
    """Highest tier reached."""
    return F.when(n >= 100, 100).when(n >= 30, 30).when(n >= 10, 10).when(n >= 5, 5).when(n >= 1, 1).otherwise(0)


def relatedness(area_hits: Column, genre_hits: Column, has_image: Column) -> Column:
    """C29."""
    return area_hits * 10 + genre_hits * 6 + F.when(has_image, 2).otherwise(0)


def article_relevance(local: Column, area: Column, genre: Column, theme: Column, words: Column) -> Column:
    """Matches of the place, genre and theme, and of single words."""
    one = lambda c, n: F.when(c, n).otherwise(0)
    return one(local, 35) + one(area, 25) + one(genre, 25) + one(theme, 20) + words * 5


def unnatural(query: Column, topic: str, definition: str, allowed: str) -> Column:
    """Asks for a definition or joins names without the topic, has full-width Latin, or four words without an allowed one."""
    low = F.trim(F.lower(query))
    words = F.size(F.filter(F.split(low, r"[\s　]+"), lambda x: x != ""))
    return (low.contains(definition) & ~low.contains(topic)) | (low.rlike("[&×]") & ~low.contains(topic)) | low.rlike("[ａ-ｚＡ-Ｚ]") | ((words >= 4) & ~low.rlike(allowed))


def page_type(path: Column) -> Column:
    """C34."""
    return F.when(path.startswith("/articles"), "article").when(path.startswith("/shops"), "shop").when(path.rlike("^/[a-z-]+(?:/|$)"), "list").otherwise("other")


def intent(query: Column, keywords: dict[str, list[str]]) -> Column:
    """The first level, in the order given, of which the query contains a keyword; else unknown."""
    out = None
    for level, words in keywords.items():
        hit = contains_any(query, words)
        out = F.when(hit, level) if out is None else out.when(hit, level)
    return (out if out is not None else F.when(F.lit(False), "")).otherwise("unknown")


def component_scores(impressions: Column, clicks: Column, position: Column, ctr: Column, fit: Column, supplied: Column) -> Column:
    """Demand, growth, views, revenue, gap and rate of one query as a struct; ``fit`` includes the intent's multiplier."""
    demand = impressions + clicks * 5
    growth = position_multiplier(position) * ctr_multiplier(ctr)
    return F.struct(demand.alias("demand"), growth.alias("growth"), (demand * growth).alias("views"), (demand * growth * fit).alias("revenue"), (demand / F.greatest(supplied, F.lit(5))).alias("gap"), (impressions * ctr_multiplier(ctr)).alias("rate"))


def landing_page(best_path: Column, best_score: Column, area: Column, genre: Column, area_pages: dict[str, str], genre_pages: dict[tuple[str, str], str]) -> Column:
    """The best article's path or a page of the area (2) or of its genre (4), whichever scores most; the first named wins ties, empty without any."""
    option = lambda path, score, order: F.struct(score.cast("double").alias("score"), F.lit(-order).alias("order"), path.alias("path"))
    fixed = lambda table, key: F.create_map(*[F.lit(x) for pair in table.items() for x in pair])[key] if table else F.lit(None).cast("string")
    of_area = fixed(area_pages, area)
    of_genre = fixed({f"{a}|{g}": path for (a, g), path in genre_pages.items()}, F.concat_ws("|", area, genre))
    options = F.array(F.when(best_path.isNotNull() & (best_path != ""), option(best_path, best_score, 0)), F.when(of_area.isNotNull(), option(of_area, F.lit(2), 1)), F.when(of_genre.isNotNull(), option(of_genre, F.lit(4), 2)))
    return F.coalesce(F.array_max(F.filter(options, lambda x: x.isNotNull()))["path"], F.lit(""))


def advice(rules: list[tuple[Column, Column]], fallback: str) -> Column:
    """The texts of all rules that hold, in order and distinct; the fallback where none does. Texts may be built from columns."""
    said = F.array_distinct(F.filter(F.array(*[F.when(F.coalesce(when, F.lit(False)), text) for when, text in rules]), lambda x: x.isNotNull()))
    return F.when(F.size(said) > 0, said).otherwise(F.array(F.lit(fallback)))


def work_items(action_: Column, shops: Column, confirmed: Column, articles: Column, ctr: Column, impressions: Column, position: Column, area: Column, genre: Column) -> Column:
    """What to do for a query, as labels."""
    placed = area.isNotNull() & genre.isNotNull()
    return advice(
        [
            (action_ == "near win", F.lit("improve title, links and lead: position 8 to 20")),
            ((shops < 20) & placed, F.concat(F.lit("collect shops: "), area, F.lit(" "), genre)),
            ((confirmed < 10) & (shops > 0), F.lit("confirm known shops")),
            ((articles == 0) & placed, F.concat(F.lit("write an article: "), area, F.lit(" "), genre)),
            ((ctr < 2.0) & (impressions >= 30), F.lit("improve title and description")),
            ((position >= 8) & (position <= 30), F.lit("link from related pages")),
        ],
        "check existing pages",
    )


def theme_type(theme: Column) -> Column:
    """C35."""
    return F.when(theme.isin("date", "shisha", "bar"), "circulation").when(theme.isin("private", "night"), "conversion").otherwise("search")


def hit_score(name: Column, short: Column, town: Column, title: Column, snippet: Column, link: Column, places: list[str], path: str) -> Column:
    """Additive evidence that a search hit is a shop's page: its names in title and snippet, its town, known places, the path."""
    held = lambda text, part: (F.coalesce(part, F.lit("")) != "") & F.contains(text, part)
    add = lambda when, n: F.when(F.coalesce(when, F.lit(False)), n).otherwise(0)
    low, below = F.lower(title), F.lower(snippet)
    total = add(held(low, name), 35) + add(held(low, short), 30) + add(held(below, name), 20) + add(held(below, short), 15) + add(held(title, town) | held(snippet, town), 20)
    for place in places:
        total = total + add(title.contains(place) | snippet.contains(place), 15)
    return total + add(link.contains(path), 10)
