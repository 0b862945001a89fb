"""Review states of linkage as folds over tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

DONE = ("applied", "skipped", "rollback_conflict")


def eligible(matches: DataFrame) -> DataFrame:
    """Bulk and pending on both sides, or confirmed and selected."""
    bulk = (F.col("class") == "bulk") & (F.col("state") == "pending") & (F.col("target_class") == "bulk") & (F.col("target_state") == "pending")
    return matches.filter(bulk | ((F.col("state") == "confirmed") & (F.col("target_state") == "confirmed") & F.col("selected")))


def applied(matches: DataFrame) -> DataFrame:
    """New state and reason of each match that is to be applied (L02): the first check that fails decides. Needs eligible, shop_exists,
    approved, unchanged, bulk, identity_count, url_valid, url_taken, has_url, same_url and allow_replace."""
    checks: list[tuple[Column, str, str]] = [
        (F.col("state").isin(*DONE, "rolled_back"), "", "unchanged"),
        (~F.col("eligible"), "conflict", "state changed"),
        (~F.col("shop_exists"), "conflict", "shop deleted"),
        (~F.col("approved"), "conflict", "shop not public"),
        (~F.col("unchanged"), "conflict", "shop changed since matching"),
        (F.col("bulk") & (F.col("identity_count") != 1), "conflict", "no longer one to one"),
        (~F.col("url_valid"), "conflict", "URL not valid"),
        (F.col("url_taken"), "url_conflict", "URL of another shop"),
        (F.col("same_url"), "skipped", "URL already there"),
        (F.col("has_url") & ~F.col("allow_replace"), "conflict", "replacement not confirmed"),
    ]
    state = reason = None
    for when, s, r in checks:
        value = F.col("state") if s == "" else F.lit(s)
        state = F.when(when, value) if state is None else state.when(when, value)
        reason = F.when(when, r) if reason is None else reason.when(when, r)
    return matches.withColumn("reason", reason.otherwise("applied")).withColumn("state", state.otherwise("applied"))


def rolled_back(matches: DataFrame) -> DataFrame:
    """Undone only where values and version are still the applied ones."""
    due = F.col("state").isin("applied", "rollback_conflict") & F.col("applied_at").isNotNull()
    intact = F.col("shop_exists") & (F.col("current") == F.col("after")) & (F.col("version") == F.col("applied_version"))
    return matches.withColumn("state", F.when(~due, F.col("state")).when(F.coalesce(intact, F.lit(False)), "rolled_back").otherwise("rollback_conflict"))


def decided(targets: DataFrame, decisions: DataFrame) -> DataFrame:
    """Each target with its latest decision (L04): confirm, exclude, hold or restore."""
    last = decisions.groupBy("target").agg(F.max_by("action", F.struct("at", "id")).alias("action"))
    state = F.when(F.col("action") == "confirm", "confirmed").when(F.col("action") == "exclude", "excluded").when(F.col("action") == "hold", "held").when(F.col("action") == "restore", "pending").otherwise(F.col("state"))
    return targets.join(last, "target", "left").withColumn("state", state).drop("action")


def audit(before: DataFrame, after: DataFrame, key: str) -> DataFrame:
    """One event for each row whose state changed."""
    b = before.select(key, F.col("state").alias("was"))
    return after.join(b, key).filter(~F.col("was").eqNullSafe(F.col("state"))).select(key, F.to_json(F.struct(F.col("was").alias("from"), F.col("state").alias("to"))).alias("payload"))


def tab_conditions(state: Column, klass: Column, match_done: Column, url_conflict: Column) -> dict[str, Column]:
    """The condition of each of the five tabs; the first that holds decides."""
    return {
        "registered": state.isin(*DONE) | ((klass == "registered") & (state != "rolled_back")) | match_done,
        "excluded": state == "excluded",
        "held": state == "held",
        "url_conflict": (state == "url_conflict") | url_conflict,
        "unregistered": state.isin("pending", "confirmed", "conflict", "rolled_back"),
    }


def tab(state: Column, klass: Column, match_done: Column, url_conflict: Column) -> Column:
    """One of five tabs, disjoint by construction (L07): the first that fits."""
    (first, condition), *rest, _ = tab_conditions(state, klass, match_done, url_conflict).items()
    out = F.when(condition, first)
    for name, condition in rest:
        out = out.when(condition, name)
    return out.otherwise("unregistered")


def in_several_tabs(rows: DataFrame, key: str, conditions: dict[str, Column]) -> DataFrame:
    """(key, n, first, last) of rows that more than one condition holds for."""
    held = F.filter(F.array(*[F.when(c, F.lit(name)) for name, c in conditions.items()]), lambda x: x.isNotNull())
    found = rows.select(key, F.array_sort(held).alias("tabs")).filter(F.size("tabs") > 1)
    return found.select(key, F.size("tabs").cast("long").alias("n"), F.element_at("tabs", 1).alias("first"), F.element_at("tabs", -1).alias("last"))


def tab_order(group: str) -> list[Column]:
    """O06; the columns are of targets joined to their matches' aggregates."""
    c = F.col
    if group == "excluded":
        return [F.coalesce(c("excluded_at"), c("updated_at")).desc_nulls_last(), c("target").desc()]
    if group == "registered":
        return [F.coalesce(c("applied_at"), c("created_at")).desc_nulls_last(), c("target").desc()]
    return [(c("matches") > 0).desc(), c("confidence").desc_nulls_last(), F.coalesce(c("views"), F.lit(0)).desc(), c("shop_id").asc()]


def verified(shops: DataFrame, submissions: DataFrame) -> DataFrame:
    """Latest accepted submission of each shop written to its fields."""
    last = submissions.filter("status = 'approved'").groupBy("shop_id").agg(F.max_by(F.struct("area", "type"), F.struct("at", "id")).alias("s"))
    return shops.join(last, "shop_id", "left").withColumn("smoking_area", F.coalesce("s.area", "smoking_area")).withColumn("smoking_type", F.coalesce("s.type", "smoking_type")).drop("s")


#: What a report's reason holds a shop for.
HOLDS = {"closed": "closed", "moved": "moved", "non_smoking": "confirmed non-smoking", "duplicate": "duplicate"}


def resolved(shops: DataFrame, reports: DataFrame) -> DataFrame:
    """Shops put on hold for the reason of their latest resolved report."""
    last = reports.filter("status = 'resolved'").groupBy("shop_id").agg(F.max_by("reason", F.struct("updated_at", "id")).alias("reason"))
    hold = F.create_map(*[F.lit(x) for pair in HOLDS.items() for x in pair])[F.col("reason")]
    return shops.join(last, "shop_id", "left").withColumn("hold_reason", F.coalesce(hold, "hold_reason")).withColumn("on_hold", F.col("on_hold") | hold.isNotNull()).drop("reason")


#: Fixed value: beginning of the address that marks a link as searched for and not found.
NOT_FOUND = "https://not-found.local/"


def queue_conditions(affiliates: list[str], plain: list[str], suspect: str) -> dict[str, tuple[Column, bool]]:
    """Condition of each status of the admin queue, and whether its rows are ranked by views (Q15).

    Of an affiliate provider the link <p>_affiliate_url says whether it is set up, and <p>_url whether it was searched for in vain; of a plain one <p>_url says both.
    """
    c = lambda name: F.coalesce(F.col(name), F.lit(""))
    ok = F.col("approved")
    lost = lambda p: c(f"{p}_url").startswith(NOT_FOUND)
    out = {
        "pending": (~ok & ~F.coalesce("rejected", F.lit(False)) & ~F.coalesce("on_hold", F.lit(False)), False),
        "rejected": (F.coalesce("rejected", F.lit(False)), False),
        "all": (F.lit(True), False),
        "unverified": (F.coalesce("unverified", F.lit(False)), False),
        "hold": (F.coalesce("on_hold", F.lit(False)), False),
        f"{suspect}_suspect": (c(f"{suspect}_candidate_url") != "", False),
    }
    for p in affiliates:
        link = c(f"{p}_affiliate_url")
        out |= {f"{p}_missing": (ok & (link == "") & ~lost(p), True), f"{p}_configured": (ok & (link != ""), True), f"{p}_not_found": (ok & lost(p), True)}
    for p in plain:
        link = c(f"{p}_url")
        out |= {f"{p}_missing": (ok & (link == ""), True), f"{p}_configured": (ok & (link != "") & ~lost(p), True), f"{p}_not_found": (ok & lost(p), True)}
    return out


def queues(shops: DataFrame, views: DataFrame, conditions: dict[str, tuple[Column, bool]], n: int) -> DataFrame:
    """(status, rank, shop_id, views): the first ``n`` shops of every status, in one pass: by views where the status says so, then the newest."""
    of = F.filter(F.array(*[F.when(when, F.struct(F.lit(name).alias("status"), F.lit(by_views).alias("by_views"))) for name, (when, by_views) in conditions.items()]), lambda x: x.isNotNull())
    rows = shops.join(views, "shop_id", "left").fillna(0, ["views"]).select("shop_id", "created_on", "views", F.explode(of).alias("s"))
    order = [F.when(F.col("s.by_views"), F.col("views")).otherwise(0).desc(), F.desc("created_on"), F.desc("shop_id")]
    ranked = rows.withColumn("rank", F.row_number().over(Window.partitionBy("s.status").orderBy(*order))).filter(F.col("rank") <= n)
    return ranked.select(F.col("s.status").alias("status"), "rank", "shop_id", "views")
