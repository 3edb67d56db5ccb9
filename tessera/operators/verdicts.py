"""Ordered verdicts with their reasons, as Columns: word lists are parameters, the order of the rules is what is built here."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def has_word(text: Column, words: list[str]) -> Column:
    """Whether the text has one of the words or phrases, in either case; null has none."""
    return F.coalesce(text.rlike(r"(?i)\b(?:" + "|".join(words) + r")\b"), F.lit(False))


def first_failure(checks: list[tuple[str, Column]]) -> Column:
    """The reason of the first check that holds, null where none does; a check that is null doesn't hold."""
    return F.coalesce(*[F.when(F.coalesce(test, F.lit(False)), F.lit(reason)) for reason, test in checks])


def country_status(country: Column, place: Column, name: str, home: list[str], foreign: list[str]) -> Column:
    """home, foreign or unknown: the country's own name anywhere first, then a foreign country field, then places of home, then foreign ones."""
    own = has_word(country, [name]) | has_word(place, [name])
    other = has_word(country, foreign)
    return F.when(own, "home").when(other, "foreign").when(has_word(place, home), "home").when(has_word(place, foreign), "foreign").otherwise("unknown")


def eligibility(status: Column, place: Column, body: Column, source: Column, home: list[str], abroad: list[str], trusted: list[str]) -> Column:
    """eligible and reason: foreign fields, evidence of home in fields or text, work abroad, a trusted source, in this order."""
    reason = (
        F.when(status == "foreign", "foreign location")
        .when((status == "home") | has_word(place, home) | has_word(body, home), "evidence")
        .when(has_word(F.concat_ws(" ", place, body), abroad), "work abroad")
        .when(F.coalesce(F.lower(source).isin([s.lower() for s in trusted]), F.lit(False)), "trusted source")
        .otherwise("no evidence")
    )
    return F.struct(reason.isin("evidence", "trusted source").alias("eligible"), reason.alias("reason"))


def graded(text: Column, stated: Column, never: list[str], direct: list[str], general: list[str], near: list[str], unclear: list[str], employer: Column) -> Column:
    """tier, score and reason of a post. Never words veto; then what its source states, 62; direct words, 60 and 8 a word, 100 at most; a general
    degree at such an employer, 70; near roles, 45; unclear titles at such an employer, 35; nothing, 0.
    """
    hits = sum((has_word(text, [w]).cast("int") for w in direct), F.lit(0))
    rules = [
        (has_word(text, never), None, F.lit(0), "never"),
        (F.coalesce(stated, F.lit(False)), "B", F.lit(62), "stated"),
        (hits > 0, "A", F.least(F.lit(100), 60 + 8 * hits), "direct"),
        (has_word(text, general) & employer, "B", F.lit(70), "general degree"),
        (has_word(text, near), "C", F.lit(45), "near"),
        (has_word(text, unclear) & employer, "U", F.lit(35), "unclear"),
    ]
    pick = lambda of: F.coalesce(*[F.when(r[0], of(r)) for r in rules], of((None, None, F.lit(0), "none")))
    tier = F.nullif(pick(lambda r: F.lit(r[1] or "")), F.lit(""))
    return F.struct(tier.alias("tier"), pick(lambda r: r[2]).alias("score"), pick(lambda r: F.lit(r[3])).alias("reason"))


def robots_rules(sites: DataFrame, key: str, text: str, agent: str) -> DataFrame:
    """key, pattern, weight and allow of the rules that hold for an agent: those of the groups that name it, of `*` where none does.

    Agents in a row share the rules below them. Comments, lines without a colon and rules without a path say nothing.
    """
    lines = sites.select(key, F.posexplode(F.split(text, r"\r?\n")).alias("pos", "line"))
    said = F.btrim(F.regexp_replace("line", "#.*", ""))
    lines = lines.select(key, "pos", F.lower(F.btrim(F.regexp_extract(said, "^([^:]*):", 1))).alias("name"), F.btrim(F.regexp_extract(said, "^[^:]*:(.*)$", 1)).alias("value"))
    lines = lines.where(F.col("name").isin("user-agent", "allow", "disallow"))
    order = Window.partitionBy(key).orderBy("pos")
    begins = (F.col("name") == "user-agent") & (F.coalesce(F.lag("name").over(order), F.lit("")) != "user-agent")
    lines = lines.withColumn("_begins", begins.cast("int")).withColumn("group", F.sum("_begins").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    agents = F.lower("value")
    group = Window.partitionBy(key, "group")
    is_agent = F.col("name") == "user-agent"
    lines = lines.withColumn("_own", F.max(F.when(is_agent & (agents == agent.lower()), 1).otherwise(0)).over(group))
    lines = lines.withColumn("_any", F.max(F.when(is_agent & (agents == "*"), 1).otherwise(0)).over(group))
    lines = lines.withColumn("_known", F.max("_own").over(Window.partitionBy(key)))
    rules = lines.where(~is_agent & (F.col("value") != "") & (F.when(F.col("_known") == 1, F.col("_own")).otherwise(F.col("_any")) == 1))
    quoted = F.regexp_replace(F.regexp_replace("value", r"([.+?^{}()|\[\]\\]|\$(?!$))", r"\\$1"), r"\*", ".*")
    weight = F.char_length(F.regexp_replace("value", r"\*$", ""))
    return rules.select(key, F.concat(F.lit("^"), quoted).alias("pattern"), weight.alias("weight"), (F.col("name") == "allow").alias("allow"))


def allowed(links: DataFrame, rules: DataFrame, key: str, link: str, path: Column) -> DataFrame:
    """links with allowed: the longest rule of the site that matches the path decides, allowing ones before others of a length; no rule allows.

    `link` identifies rows; rules are few a site, so that the join grows with the links.
    """
    hits = links.select(key, link, path.alias("_path")).join(rules, key).where("_path RLIKE pattern")
    best = hits.groupBy(link).agg(F.max(F.struct("weight", "allow"))["allow"].alias("_best"))
    return links.join(best, link, "left").withColumn("allowed", F.coalesce("_best", F.lit(True))).drop("_best")


def news(headline: Column, body: Column, noise: list[str], wanted: list[str]) -> Column:
    """Why a piece of news is no vacancy: noise in its headline before all else, then no wanted word in headline or body; null where it is one."""
    return first_failure([("noise in headline", has_word(headline, noise)), ("no vacancy", ~has_word(F.concat_ws(" ", headline, body), wanted))])


def weightiest(title: Column, text: Column, rules: list[tuple[str, int, list[str]]], veto: list[str]) -> Column:
    """category and score of the weightiest rule with a word in the text, two more for one in the title; the first of equals. Score is a fifth of
    the weight, 1 at most; a vetoed title or a text without a word has none and 0.
    """
    found = [
        F.when(has_word(title, words) | has_word(text, words), F.struct((F.lit(weight) + F.when(has_word(title, words), 2).otherwise(0)).alias("weight"), F.lit(-i).alias("place"), F.lit(name).alias("category")))
        for i, (name, weight, words) in enumerate(rules)
    ]
    best = F.when(~has_word(title, veto), F.array_max(F.array_compact(F.array(*found))))
    return F.struct(best["category"].alias("category"), F.least(F.lit(1.0), F.coalesce(best["weight"] / 5, F.lit(0.0))).alias("score"))


def role_accepted(title: Column, body: Column, roles: list[str], others: list[str], context: list[str], practice: list[str]) -> Column:
    """accepted and reason: a wanted role in title or body before all else; work practices save other roles, and unclear ones in their context."""
    text = F.concat_ws(" ", title, body)
    practised, near = has_word(text, practice), has_word(text, context)
    reason = (
        F.when(has_word(text, roles), "role")
        .when(has_word(text, others), F.when(practised, "practices").otherwise("other role"))
        .when(near, F.when(practised, "context with practices").otherwise("context alone"))
        .otherwise("no such role")
    )
    return F.struct(reason.isin("role", "practices", "context with practices").alias("accepted"), reason.alias("reason"))


def level(text: Column, stated: Column, never: list[str], direct: list[str], related: list[str], possible: Column) -> Column:
    """direct, related, possible or none of a post: never words veto, then what its source states makes it related, then the lists in order."""
    known = F.coalesce(text, F.lit("")) != ""
    return (
        F.when(~known | has_word(text, never), "none")
        .when(F.coalesce(stated, F.lit(False)), "related")
        .when(has_word(text, direct), "direct")
        .when(has_word(text, related), "related")
        .when(F.coalesce(possible, F.lit(False)), "possible")
        .otherwise("none")
    )


def by_hits(text: Column, negative: list[str], positive: list[str]) -> Column:
    """status, tier, score and confidence by how many of the positive words a text has; a negative one vetoes."""
    hits = sum((has_word(text, [w]).cast("int") for w in positive), F.lit(0))
    rule = lambda status, tier, score, sure: F.struct(F.lit(status).alias("status"), F.lit(tier).alias("tier"), score.cast("int").alias("score"), F.lit(sure).alias("confidence"))
    many = rule("wanted", "A", F.least(F.lit(100), 70 + 8 * hits), 0.9)
    return F.when(has_word(text, negative), rule("unwanted", "C", F.lit(0), 0.98)).when(hits >= 2, many).when(hits == 1, rule("unknown", "B", F.lit(55), 0.65)).otherwise(rule("unknown", "U", F.lit(20), 0.3))


def selected(text: Column, branch_text: Column, post: Column, explicit: Column, by_role: Column, wanted: str, branches: list[str], roles: list[str]) -> Column:
    """kept, evidence and eligible of a record: lists of other branches reject it; the wanted word, a role, or the section it stood in keep it.

    Records that must say so themselves (explicit) are kept by their role only where by_role allows it, and never by their section.
    """
    out = has_word(branch_text, branches) & ~has_word(branch_text, [wanted])
    must = F.coalesce(explicit, F.lit(False))
    role = has_word(post, roles) & ~(must & ~F.coalesce(by_role, F.lit(False)))
    evidence = F.when(out, "branches exclude it").when(has_word(text, [wanted]), "qualification").when(role, "role").when(must, "none").otherwise("section")
    return F.struct(evidence.isin("qualification", "role", "section").alias("kept"), evidence.alias("evidence"), evidence.isin("role", "section").alias("eligible"))


def course(given: Column, text: Column, veto: Column, branches: list[str], strong: list[str], topics: list[tuple[str, Column]], engine: Column, special: Column, general: list[str]) -> Column:
    """topic and reason of a course, topic null where it is none: what an editor gave, a veto, other branches unless a strong word is there,
    topics in order, what the general verdict found to be direct or related, general words."""
    vague = F.when(engine == "possible", "needs an editor").otherwise("no topic")
    pair = lambda topic, reason: F.struct(topic.cast("string").alias("topic"), reason.alias("reason"))
    none = F.lit(None)
    steps = [
        (given.isNotNull(), pair(given, F.lit("editor"))),
        (F.coalesce(text, F.lit("")) == "", pair(none, F.lit("no text"))),
        (veto, pair(none, F.lit("veto"))),
        (has_word(text, branches) & ~has_word(text, strong), pair(none, F.lit("other branch"))),
        *[(test, pair(F.lit(name), F.lit("topic"))) for name, test in topics],
        (engine.isin("direct", "related"), pair(F.coalesce(special, F.lit("general")), engine)),
        (has_word(text, general), pair(F.lit("general"), F.lit("general word"))),
    ]
    return F.coalesce(*[F.when(F.coalesce(test, F.lit(False)), then) for test, then in steps], pair(none, vague))
