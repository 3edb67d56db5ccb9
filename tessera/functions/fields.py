"""Fields of a notice read from its text, as Columns: pay, place, company, degree, deadline, numbers, commands and labels."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.amounts import salary  # noqa: F401
from tessera.functions.text import clean_text, day_of, first, first_label, let, slug

def lines_of(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), r"[\n|]")


def labelled(text: Column, labels: tuple[str, ...]) -> Column:
    """What stands behind a colon or dash after one of the labels, in the first line or column where something does."""
    split = lambda line: F.split(line, r"\s*[:–-]\s*", 2)
    ends = lambda line: F.exists(F.array(*map(F.lit, labels)), lambda w: F.endswith(F.lower(F.get(split(line), F.lit(0))), w))
    values = F.transform(F.filter(lines_of(text), ends), lambda line: F.btrim(F.get(split(line), F.lit(1))))
    return F.get(F.filter(values, lambda v: F.char_length(v) > 1), F.lit(0))


def spaced(text: Column) -> Column:
    """The words of a text in lower case between single spaces, with a space before and after."""
    return F.concat(F.lit(" "), F.btrim(F.regexp_replace(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+", " ")), F.lit(" "))


def location(text: Column, places: dict[str, str]) -> Column:
    """city and state of what follows `location:` or `based in`; where no city begins it, the first city of the list that it or the text names.

    The state is one that the label names, else the city's, else the first that the text names. Both as written in `places`.
    """
    based = F.get(F.filter(F.transform(lines_of(text), lambda line: F.get(F.split(line, r"(?i)\bbased (?:at|in)\b\W*", 2), F.lit(1))), lambda x: F.char_length(x) > 1), F.lit(0))
    cities, states = list(places), list(dict.fromkeys(places.values()))

    def read(label: Column) -> Column:
        said, everywhere = spaced(label), spaced(F.concat_ws(" ", label, text))
        named = lambda words, name: F.contains(words, F.lit(f" {name.lower()} "))
        begins = [F.when(F.startswith(said, F.lit(f" {c.lower()} ")) & F.lower(F.btrim(F.get(F.split(label, "[,–-]"), F.lit(0)))).eqNullSafe(c.lower()), c) for c in cities]
        city = F.coalesce(*begins, *[F.when(named(everywhere, c), c) for c in cities])
        own = [F.when(city == c, s) for c, s in places.items()]
        state = F.coalesce(*[F.when(named(said, s), s) for s in states], *own, *[F.when(named(everywhere, s), s) for s in states])
        return F.struct(city.alias("city"), state.alias("state"))

    return let(F.coalesce(labelled(text, ("location",)), based), read)


#: Endings of companies' names, certain ones and those that titles have too.
LEGAL_FORMS = ("pvt ltd", "pvt. ltd.", "private limited", "limited", "ltd", "llp", "inc", "corporation", "corp")
TRADES = ("infrastructure", "infra", "constructions", "construction", "builders", "developers", "projects", "consultants", "consultancy", "enterprises", "industries", "technologies", "solutions", "services", "group", "associates")


def company(text: Column, title: Column) -> Column:
    """The labelled name, else capitalised words up to a legal form, else up to a trade, else what follows `at` in the title.

    Null where that is the title itself, or one word that is neither form nor trade.
    """
    bare = lambda w: F.regexp_replace(F.lower(w), "[^\\p{L}]", "")
    ending = lambda forms: [f.replace(".", "").replace(" ", "").lower() for f in forms]
    # runs of words of names: each begins with a capital, a figure or &
    runs = F.flatten(F.transform(lines_of(text), lambda line: F.regexp_extract_all(line, F.lit(r"(?:(?<![\p{L}\p{N}])[\p{Lu}\p{N}&][\p{L}\p{N}&.'()]*[ -]*)+"), F.lit(0))))

    def upto(run: Column, forms: list[str]) -> Column:
        words = F.split(F.btrim(run), r"\s+")
        last = lambda i: bare(F.get(words, i)).isin(forms) | F.concat(bare(F.get(words, i - 1)), bare(F.get(words, i))).isin(forms)
        ends = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: (i > 0) & F.coalesce(last(i), F.lit(False)))
        # `Pvt Ltd` is one form: the end goes on while the next word is one too
        end = F.get(F.filter(ends, lambda i: ~F.array_contains(ends, i + 1)), F.lit(0))
        return F.when(end.isNotNull(), F.array_join(F.slice(words, 1, end + 1), " "))

    formed = lambda forms: F.get(F.filter(F.transform(runs, lambda r: upto(r, ending(forms))), lambda x: x.isNotNull()), F.lit(0))
    hosted = F.nullif(F.btrim(F.get(F.split(title, r"(?i)\s+at\s+|@"), F.lit(1))), F.lit(""))
    found = F.coalesce(labelled(text, ("company", "organisation", "organization", "employer")), formed(LEGAL_FORMS), formed(TRADES), F.when(F.char_length(hosted) > 2, hosted))

    def kept(name: Column) -> Column:
        lone = ~name.contains(" ") & ~bare(name).isin(ending(LEGAL_FORMS + TRADES))
        return F.when(~(F.lower(name).eqNullSafe(F.lower(title)) | lone), name)

    return let(F.btrim(found, F.lit(" ,;:-–")), kept)


# Degrees by their letters, and branches.
DEGREES = {"be": "B.E", "btech": "B.Tech", "barch": "B.Arch", "bsc": None, "diploma": "Diploma", "mtech": "M.Tech", "me": "M.E", "amie": None, "iti": "ITI"}
BRANCHES = ("Civil", "Structural", "Construction")


def degree(text: Column) -> Column:
    """degree and branch of the first qualification that the text names, the branch in its line; civil where the text names a kind of engineering only.

    A degree of two letters has capitals or dots, so that `be` and `me` are none.
    """
    marked = lambda w: (F.char_length(w) > 5) | w.rlike(r"\.|^[\p{Lu}\s]+$|\p{Lu}\p{Ll}{2}")
    letters = lambda w: F.regexp_replace(F.lower(w), r"[^\p{L}]", "")

    def of_line(line: Column) -> Column:
        words = F.regexp_extract_all(line, F.lit(r"[\p{L}.]+"), F.lit(0))
        pairs = F.transform(words, lambda w, i: F.struct(i.alias("i"), F.array(w, F.concat_ws(" ", w, F.get(words, i + 1))).alias("forms")))
        known = lambda w: letters(w).isin(list(DEGREES)) & marked(w)
        hit = F.get(F.filter(F.transform(pairs, lambda p: F.struct(p["i"].alias("i"), F.get(F.filter(p["forms"], known), F.lit(0)).alias("w"))), lambda p: p["w"].isNotNull()), F.lit(0))
        after = F.transform(F.slice(words, hit["i"] + 1, 12), letters)
        branch = F.coalesce(*[F.when(F.array_contains(after, b.lower()), b) for b in BRANCHES])
        name = F.coalesce(*[F.when(letters(hit["w"]) == k, v) for k, v in DEGREES.items() if v])
        return F.when(hit.isNotNull(), F.struct(name.alias("degree"), branch.alias("branch")))

    found = F.get(F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), of_line), lambda x: x.isNotNull()), F.lit(0))
    alone = F.coalesce(*[F.when(F.contains(spaced(text), F.lit(f" {b.lower()} engineering ")), "Civil") for b in BRANCHES])
    return let(found, lambda x: F.struct(x["degree"].alias("degree"), F.coalesce(x["branch"], F.when(x.isNull(), alone)).alias("branch")))


def deadline(text: Column) -> Column:
    """kind, day and days: a day after `last date` and the like or by itself, a number of days, or a promise to tell; fixed without a day otherwise."""
    day = r"(\d{1,2}[-/.]\d{1,2}[-/.]\d{2,4})"
    said = F.coalesce(first(text, rf"(?i)(?:last date(?: to apply)?|closing date|apply on or before|applications? .*? before)[:\s-]*{day}", 1), first(F.btrim(text), f"^{day}$", 1))
    days = first(text, r"(?i)within\s+(\d{1,3})\s+days?", 1).cast("int")
    kind = F.when(said.isNotNull(), "fixed").when(days.isNotNull(), "relative_days").when(text.rlike(r"(?i)update\s+soon"), "update_soon").when(text.rlike(r"(?i)notified\s+soon"), "notified_soon").otherwise("fixed")
    return F.struct(kind.alias("kind"), day_of(said).alias("day"), F.when(said.isNull(), days).alias("days"))


def notice_number(text: Column) -> Column:
    return first(text, r"(?i)\b(?:advertisement|advt\.?|notification|cen|ref(?:erence)?)[\s.#:/-]*([A-Z0-9][A-Z0-9./_-]{1,24})\b", 1)


def video_id(url: Column) -> Column:
    """The id in a short link's path, the parameter v, or the path of an embedded player."""
    return F.coalesce(first(url, r"^https?://youtu\.be/([^/?#]+)", 1), first(url, r"[?&]v=([^&#]+)", 1), first(url, r"/embed/([^/?#]+)", 1))


def duration(seconds: Column) -> Column:
    """Hours, minutes and seconds, greater ones only where there are some; null counts as 0."""
    s = F.coalesce(seconds, F.lit(0)).cast("bigint")
    h, m = F.floor(s / 3600), F.floor(s % 3600 / 60)
    piece = lambda n, unit: F.concat(n.cast("string"), F.lit(unit))
    return F.concat_ws(" ", F.when(h > 0, piece(h, "h")), F.when((h > 0) | (m > 0), piece(m, "m")), piece(s % 60, "s"))


def paragraphs(text: Column, words: int = 300) -> Column:
    """The words of a text in arrays' worth of `words`, blanks as one space; nothing of a text without words."""
    each = F.split(F.btrim(F.regexp_replace(text, r"\s+", " ")), " ")
    starts = F.filter(F.sequence(F.lit(0), F.size(each) - 1, F.lit(words)), lambda _: F.get(each, F.lit(0)) != "")
    return F.transform(starts, lambda i: F.array_join(F.slice(each, i + 1, F.lit(words)), " "))


#: What a notice is about, in order of precedence.
NOTICE_KINDS = {
    "result": ("result", "results", "final result", "selected candidates", "recommendation"),
    "admit_card": ("admit card", "hall ticket", "call letter", "e-admit", "e admit"),
    "closing_date_changed": ("extend*", "reopen*", "re-open*", "last date extended"),
    "updated": ("corrigendum", "addendum", "amendment", "revised", "correction"),
    "new": ("apply online", "online application", "notification", "advertisement", "recruitment", "vacancy", "vacanc*"),
}


def by_words(kinds: dict[str, tuple[str, ...]], text: Column, otherwise: str) -> Column:
    """The first kind of which the text has a word or phrase; a star stands for the rest of a word."""
    rules = [(kind, r"(?i)\b(?:" + "|".join(w.replace("*", r"\w*") for w in words) + r")\b") for kind, words in kinds.items()]
    return first_label(rules, text, otherwise)


def short_age(seconds: Column) -> Column:
    """`just now`, minutes, hours, days, months of 30 days or years of 365; what lies ahead is now."""
    s = F.greatest(seconds, F.lit(0))
    said = lambda per, unit: F.concat(F.floor(s / per).cast("string"), F.lit(f"{unit} ago"))
    day = 86_400
    return F.when(s < 60, "just now").when(s < 3600, said(60, "m")).when(s < day, said(3600, "h")).when(s < 30 * day, said(day, "d")).when(s < 360 * day, said(30 * day, "mo")).otherwise(said(365 * day, "y"))


def age_class(seconds: Column) -> Column:
    """fresh up to two days, recent up to seven, old after that and for what lies ahead; empty where unknown."""
    return F.when(seconds.isNull(), "").when((seconds < 0) | (seconds > 7 * 86_400), "old").when(seconds > 2 * 86_400, "recent").otherwise("fresh")


def lakhs(amount: Column) -> Column:
    """Rupees, from a lakh up in lakhs to one decimal, without .0."""
    tenths = F.floor(amount / 10_000 + 0.5)
    shown = F.concat(F.floor(tenths / 10).cast("string"), F.when(tenths % 10 > 0, F.concat(F.lit("."), (tenths % 10).cast("string"))).otherwise(""))
    return F.when(amount >= 100_000, F.concat(F.lit("₹"), shown, F.lit("L"))).otherwise(F.concat(F.lit("₹"), F.floor(amount).cast("string")))


def command(text: Column, names: list[str]) -> Column:
    """name and rest: a listed word that begins the message, or `details` where a mobile number does; `help` with all of it otherwise."""
    t = F.btrim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    number = first(t, r"^(?:\+?91[ -]?)?([6-9]\d{9}) .", 1)
    listed = F.lower(first(t, rf"(?i)^({'|'.join(names)})\b", 1))
    rest = F.when(number.isNotNull(), F.regexp_replace(t, r"^(?:\+?91[ -]?)?[6-9]\d{9} ", "")).when(listed.isNotNull(), F.btrim(F.substr(t, F.length(listed) + 1))).otherwise(t)
    return F.struct(F.when(number.isNotNull(), "details").otherwise(F.coalesce(listed, F.lit("help"))).alias("name"), number.alias("number"), rest.alias("rest"))


def label_of(column: Column, labels: list[str]) -> Column:
    """The first label that has the slug of a value; null for other slugs."""
    return F.coalesce(*[F.when(slug(column) == slug(F.lit(x)), F.lit(x)) for x in labels])


def landing(path: Column, roles: list[str], places: list[str]) -> Column:
    """role and place of `role-jobs-in-place` and `role-jobs`; both null where either isn't listed."""
    p = F.regexp_replace(F.lower(path), "^/|/+$", "")
    role, place = F.coalesce(first(p, "^(.+)-jobs-in-[a-z0-9-]+$", 1), first(p, "^(.+)-jobs$", 1)), first(p, "-jobs-in-([a-z0-9-]+)$", 1)
    known = lambda c, values: F.when(c.isin(values), c)
    good = known(role, roles).isNotNull() & (place.isNull() | known(place, places).isNotNull())
    return F.struct(F.when(good, role).alias("role"), F.when(good, place).alias("place"))


def resolved(values: Column, how: Column, manual: Column) -> Column:
    """A conflict's value: of the first official of its structs (value, official, confidence), of the highest confidence, first of equals, or as said."""
    official = F.get(F.filter(values, lambda v: v["official"]), F.lit(0))["value"]
    better = lambda a, v: F.when(a["c"] >= F.coalesce(v["confidence"], F.lit(0.0)), a).otherwise(F.struct(F.coalesce(v["confidence"], F.lit(0.0)).alias("c"), v["value"].alias("value")))
    highest = F.reduce(values, F.struct(F.lit(float("-inf")).alias("c"), F.lit(None).cast("string").alias("value")), better)["value"]
    return F.when(how == "official", official).when(how == "highest", highest).otherwise(manual)


def content_errors(columns: dict[str, int], required: str, tagged: str, tags: int = 30) -> Column:
    """What is wrong with a post: no title, columns over their lengths, too many hashtags, in that order."""
    over = [F.when(F.char_length(c) > n, F.lit(f"{c} exceeds {n} characters")) for c, n in columns.items()]
    many = F.regexp_count(F.col(tagged), F.lit(r"#\w+"))
    return F.array_compact(F.array(F.when(F.coalesce(F.btrim(required), F.lit("")) == "", f"{required} is required"), *over, F.when(many > tags, F.concat(F.lit(f"{tagged} has "), many.cast("string"), F.lit(f" hashtags (max {tags})")))))


def for_freshers(text: Column) -> Column:
    """Said to be for freshers, at most two years asked, or no years stated."""
    asked = first(text, r"(?i)(\d+)\s*[-–]?\s*\+?\s*year", 1).cast("int")
    return text.rlike(r"(?i)fresher|entry[ -]level|\b0\s*[-–]\s*1\b") | F.coalesce(asked <= 2, F.lit(True))


def field(block: Column, names: list[str]) -> Column:
    """The cleaned text of the first of an element's named children that has some."""
    return reduce(F.coalesce, [F.nullif(clean_text(first(block, rf"(?is)<{n}\b[^>]*>(.*?)</{n}>", 1)), F.lit("")) for n in names])


#: Kinds of work, in order of precedence.
WORK_TYPES = [("Hybrid", "(?i)hybrid"), ("Remote", "(?i)remote|work from home|wfh"), ("Site", "(?i)site|field"), ("Office", "(?i)office")]


def canonical_json(column: Column) -> Column:
    """JSON with keys in order at every level and no blanks; null where it is none."""
    return F.to_json(F.try_parse_json(column))


def _member(json: Column, path: str) -> Column:
    return F.nullif(F.btrim(F.get_json_object(json, path)), F.lit(""))


def posted_place(json: Column) -> Column:
    """city, region, country and all of them in one text, of a structured posting's place as JSON: the first of a list; a bare text is the text."""
    one = F.when(json.startswith("["), F.get_json_object(json, "$[0]")).otherwise(json)
    inside = F.coalesce(F.get_json_object(one, "$.address"), one)
    city = F.coalesce(_member(inside, "$.addressLocality"), _member(inside, "$.addressCity"))
    country = F.coalesce(_member(inside, "$.addressCountry.name"), F.when(~F.get_json_object(inside, "$.addressCountry").startswith("{"), _member(inside, "$.addressCountry")))
    parts = {"city": city, "region": _member(inside, "$.addressRegion"), "country": country}
    text = F.when(one.startswith("{"), F.nullif(F.concat_ws(", ", *parts.values()), F.lit(""))).otherwise(clean_text(one))
    return F.struct(*[c.alias(n) for n, c in parts.items()], text.alias("location"))


def posted_pay(json: Column) -> Column:
    """Currency, amount or range, and unit of a structured posting's pay as JSON; null where it names no amount in an object."""
    value = F.get_json_object(json, "$.value")
    held = F.when(value.startswith("{"), value).when(value.isNull(), json)
    low, high = F.coalesce(_member(held, "$.minValue"), _member(held, "$.value")), _member(held, "$.maxValue")
    ranged = F.when(high.isNotNull() & ~high.eqNullSafe(low), F.concat(F.coalesce(low, F.lit("")), F.lit(" - "), high)).otherwise(low)
    said = F.concat_ws(" ", F.coalesce(_member(json, "$.currency"), _member(held, "$.currency")), F.btrim(ranged), _member(held, "$.unitText"))
    return F.when(ranged.isNotNull(), said)
