"""Amounts of pay and years read from the words of a text, one after the other, as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import let

# Signs of currencies, words behind a number, words of a line about pay.
SIGNS = {"INR": ("₹", "rs", "inr", "rupee", "rupees"), "USD": ("$", "usd"), "EUR": ("€", "eur", "euro"), "AED": ("aed", "dhs")}
LAKHS, THOUSANDS = ("lpa", "lakh", "lakhs", "lac", "lacs"), ("k", "thousand")
PAY_LINES, DASHES, YEARS = ("salary", "ctc", "pay", "stipend", "package"), ("-", "–", "to"), ("year", "years", "yr", "yrs")

_BEFORE = [s for name, signs in SIGNS.items() if name != "AED" for s in signs if not s.startswith("rupee")]


def words(text: Column) -> Column:
    """Signs, dashes, numbers and words of a text in lower case, in order."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(r"[₹$€+–-]|\d[\d,.]*|\p{L}+"), F.lit(0))


def _number(word: Column) -> Column:
    return F.when(word.rlike(r"^\d"), F.regexp_replace(F.replace(word, F.lit(","), F.lit("")), r"\.$", "").try_cast("double"))


def _readings(said: Column, read: object) -> Column:
    """What read(i) makes of each number's place i among the words; null readings go, the smallest one counts."""
    places = F.when(F.size(said) > 0, F.sequence(F.lit(0), F.size(said) - 1)).otherwise(F.array().cast("array<int>"))
    return F.array_min(F.filter(F.transform(F.filter(places, lambda i: _number(F.get(said, i)).isNotNull()), read), lambda x: x["rank"].isNotNull()))


def salary(text: Column) -> Column:
    """least, most, currency, period of the first line about pay, of the whole text where there is none.

    A range goes before a number behind a sign, that before one of lakhs. One unit holds for both ends of a range; lakhs mean rupees a
    year where nothing else is said.
    """
    lines = F.split(text, "\n")
    source = F.coalesce(F.get(F.filter(lines, lambda line: F.arrays_overlap(words(line), F.array(*map(F.lit, PAY_LINES)))), F.lit(0)), text)

    def read(said: Column) -> Column:
        at = lambda i: F.get(said, i)
        unit_at = lambda i: F.when(at(i).isin([*LAKHS, *THOUSANDS]), at(i))

        def amount(i: Column) -> Column:
            unit = unit_at(i + 1)
            dash = i + F.when(unit.isNull(), 1).otherwise(2)
            second = dash + F.when(at(dash + 1).isin(_BEFORE), 2).otherwise(1)
            most = F.when(at(dash).isin(list(DASHES)), _number(at(second)))
            rank = F.when(most.isNotNull(), 0).when(at(i - 1).isin(_BEFORE), 1).when(unit.isin(list(LAKHS)), 2)
            own = F.coalesce(unit, F.when(most.isNotNull(), unit_at(second + 1)))
            return F.struct(rank.alias("rank"), i.alias("i"), _number(at(i)).alias("least"), most.alias("most"), own.alias("unit"))

        def told(x: Column) -> Column:
            has = lambda *w: F.arrays_overlap(said, F.array(*map(F.lit, w)))
            lakhs = x["unit"].isin(list(LAKHS))
            factor = F.when(lakhs, 100_000.0).when(x["unit"].isin(list(THOUSANDS)), 1000.0).otherwise(1.0)
            currency = F.coalesce(*[F.when(has(*signs), name) for name, signs in SIGNS.items()], F.when(lakhs, "INR"))
            monthly = F.exists(F.transform(said, lambda w, i: (w == "month") & (at(i - 1) == "per")), lambda y: F.coalesce(y, F.lit(False)))
            period = F.when((x["unit"] == "lpa") | has("annum", "year"), "year").when(monthly, "month").when(lakhs, "year")
            known = x["least"].isNotNull()
            return F.struct((x["least"] * factor).alias("least"), (x["most"] * factor).alias("most"), F.when(known, currency).alias("currency"), F.when(known, period).alias("period"))

        return let(_readings(said, amount), told)

    return let(words(source), read)


def years(text: Column) -> Column:
    """least and most years: a range, or a number with a plus or after `minimum`; freshers need none; a reversed range is turned."""

    def read(said: Column) -> Column:
        at = lambda i: F.get(said, i)
        told = lambda i: at(i).isin(list(YEARS))
        short = lambda i: F.when(F.char_length(at(i)) <= 2, _number(at(i)).cast("int"))

        def span(i: Column) -> Column:
            after = i + F.when(at(i + 3) == "+", 4).otherwise(3)
            most = F.when(at(i + 1).isin(list(DASHES)) & told(after), short(i + 2))
            plus = (at(i + 1) == "+") & told(i + 2)
            least = told(i + 1) & (at(i - 1).isin("minimum", "min") | ((at(i - 1) == "least") & (at(i - 2) == "at")))
            rank = F.when(most.isNotNull(), 0).when(plus, 1).when(least, 2)
            return F.struct(F.when(short(i).isNotNull(), rank).alias("rank"), i.alias("i"), short(i).alias("low"), most.alias("high"))

        def turned(x: Column) -> Column:
            low = F.coalesce(x["low"], F.when(F.exists(said, lambda w: F.contains(w, F.lit("fresher"))), 0))
            return F.struct(F.least(low, x["high"]).alias("least"), F.when(x["high"].isNotNull(), F.greatest(low, x["high"])).alias("most"))

        return let(_readings(said, span), turned)

    return let(words(text), read)
