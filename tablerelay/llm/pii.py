"""Format-preserving pseudonyms for numbers, dates and addresses that prove valid.

A value is found by its shape and then checked: cards, also next to other numbers, by their last digit, dates by the
calendar, addresses by their octets, social security numbers by their ranges. Valid ones go
through a keyed Feistel network over just the valid values of their format, digits keeping
their places between the separators, so equal values stay equal in all documents, different
ones stay different, and whoever has the key can turn it back. Others stay as they are.

Built-in functions alone, over one scan; nothing is joined or shuffled.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tablerelay.llm.common import quoted
from tablerelay.llm.spans import let

#: Rounds of the network, even so that both halves go through as many.
ROUNDS = 10

#: Shapes, in the order in which they claim a place; none has a group that captures. Repeated
#: groups are possessive or have a limit, since others take stack for each round: a domain has
#: at most 127 labels, as in the name system.
_NOT_BEFORE, _NOT_AFTER = r"(?<![A-Za-z0-9])", r"(?![A-Za-z0-9])"
_PHONES = "|".join((
    r"\+1[ .-]?(?:\([0-9]{3}\)|[0-9]{3})[ .-]?[0-9]{3}[ .-]?[0-9]{4}(?![A-Za-z0-9])",
    r"\+[1-9](?:[ .-]?(?:\(0\)[ .-]?)?\(?(?!(?<![0-9])(?:[0-9]{4}[-/][0-9]{1,2}[-/]|[0-9]{1,2}[./][0-9]{1,2}[./]|[0-9]{3}-[0-9]{2}-))[0-9]\)?){7,14}(?![A-Za-z0-9])",
    r"(?:\+[0-9]{1,3}[ .-]?)?(?:\([0-9]{3}\)[ .-]?|[0-9]{3}[ .-])[0-9]{3}[ .-][0-9]{4}",
    r"(?:\([2-9][0-9]{2}\)[ .-]?|[2-9][0-9]{2}[ .-]?)[2-9][0-9]{6}",
))
SHAPES = {
    "email": r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]{0,63}+@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++){0,125}\.[A-Za-z]{2,}",
    "ip": rf"(?<![A-Za-z0-9.])[0-9]{{1,3}}(?:\.[0-9]{{1,3}}){{3}}(?![A-Za-z0-9]|\.[0-9])",
    "date": rf"{_NOT_BEFORE}(?:[0-9]{{4}}(?:-[0-9]{{1,2}}-|/[0-9]{{1,2}}/)[0-9]{{1,2}}|[0-9]{{1,2}}(?:\.[0-9]{{1,2}}\.|/[0-9]{{1,2}}/)[0-9]{{4}})(?![A-Za-z0-9&&[^Tt]]|[Tt](?![0-9]{{2}}))",
    "phone": rf"(?<![A-Za-z0-9+])(?:{_PHONES}){_NOT_AFTER}",
    "ssn": rf"{_NOT_BEFORE}[0-9]{{3}}-[0-9]{{2}}-[0-9]{{4}}{_NOT_AFTER}",
}
#: A whole run of digit groups, up to where another shape starts; the cards in it are told by their check digits.
_DIGITS = rf"[0-9]++{_NOT_AFTER}"
SHAPES["card"] = rf"{_NOT_BEFORE}(?=[0-9](?:[ -]?[0-9]){{12}}){_DIGITS}(?:[ -](?!{'|'.join(SHAPES.values())}){_DIGITS})*+"
ANY = "|".join(SHAPES.values())
#: Digits of a card, and the groups that cards are written in: these go before others that pass the check by chance.
CARD_DIGITS = (13, 19)
CARD_GROUPS = ("4-4-4-4", "4-6-5", "4-6-4", "4-4-4-4-3", *map(str, range(13, 20)))
#: Years of dates. A date stays among those whose month and day fit the same writing: one digit or
#: two, and days that can't be a month. These are the months and days of each; 29 February is its own.
YEARS = (1900, 200)
_MONTHS, _DAYS = ((1, 9), (10, 12)), ((1, 9), (10, 12), (13, 31))
DATES = [
    [f"{m:02}{d:02}" for m in range(m1, m2 + 1) for d in range(d1, min(d2, (31, 28, 31, 30, 31, 30, 31, 31, 30, 31, 30, 31)[m - 1]) + 1)]
    for m1, m2 in _MONTHS for d1, d2 in _DAYS
]
#: 29 Februaries from 1904 to 2096, as a product for the two halves.
LEAPS = (7, 7)
#: Phone numbers of ten digits: those whose area and exchange start with 2 to 9, and the others, as squares.
NUMBERED, OTHERS = 80_000, 60_000
#: Social security numbers: areas without 000, 666 and 900 to 999, groups from 01, serials from 0001.
SSN_AREAS, SSN_GROUPS, SSN_SERIALS = 898, 99, 9999


def feistel(left: Column, right: Column, left_size: Column, right_size: Column, key: str | Column, tweak: Column, back: bool = False) -> Column:
    """(left, right) permuted over ``left_size`` times ``right_size`` values."""

    def mixed(number: Column, round_: Column, size: Column) -> Column:
        digest = F.sha2(F.concat_ws("|", F.lit(key), tweak, round_.cast("string"), number.cast("string")), 256)
        return F.pmod(F.conv(F.substring(digest, 1, 15), 16, 10).cast("long"), size)

    sign = -1 if back else 1

    def step(state: Column, round_: Column) -> Column:
        even = F.struct(F.pmod(state["l"] + sign * mixed(state["r"], round_, left_size), left_size).alias("l"), state["r"].alias("r"))
        odd = F.struct(state["l"].alias("l"), F.pmod(state["r"] + sign * mixed(state["l"], round_, right_size), right_size).alias("r"))
        return F.when(round_ % 2 == 0, even).otherwise(odd)

    rounds = list(range(ROUNDS))[:: -1 if back else 1]
    start = F.struct(left.cast("long").alias("l"), right.cast("long").alias("r"))
    return F.aggregate(F.array(*map(F.lit, rounds)), start, step)


def permuted_digits(digits: Column, key: str, kind: str, back: bool = False) -> Column:
    """A string of 2 to 36 digits, permuted among the strings of its length."""
    n = F.length(digits)
    head = F.floor(n / 2).cast("int")
    size = lambda k: F.rpad(F.lit("1"), k + 1, "0").cast("long")
    left, right = F.substring(digits, F.lit(1), head).cast("long"), F.substring(digits, head + 1, n - head).cast("long")
    out = feistel(left, right, size(head), size(n - head), key, F.concat(F.lit(kind), n.cast("string")), back)
    return let(out, lambda x: F.concat(F.lpad(x["l"].cast("string"), head, "0"), F.lpad(x["r"].cast("string"), n - head, "0")))


def luhn_sum(digits: Column) -> Column:
    """Of digits whose check digit is last (or, with a zero there, still to be found)."""
    n = F.length(digits)
    each = F.transform(F.sequence(F.lit(1), n), lambda i: let(
        F.substring(digits, i, F.lit(1)).cast("int") * F.when((n - i) % 2 == 1, 2).otherwise(1), lambda d: F.when(d > 9, d - 9).otherwise(d)
    ))
    return F.aggregate(each, F.lit(0), lambda a, b: a + b)


def put_back(shape: Column, signs: Column, places: str = "[0-9]") -> Column:
    """``shape`` with its characters of ``places`` replaced by ``signs`` in order."""
    each = F.transform(F.sequence(F.lit(1), F.length(shape)), lambda i: F.substring(shape, i, F.lit(1)))
    start = F.struct(F.lit("").alias("out"), F.lit(1).alias("next"))

    def step(state: Column, c: Column) -> Column:
        new = F.struct(F.concat(state["out"], F.substring(signs, state["next"], F.lit(1))).alias("out"), (state["next"] + 1).alias("next"))
        return F.when(c.rlike(places), new).otherwise(F.struct(F.concat(state["out"], c).alias("out"), state["next"].alias("next")))

    return F.aggregate(each, start, step, lambda state: state["out"])


def _digits(value: Column) -> Column:
    return F.regexp_replace(value, "[^0-9]", "")


def card(value: Column, key: str, back: bool = False) -> Column:
    """All digits but the last permuted, and the last made to check; null if it doesn't now."""

    def of(digits: Column) -> Column:
        body = permuted_digits(F.substring(digits, F.lit(1), F.length(digits) - 1), key, "card", back)
        checked = let(F.concat(body, F.lit("0")), lambda x: F.concat(F.substring(x, F.lit(1), F.length(x) - 1), ((10 - luhn_sum(x) % 10) % 10).cast("string")))
        return F.when((luhn_sum(digits) % 10 == 0) & F.length(digits).between(*CARD_DIGITS), put_back(value, checked))

    return let(_digits(value), of)


def cards(value: Column, key: str, back: bool = False) -> Column:
    """``text`` and ``n``: a run of digit groups with the ``n`` cards in it permuted.

    A card is some groups in a row that pass the check. From left to right, groups as cards
    are written come first; other ones count where no such card starts inside, the longest first.
    """

    def of(groups: Column) -> Column:
        last = F.size(groups) - 1
        most = CARD_DIGITS[1] - 1

        def ends(i: Column) -> Column:
            def of_end(j: Column) -> Column:
                part = F.slice(groups, i + 1, j - i + 1)
                return F.struct(j.alias("end"), F.array_join(part, "").alias("digits"), F.array_join(F.transform(part, lambda g: F.length(g).cast("string")), "-").alias("way"))

            tried = F.filter(F.transform(F.sequence(i, F.least(i + most, last)), of_end), lambda x: F.length(x["digits"]).between(*CARD_DIGITS))
            valid = F.filter(tried, lambda x: luhn_sum(x["digits"]) % 10 == 0)
            return let(valid, lambda v: F.struct(F.get(F.filter(v, lambda x: x["way"].isin(*CARD_GROUPS)), F.lit(0))["end"].alias("usual"), F.array_max(F.transform(v, lambda x: x["end"])).alias("other")))

        def walked(found: Column, parts: Column) -> Column:
            def step(state: Column, i: Column) -> Column:
                here = F.element_at(found, i + 1)
                inside = F.exists(F.slice(found, i + 1, here["other"] - i + 1), lambda x: x["usual"].isNotNull())
                end = F.coalesce(here["usual"], F.when(here["other"].isNotNull() & ~inside, here["other"]))

                def taken(end: Column) -> Column:
                    text = F.array_join(F.slice(parts, i + 1, end - i + 1), "")
                    return F.struct((end + 1).alias("next"), F.concat(state["text"], card(text, key, back)).alias("text"), (state["n"] + 1).alias("n"))

                left = F.struct((i + 1).alias("next"), F.concat(state["text"], F.element_at(parts, i + 1)).alias("text"), state["n"].alias("n"))
                return F.when(i < state["next"], state).otherwise(let(end, lambda e: F.when(e.isNotNull(), taken(e)).otherwise(left)))

            start = F.struct(F.lit(0).alias("next"), F.lit("").alias("text"), F.lit(0).alias("n"))
            return F.aggregate(F.sequence(F.lit(0), last), start, step, lambda state: F.struct(state["text"].alias("text"), state["n"].alias("n")))

        found = F.transform(F.sequence(F.lit(0), last), ends)
        return let(found, lambda f: let(F.regexp_extract_all(value, F.lit("([0-9]+[ -]?)"), F.lit(1)), lambda parts: walked(f, parts)))

    return let(F.split(value, "[ -]", -1), of)


def phone(value: Column, key: str, back: bool = False) -> Column:
    """The last ten digits permuted; the country's stay. Of ten digits or fewer after a ``+``
    the first three stay."""
    def of(digits: Column) -> Column:
        n = F.when(value.startswith("+") & (F.length(digits) <= 10), F.length(digits) - 3).otherwise(10)
        kept = F.length(digits) - n
        last = F.substring(digits, kept + 1, n)
        tail = F.when(n == 10, _ten_digits(last, key, back)).otherwise(permuted_digits(last, key, "phone", back))
        return put_back(value, F.concat(F.substring(digits, F.lit(1), kept), tail))

    return let(_digits(value), of)


def _ten_digits(digits: Column, key: str, back: bool) -> Column:
    """Permuted among the numbers with, or without, 2 to 9 in the first and fourth place."""
    area, exchange, serial = (F.substring(digits, at, n).cast("long") for at, n in ((1, 3), (4, 3), (7, 4)))
    numbered = (area >= 200) & (exchange >= 200)
    index = F.when(numbered, ((area - 200) * 800 + exchange - 200) * 10_000 + serial).when(area < 200, digits.cast("long")).otherwise(2_000_000_000 + (area - 200) * 2_000_000 + exchange * 10_000 + serial)
    size = F.when(numbered, F.lit(NUMBERED)).otherwise(F.lit(OTHERS)).cast("long")

    def spelt(x: Column) -> Column:
        at = x["l"] * size + x["r"]
        own = (F.floor(at / 8_000_000) + 200) * 10_000_000 + (F.floor(at / 10_000) % 800 + 200) * 10_000 + at % 10_000
        rest = at - 2_000_000_000
        other = F.when(rest < 0, at).otherwise((F.floor(rest / 2_000_000) + 200) * 10_000_000 + rest % 2_000_000)
        return F.lpad(F.when(numbered, own).otherwise(other).cast("string"), 10, "0")

    return let(feistel(F.floor(index / size), index % size, size, size, key, F.concat(F.lit("phone"), size.cast("string")), back), spelt)


def ssn(value: Column, key: str, back: bool = False) -> Column:
    def of(digits: Column) -> Column:
        area, group, serial = (F.substring(digits, a, n).cast("int") for a, n in ((1, 3), (4, 2), (6, 4)))
        valid = area.between(1, 899) & (area != 666) & (group > 0) & (serial > 0)
        index = F.when(area > 666, area - 2).otherwise(area - 1)
        out = feistel(index * SSN_GROUPS + group - 1, serial - 1, F.lit(SSN_AREAS * SSN_GROUPS), F.lit(SSN_SERIALS), key, F.lit("ssn"), back)

        def spelt(x: Column) -> Column:
            at = F.floor(x["l"] / SSN_GROUPS)
            three = F.when(at >= 665, at + 2).otherwise(at + 1)
            return F.format_string("%03d-%02d-%04d", three, x["l"] % SSN_GROUPS + 1, x["r"] + 1)

        return F.when(valid, let(out, spelt))

    return let(_digits(value), of)


def ip(value: Column, key: str, back: bool = False) -> Column:
    """All four octets permuted as one number."""
    octets = F.transform(F.split(value, r"\.", -1), lambda x: x.cast("int"))

    def of(o: Column) -> Column:
        out = feistel(o[0] * 256 + o[1], o[2] * 256 + o[3], F.lit(65536), F.lit(65536), key, F.lit("ip"), back)
        spelt = lambda x: F.concat_ws(".", *(F.floor(x[h] / d) % 256 for h in "lr" for d in (256, 1)))
        return F.when(F.forall(o, lambda x: x <= 255), let(out, spelt))

    return let(octets, of)


def date(value: Column, key: str, back: bool = False) -> Column:
    """A day of 1900 to 2099 among those that the same writing fits, in the way of writing it had.

    With slashes and the year last the month is first, or the day where that gives no date.
    """

    def of(part: Column) -> Column:
        year_first, dotted = F.length(part[0]) == 4, value.contains(".")
        day_first = ~year_first & (dotted | ((part[0].cast("int") > 12) & (part[1].cast("int") <= 12)))
        year = F.when(year_first, part[0]).otherwise(part[2]).cast("int") - YEARS[0]
        month = F.when(year_first | day_first, part[1]).otherwise(part[0]).cast("int")
        day = F.when(year_first, part[2]).when(day_first, part[0]).otherwise(part[1]).cast("int")
        named = F.concat(F.lpad(month.cast("string"), 2, "0"), F.lpad(day.cast("string"), 2, "0"))
        kind = F.when(month <= _MONTHS[0][1], 1).otherwise(4) + F.when(day <= _DAYS[0][1], 0).when(day <= _DAYS[1][1], 1).otherwise(2)
        days = F.element_at(F.array(*(F.array(*map(F.lit, x)) for x in DATES)), kind)
        leap = (named == "0229") & (year % 4 == 0) & (year > 0)

        def moved(at: Column) -> Column:
            left, right = F.when(leap, F.floor((year / 4 - 1) / LEAPS[1])).otherwise(at - 1), F.when(leap, (year / 4 - 1).cast("long") % LEAPS[1]).otherwise(year)
            sizes = F.when(leap, LEAPS[0]).otherwise(F.size(days)), F.when(leap, LEAPS[1]).otherwise(YEARS[1])
            tweak = F.concat(F.lit("date"), F.when(leap, 0).otherwise(kind).cast("string"))
            return let(feistel(left, right, *(x.cast("long") for x in sizes), key, tweak, back), spelt)

        def spelt(x: Column) -> Column:
            new = F.when(leap, named).otherwise(F.element_at(days, (x["l"] + 1).cast("int")))
            y = (F.when(leap, (x["l"] * LEAPS[1] + x["r"] + 1) * 4).otherwise(x["r"]) + YEARS[0]).cast("string")
            m, d = (F.substring(new, k, 2).cast("int").cast("string") for k in (1, 3))
            wide = lambda sign, old: F.lpad(sign, F.length(old), "0")
            return put_back(value, F.when(year_first, F.concat(y, wide(m, part[1]), wide(d, part[2]))).when(day_first, F.concat(wide(d, part[0]), wide(m, part[1]), y)).otherwise(F.concat(wide(m, part[0]), wide(d, part[1]), y)))

        valid = year.between(0, YEARS[1] - 1) & month.between(1, 12) & day.between(1, 31)
        return F.when(valid, let(F.array_position(days, named), lambda at: F.when(leap | (at > 0), moved(at))))

    return let(F.split(value, "[-./]", -1), of)


def email(value: Column, key: str, back: bool = False) -> Column:
    """The letters and digits before the ``@`` permuted in groups of ten, each among the words
    of small letters and digits of its length; punctuation and the domain stay."""

    def of(parts: Column) -> Column:
        local = F.lower(parts[0])
        signs = F.regexp_replace(local, "[^0-9a-z]", "")

        def words(all_: Column) -> Column:
            groups = F.sequence(F.lit(0), F.floor((F.length(all_) - 1) / 10).cast("int"))
            return F.array_join(F.transform(groups, lambda g: _word(F.substring(all_, g * 10 + 1, F.lit(10)), key, g, back)), "")

        fill = let(words(signs), lambda new: put_back(local, new, "[0-9a-z]"))
        return F.concat(fill, F.lit("@"), parts[1])

    return let(F.split(value, "@", -1), of)


def _word(word: Column, key: str, place: Column, back: bool) -> Column:
    """A word of one to ten letters and digits, as two numbers of base 36."""
    n = F.length(word)
    head = F.floor(n / 2).cast("int")
    number = lambda a, k: F.when(k == 0, F.lit(0)).otherwise(F.conv(F.substring(word, a, k), 36, 10).cast("long"))
    size = lambda k: F.round(F.pow(F.lit(36), k)).cast("long")
    tweak = F.concat_ws("-", F.lit("email"), n, place)
    out = feistel(number(F.lit(1), head), number(head + 1, n - head), size(head), size(n - head), key, tweak, back)
    spell = lambda x, k: F.when(k == 0, "").otherwise(F.lpad(F.lower(F.conv(x.cast("string"), 10, 36)), k, "0"))
    return let(out, lambda x: F.concat(spell(x["l"], head), spell(x["r"], n - head)))


KINDS: dict[str, Callable[..., Column]] = {"email": email, "ip": ip, "date": date, "phone": phone, "ssn": ssn, "card": cards}


def pseudonym(value: Column, key: str, back: bool = False) -> Column:
    """(kind, text, n) of a value found by ANY; kind null and the value itself if nothing in it is valid."""
    tried = [F.when(value.rlike("^(?:" + SHAPES[kind] + ")$"), let(make(value, key, back), _named(kind))) for kind, make in KINDS.items()]
    return F.coalesce(*tried, F.struct(F.lit(None).cast("string").alias("kind"), value.alias("text"), F.lit(0).alias("n")))


def _named(kind: str) -> Callable[[Column], Column]:
    if kind == "card":
        return lambda new: F.when(new["n"] > 0, F.struct(F.lit(kind).alias("kind"), new["text"].alias("text"), new["n"].alias("n")))
    return lambda new: F.when(new.isNotNull(), F.struct(F.lit(kind).alias("kind"), new.alias("text"), F.lit(1).alias("n")))


def pseudonymised(docs: DataFrame, key: str, *, text: str = "text", back: bool = False) -> DataFrame:
    """``docs`` with every valid value in the texts replaced, and ``n_<kind>`` counts.

    ``back=True`` turns a text back, given that nothing else in it got the shape of a value.
    Null texts stay null and empty ones empty, with counts of zero; texts without a value are
    unchanged. Rows that repeat stay; existing columns named like a count are replaced.
    """
    # The key comes as a value of a table of one row, so that it stands in no plan or event log.
    held = docs.sparkSession.createDataFrame([(key,)], "key string").scalar()
    given, key = docs.withColumn("_pseudonym_key", held), F.col("_pseudonym_key")
    whole = F.col(quoted(text))
    parts = F.struct(F.split(whole, ANY, -1).alias("gap"), F.transform(F.regexp_extract_all(whole, F.lit(f"({ANY})"), F.lit(1)), lambda v: pseudonym(v, key, back)).alias("hit"))
    joined = lambda p: F.array_join(F.flatten(F.zip_with(p["gap"], p["hit"], lambda gap, hit: F.array(gap, F.coalesce(hit["text"], F.lit(""))))), "")
    count = lambda p, kind: F.aggregate(F.filter(p["hit"], lambda h: h["kind"] == kind), F.lit(0).cast("long"), lambda a, h: a + h["n"])
    made = let(parts, lambda p: F.struct(joined(p).alias("text"), *(count(p, k).alias(k) for k in KINDS)))
    none = F.struct(whole.alias("text"), *(F.lit(0).cast("long").alias(k) for k in KINDS))
    worth = whole.rlike("[0-9@]") & whole.rlike(ANY)
    out = given.withColumn("_made", F.when(worth, made).otherwise(none))
    return out.withColumns({text: F.col("_made.text"), **{f"n_{k}": F.col(f"_made.{k}") for k in KINDS}}).drop("_made", "_pseudonym_key")
