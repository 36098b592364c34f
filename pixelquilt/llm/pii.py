"""Personal data: format-preserving pseudonyms from a keyed Feistel network.

Found values are validated and permuted within their format: a card number becomes another number of that length with
a right check digit, an address another address, a date another date of its century. The permutation is keyed and has
no state, so a value has one pseudonym in all documents, different values of a format keep different ones, and whoever
has the key can undo it. Everything is column expressions; documents do not move.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from pixelquilt.functions.binding import let, let_all
from pixelquilt.llm.common import fresh, table
from pixelquilt.llm.registry import query

#: The session's setting that holds the secret; whoever has it can turn pseudonyms back.
KEY_SETTING = "spark.pixelquilt.pseudonymKey"
ROUNDS = 8

EMAIL = r"(?<![A-Za-z0-9._%+-])[A-Za-z0-9._%+-]{1,64}+@(?:[A-Za-z0-9-]{1,63}\.){1,8}[A-Za-z]{2,24}"
ADDRESS = r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?![\d]|\.\d)"
CARD = r"(?<![\d-])(?:\d{13,19}|\d{4}([ -])\d{4}\1\d{4}\1\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})(?![\d-])"
PHONE = r"\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<![\d(])\(?\d{3}\)?[ .-]\d{3}[.-]\d{4}(?!\d)"
IDENTITY = r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])"
DATE = r"(?<![\d./-])(?:\d{4}-\d{2}-\d{2}|\d{2}([./])\d{2}\2\d{4})(?![\d]|[./-]\d)"
SECRET = r"(?<![A-Za-z0-9])AKIA[0-9A-Z]{16}(?![A-Za-z0-9])|(?<![0-9A-Za-z])(?:[0-9a-f]{64}|[0-9a-f]{40}|[0-9a-f]{32})(?![0-9A-Za-z])|(?<=password=)[^\s\"']{4,64}"
ANY = "|".join([EMAIL, ADDRESS, CARD, PHONE, IDENTITY, DATE, SECRET])

_drawn: dict[str, str] = {}


def session_key(spark: SparkSession) -> str:
    """The secret of the session's configuration. Where none is set, one is drawn for this application and told to
    nobody: its pseudonyms agree with each other, and cannot be undone later."""
    return spark.conf.get(KEY_SETTING, None) or _drawn.setdefault(spark.sparkContext.applicationId, secrets.token_hex(32))


_DIGITS, _LOWER, _UPPER, _HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789abcdef"


def feistel(values: Column, sizes: Column, label: Column, key: str, backwards: bool = False) -> Column:
    """Permute an array of ints, each below its entry in ``sizes``: the two halves are shifted in turn by a keyed
    digest of the other one."""
    half = F.floor(F.size(values) / 2).cast("int")

    def rounds(s: Column) -> Column:
        def shifted(own: Column, other: Column, own_sizes: Column, turn: Column) -> Column:
            seen = F.concat_ws(",", F.lit(key), s["label"], turn.cast("string"), F.array_join(other.cast("array<string>"), "."))

            def shift(digest: Column) -> Column:
                part = lambda i: F.conv(F.substring(F.sha2(F.concat(digest, i.cast("string")), 256), 1, 12), 16, 10).cast("bigint")
                step = (lambda x, i: x - part(i)) if backwards else (lambda x, i: x + part(i))
                return F.transform(own, lambda x, i: F.pmod(step(x.cast("bigint"), i), F.get(own_sizes, i)).cast("int"))

            return let(F.sha2(seen, 256), shift)

        def turn(state: Column, number: Column) -> Column:
            left, right = state["left"], state["right"]
            odd = number % 2 == 1
            return F.struct(
                F.when(odd, shifted(left, right, s["left_sizes"], number)).otherwise(left).alias("left"),
                F.when(odd, right).otherwise(shifted(right, left, s["right_sizes"], number)).alias("right"),
            )

        order = range(ROUNDS, 0, -1) if backwards else range(1, ROUNDS + 1)
        start = F.struct(s["left"].cast("array<int>").alias("left"), s["right"].cast("array<int>").alias("right"))
        return F.aggregate(F.array(*map(F.lit, order)), start, turn, lambda state: F.concat(state["left"], state["right"]))

    rest = F.size(values) - half
    halves = {"label": label, "left": F.slice(values, 1, half), "right": F.slice(values, half + 1, rest), "left_sizes": F.slice(sizes, 1, half), "right_sizes": F.slice(sizes, half + 1, rest)}
    return let_all(halves, rounds)


#: Digits, small letters, capitals: where each alphabet begins in the joined one. A hexadecimal value has its own.
_JOINED = _DIGITS + _LOWER + _UPPER

#: What a value is, by its shape; the first that fits.
_KINDS = [
    ("email", r"@"),
    ("address", r"^(?:\d{1,3}\.){3}\d{1,3}$"),
    ("date", r"^(?:\d{4}-\d{2}-\d{2}|\d{2}[./]\d{2}[./]\d{4})$"),
    ("card", r"^(?:\d{13,19}|\d{4}[ -]\d{4}[ -]\d{4}[ -]\d{1,7}|\d{4}[ -]\d{6}[ -]\d{5})$"),
    ("identity", r"^\d{3}-\d{2}-\d{4}$"),
    ("key", r"^AKIA[0-9A-Z]{16}$"),
    ("hex", r"^[0-9a-f]{18,64}$"),
    ("phone", r"^[\d+(][\d ().-]*$"),
]


def _luhn_sum(digits: Column) -> Column:
    """The sum of digits whose check digit is still to follow."""
    values = F.transform(F.filter(F.split(F.reverse(digits), ""), lambda x: x != ""), lambda x: x.cast("int"))
    added = F.transform(values, lambda v, i: F.when(i % 2 == 1, v).when(v > 4, 2 * v - 9).otherwise(2 * v))
    return F.aggregate(added, F.lit(0), lambda a, b: a + b)


def luhn_digit(digits: Column) -> Column:
    return ((10 - _luhn_sum(digits) % 10) % 10).cast("string")


def _kind(value: Column) -> Column:
    kind = F.lit("text")
    for name, shape in reversed(_KINDS):
        kind = F.when(value.rlike(shape), name).otherwise(kind)
    return kind


def _day(v: Column) -> Column:
    """``start, form, late, long, values, sizes`` of a value that has a date's shape, null where it is no date.

    A date without its year first is read day first, and month first where that is no date. So that a pseudonym is read
    the way it was written, days up to 12 and days over 12 are permuted apart, each among those of their century. Days
    up to 12 are 100 x 12 x 12; days over 12 are 22124, or 22125 where the century has a leap year more.
    """
    iso, number = v.rlike(r"^\d{4}-"), lambda at, n: F.substring(v, at, n).cast("int")
    swapped = ~iso & (number(4, 2) > 12)
    gap = F.substring(v, 3, 1)
    form = F.when(iso, "yyyy-MM-dd").when(swapped, F.concat(F.lit("MM"), gap, F.lit("dd"), gap, F.lit("yyyy"))).otherwise(F.concat(F.lit("dd"), gap, F.lit("MM"), gap, F.lit("yyyy")))
    y = F.when(iso, number(1, 4)).otherwise(number(7, 4))
    m = F.when(iso, number(6, 2)).when(swapped, number(1, 2)).otherwise(number(4, 2))
    d = F.when(iso, number(9, 2)).when(swapped, number(4, 2)).otherwise(number(1, 2))

    def checked(x: Column) -> Column:
        fine = x["y"].between(1000, 9899) & x["m"].between(1, 12) & (x["d"] >= 1)
        fine = F.when(fine, x["d"] <= F.dayofmonth(F.last_day(F.make_date(x["y"], x["m"], F.lit(1))))).otherwise(F.lit(False))
        first = (F.floor(x["y"] / 100) * 100).cast("int")
        century = F.make_date(first, F.lit(1), F.lit(1))
        after = F.make_date(first + 100, F.lit(1), F.lit(1))

        def grid(c: Column) -> Column:
            late, month = x["d"] > 12, (x["y"] % 100) * 12 + x["m"] - 1
            # Every month has twelve days up to 12.
            at = F.when(late, F.datediff(F.make_date(x["y"], x["m"], x["d"]), c["start"]) - 12 * (month + 1)).otherwise(month * 12 + x["d"] - 1)
            rows = F.when(~late, 120).when(c["long"], 125).otherwise(4)
            columns = F.when(~late, 120).when(c["long"], 177).otherwise(5531)
            return F.struct(
                c["start"].alias("start"), x["form"].alias("form"), late.alias("late"), F.array(F.floor(at / columns).cast("int"), (at % columns).cast("int")).alias("values"), F.array(rows, columns).alias("sizes")
            )

        return F.when(fine, let_all({"start": century, "long": F.datediff(after, century) == 36525}, grid))

    return let_all({"y": y, "m": m, "d": d, "form": form}, checked)


def _date_at(day: Column, at: Column) -> Column:
    """The date that stands at a place of its permutation: the way back from ``_day``."""
    first = F.year(day["start"])
    early = F.make_date((first + F.floor(at / 144)).cast("int"), (F.floor(at / 12) % 12 + 1).cast("int"), (at % 12 + 1).cast("int"))
    # A month has 18.4 days over 12 on average; the right month is the one that agrees with its own date.
    guess = F.floor(at * 1200 / 22124.5).cast("int")
    candidates = F.transform(F.sequence(guess - 2, guess + 2), lambda m: F.struct(m.alias("month"), F.date_add(day["start"], (at + 12 * (m + 1)).cast("int")).alias("date")))
    agreeing = F.filter(candidates, lambda c: ((F.year(c["date"]) - first) * 12 + F.month(c["date"]) - 1 == c["month"]) & (F.dayofmonth(c["date"]) > 12))
    return F.when(day["late"], F.get(agreeing, F.lit(0))["date"]).otherwise(early)


def pseudonym(value: Column, key: str, backwards: bool = False) -> Column:
    """The pseudonym of a found value, or with ``backwards`` the value of a pseudonym. What does not validate stays.

    Letters stay letters of their case, digits stay digits, other characters stay. An email keeps its domain, a phone
    number its country, an access key its prefix; a card's last digit follows from the others.
    """

    def cut(x: Column) -> Column:
        v, kind = x["v"], x["kind"]
        head = F.when(kind == "key", "AKIA").when(kind == "phone", F.regexp_extract(v, r"^(\+\d{1,3}(?=\D)|)", 1)).otherwise("")
        tail = F.when(kind == "email", F.regexp_extract(v, r"(@.*)$", 1)).when(kind == "card", F.substring(v, -1, 1)).otherwise("")
        return let_all({"v": v, "kind": kind, "head": head, "tail": tail}, body)

    def body(x: Column) -> Column:
        inner = F.substring(x["v"], F.length(x["head"]) + 1, F.length(x["v"]) - F.length(x["head"]) - F.length(x["tail"]))
        chars = F.filter(F.split(inner, ""), lambda c: c != "")
        return let_all({"x": x, "chars": chars, "day": F.when(x["kind"] == "date", _day(x["v"]))}, symbols)

    def symbols(s: Column) -> Column:
        """Every variable character as its place in an alphabet, the alphabet's size and where it begins."""
        hexadecimal = s["x"]["kind"] == "hex"
        at = F.transform(s["chars"], lambda c: (F.instr(F.when(hexadecimal, _HEX).otherwise(_JOINED), c) - 1).cast("int"))

        def coded(places: Column) -> Column:
            base = lambda a: F.when(hexadecimal | (a < 10), 0).when(a < 36, 10).otherwise(36)
            many = lambda a: F.when(hexadecimal, 16).when(a < 10, 10).otherwise(26)
            variable = F.filter(places, lambda a: a >= 0)
            octets = F.transform(F.split(s["x"]["v"], r"\."), lambda p: p.cast("int"))
            kind = s["x"]["kind"]
            parts = F.transform(F.split(s["x"]["v"], "-"), lambda p: p.cast("int") - 1)
            values = F.when(kind == "address", octets).when(kind == "identity", F.transform(parts, lambda p: F.greatest(p, F.lit(0)))).when(kind == "date", s["day"]["values"]).otherwise(F.transform(variable, lambda a: a - base(a)))
            sizes = F.when(kind == "address", F.array(*[F.lit(256)] * 4)).when(kind == "identity", F.array(*map(F.lit, (999, 99, 9999)))).when(kind == "date", s["day"]["sizes"]).otherwise(F.transform(variable, many))
            slots = F.filter(F.transform(places, lambda a, i: F.when(a >= 0, i).otherwise(-1)), lambda i: i >= 0)
            known = {"s": s, "bases": F.transform(variable, base), "slots": slots, "values": values.cast("array<int>"), "sizes": sizes.cast("array<int>")}
            return let_all(known, permuted)

        return let(at, coded)

    def permuted(k: Column) -> Column:
        label = k["s"]["x"]["kind"]
        return let_all({"k": k, "new": feistel(k["values"], k["sizes"], label, key, backwards)}, written)

    def written(w: Column) -> Column:
        k, s, x = w["k"], w["k"]["s"], w["k"]["s"]["x"]
        alphabet = F.when(x["kind"] == "hex", _HEX).otherwise(_JOINED)

        def one(char: Column, i: Column) -> Column:
            slot = (F.array_position(k["slots"], i) - 1).cast("int")
            return F.when(slot >= 0, F.substring(alphabet, F.get(w["new"], slot) + F.get(k["bases"], slot) + 1, F.lit(1))).otherwise(char)

        text = F.array_join(F.transform(s["chars"], one), "")
        digits = lambda t: F.regexp_replace(t, "[^0-9]", "")
        real_card = luhn_digit(digits(F.array_join(s["chars"], ""))) == x["tail"]
        day = let(F.get(w["new"], F.lit(0)) * F.get(k["sizes"], F.lit(1)) + F.get(w["new"], F.lit(1)), lambda at: _date_at(s["day"], at))
        real = ~x["v"].rlike("^000-|-00-|-0000$")
        part = lambda i, n: F.lpad((F.get(w["new"], F.lit(i)) + 1).cast("string"), n, "0")
        return (
            F.when(x["kind"] == "address", F.when(F.forall(k["values"], lambda p: p <= 255), F.array_join(w["new"].cast("array<string>"), ".")).otherwise(x["v"]))
            .when(x["kind"] == "identity", F.when(real, F.concat_ws("-", part(0, 3), part(1, 2), part(2, 4))).otherwise(x["v"]))
            .when(x["kind"] == "date", F.coalesce(F.call_function("date_format", day, s["day"]["form"]), x["v"]))
            .when(x["kind"] == "card", F.when(real_card, let(text, lambda t: F.concat(t, luhn_digit(digits(t))))).otherwise(x["v"]))
            .otherwise(F.concat(x["head"], text, x["tail"]))
        )

    return let_all({"v": value, "kind": _kind(value)}, cut)


def mask_text(text: Column, key: str) -> Column:
    """A whole text with its personal data replaced. Null stays null; a text without any stays as it is."""
    gaps = F.split(text, ANY, -1)
    found = F.regexp_extract_all(text, F.lit(ANY), F.lit(0))

    def joined(s: Column) -> Column:
        # Between two gaps lies one found value.
        pieces = F.transform(s["gaps"], lambda g, i: F.concat(g, F.when(i < F.size(s["found"]), pseudonym(F.get(s["found"], i), key)).otherwise("")))
        return F.array_join(pieces, "")

    # Most texts without personal data have no digit and no sign that every kind needs one of: a cheaper test first.
    return F.when(text.rlike(r"[0-9@]|password=") & text.rlike(ANY), let_all({"gaps": gaps, "found": found}, joined)).otherwise(text)


def pseudonymise(df: DataFrame, text: str = "text", key: str | None = None) -> DataFrame:
    """The same rows and columns, with ``text`` masked; the key is the session's where none is given.

    Null and empty texts stay; all other columns, whatever their names, are carried along; an empty table stays empty.
    Addresses with a part over 255, card numbers with a wrong check digit, identity numbers with a part of zeros and
    impossible dates are not touched.
    """
    return df.withColumn(text, mask_text(F.col(text), key or session_key(df.sparkSession)))


@query("op8_pseudonyms")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    masked = fresh(docs, "masked")
    found = docs.withColumn(masked, mask_text(F.col("text"), session_key(spark)))
    return found.select("doc_id", F.col(masked).alias("text"), F.coalesce(F.col(masked) != F.col("text"), F.lit(False)).alias("changed"))
