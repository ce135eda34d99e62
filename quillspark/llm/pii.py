"""Format-preserving pseudonyms for personal data, with Spark expressions only (operator 7).

One regular expression finds candidates for mail addresses, card, phone and social security
numbers, IBANs, IPv4 addresses and dates at every place of the text; each is validated (Luhn,
mod 97, numbering-plan and calendar rules), and what is no such value stays as it is.  Digits or
capitals behind a card or an IBAN are told from it at the borders of groups and are searched
on their own.  A valid value is written as
a list of digits in given bases, and a keyed Feistel network over the two halves of the list
permutes it within all lists of these bases.  Written back, it has the same length, signs
and separators and passes the same validation; check digits are computed anew.  The same
value under the same key always becomes the same pseudonym, in whatever document.

    value      digits that are permuted                              bases
    mail       letters and digits but for the last domain label      26 or 10
    card       all but the check digit                               10
    phone      ten digits of the national number                     8 for the 1st and 4th, else 10
               abroad: all digits behind the country code            9 for the 1st, else 10
    ssn        area, group, serial among the valid ones              898, 99, 9999
    iban       letters and digits behind the check digits            26 or 10
    ip         four numbers                                          256
    date       day number from 1900-01-01, of 73,049                 280, 261, walked on past 31 lists

Lists of the date's bases that are no day up to 2099-12-31 are permuted again until they are
one; a walk is at most 31 steps long, so it is a permutation of the days.

Defined results: a null text stays null and an empty one empty, both with no values; a null
doc_id stays null; repeated rows each give a row; other columns are ignored.  The work on a text
grows in proportion to it, whatever is in it: no repeat of the forms nests without a bound, and a
mail address of any length is read and written in one pass.  Its domain has at most 127 labels
before the last one (as in the domain name system); longer ones end there.

The key is a literal of the plan: whoever may read plans of the job may read it.  The query
takes it from the session's ``quillspark.pii.key`` where that is set.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

ROUNDS = 8
KINDS = ["mail", "card", "phone", "ssn", "iban", "ip", "date"]
DEFAULT_KEY = "quillspark-demo-key"  # production runs pass their own
#: Days from 1900-01-01 to 2099-12-31, and the bases that their numbers are permuted in.
DAYS = 73_049
DAY_BASES = (280, 261)

_OCTET = "(?:25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
# A label of a domain: possessive repeats of single characters' runs, which cost no stack.
_LABEL = "[A-Za-z0-9]++(?:-++[A-Za-z0-9]++)*+"
# Country codes of two digits; all others but 1 and 7 have three.
_CODE = "(?:7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[2-9][0-9]{2})"
_END = "(?![0-9A-Za-z])"
# The forms of the values.
FORMS = {
    "mail": rf"(?<![A-Za-z0-9._%+-])[A-Za-z0-9][A-Za-z0-9._%+-]*+@{_LABEL}(?:\.{_LABEL}){{0,126}}\.[A-Za-z]{{2,}}+",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "date": r"(?<![0-9A-Za-z/.-])(?:(?:19|20)[0-9]{2}-[01][0-9]-[0-3][0-9]|[0-3][0-9]([/.])[01][0-9]\1(?:19|20)[0-9]{2})(?![0-9A-Za-z]|[/.-][0-9])",
    "ssn": r"(?<![0-9A-Za-z-])[0-8][0-9]{2}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|-[0-9])",
    "ip": rf"(?<![0-9A-Za-z.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9A-Za-z]|\.[0-9])",
    # The North American plan; any other behind "+" and a country code; five pairs behind a 0 in France.
    "phone": r"(?:(?<![0-9A-Za-z+])(?:\+?1[ .-]?)?(?:\([2-9][0-9]{2}\) ?|[2-9][0-9]{2}[ .-])[2-9][0-9]{2}[ .-]?[0-9]{4}"
    rf"|(?<![0-9A-Za-z+])\+{_CODE}(?:[ .-]?\(0\))?(?:[ .-]?[0-9]){{7,11}}|(?<![0-9A-Za-z+.,-])0[1-9](?:[ .-][0-9]{{2}}){{4}}(?![ .-]?[0-9])){_END}",
    # A short last group that goes on behind a point or slash begins another value.
    "card": r"(?<![0-9A-Za-z])[0-9](?:[ -]?[0-9]){12,18}(?![0-9A-Za-z])(?!(?<=[ -][0-9]{1,3})[./][0-9])",
}
# Any form.  None begins behind a letter or digit, and most begin with a digit or a sign: that is looked at first.
_FORM = {k: f"(?:{p})".replace(r"\1", r"[/.]").replace("([/.])", "[/.]") for k, p in FORMS.items()}
_DIGITS = "|".join(p for k, p in _FORM.items() if k not in ("mail", "iban"))
_ANY = rf"(?<![A-Za-z0-9])(?=[A-Za-z0-9+(])(?:{_FORM['mail']}|(?=[A-Z]){_FORM['iban']}|(?=[0-9+(])(?:{_DIGITS}))"
#: One character, and from it on the longest text of the first form that is met there.
PATTERN = rf"(?=({_ANY}))[\s\S]"
#: Length of an IBAN in the countries of the registry.
IBAN_LENGTHS = (
    "AD24 AE23 AL28 AT20 AZ28 BA20 BE16 BG22 BH22 BR29 BY28 CH21 CR22 CY28 CZ24 DE22 DK18 DO28 EE20 EG29 ES24 FI18 FO18 FR27 GB22 GE22 GI23 GL18 GR27 GT28 HR21 HU28"
    " IE22 IL23 IQ23 IS26 IT27 JO30 KW30 KZ20 LB28 LC32 LI21 LT20 LU20 LV21 LY25 MC27 MD24 ME22 MK19 MR27 MT31 MU30 NL18 NO15 PK24 PL28 PS29 PT25 QA29 RO24 RS22 SA24"
    " SC31 SE24 SI19 SK24 SM27 ST25 SV28 TL23 TN24 TR26 UA29 VA22 VG24 XK20"
)
#: Elements in one part of the list that a scan builds.
PART = 512


def _chars(s: Column) -> Column:
    return F.filter(F.split(s, ""), lambda c: c != "")


def _base(c: Column) -> Column:
    return F.when(c.between("0", "9"), 10).when(c.between("a", "z") | c.between("A", "Z"), 26).otherwise(1)


def _zero(c: Column) -> Column:
    return F.when(c.between("0", "9"), 48).when(c.between("a", "z"), 97).when(c.between("A", "Z"), 65).otherwise(F.ascii(c))


def let(value: Column, then) -> Column:
    """``then(value)`` with the value computed once: lambdas are not planned as common expressions."""
    return F.get(F.transform(F.array(value), then), 0)


def feistel(values: Column, bases: Column, key: str, kind: str) -> Column:
    """``values`` (each below its base) permuted among all lists of these bases."""

    def moved(own: Column, base: Column, other: Column, size: Column, i: Column) -> Column:
        seed = F.concat_ws(",", F.lit(key), F.lit(kind), size.cast("string"), i.cast("string"), F.array_join(F.transform(other, lambda v: v.cast("string")), ","))
        # Six hexadecimal digits for each place; the digest is read again, shifted, behind nine places.
        word = lambda digest, k: F.conv(F.substring(digest, (k * 6) % 54 + 1 + F.floor(k / 9).cast("int") % 5, F.lit(6)), 16, 10).cast("int")
        # The bases are zipped to the values: in a lambda they would be sliced again for each place.
        pairs = F.zip_with(own, base, lambda v, b: F.struct(v.alias("v"), b.alias("b")))
        return let(F.sha2(seed, 256), lambda digest: F.transform(pairs, lambda p, k: F.pmod(p["v"] + word(digest, k), p["b"])))

    def network(s: Column) -> Column:
        size, half = s["size"], F.floor(s["size"] / 2).cast("int")
        left = lambda a: F.slice(a, F.lit(1), half)
        right = lambda a: F.slice(a, half + 1, size - half)
        start = F.struct(left(s["v"]).alias("l"), right(s["v"]).alias("r"))

        def turn(t: Column, i: Column) -> Column:
            return F.when(i % 2 == 0, F.struct(t["l"].alias("l"), moved(t["r"], right(s["b"]), t["l"], size, i).alias("r"))).otherwise(
                F.struct(moved(t["l"], left(s["b"]), t["r"], size, i).alias("l"), t["r"].alias("r"))
            )

        return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, turn, lambda t: F.concat(t["l"], t["r"]))

    return let(F.struct(values.alias("v"), bases.alias("b")), lambda s: let(F.struct(s["v"].alias("v"), s["b"].alias("b"), F.size(s["v"]).alias("size")), network))


def day_pseudonym(day: Column, key: str) -> Column:
    """A day number permuted among all ``DAYS``."""
    high, low = DAY_BASES

    def once(d: Column) -> Column:
        return let(feistel(F.array(F.floor(d / low).cast("int"), (d % low).cast("int")), F.array(F.lit(high), F.lit(low)), key, "date"), lambda v: F.get(v, 0) * low + F.get(v, 1))

    spare = high * low - DAYS
    walk = lambda d, k: F.when((k > 0) & (d < DAYS), d).otherwise(once(d))
    return F.get(F.aggregate(F.sequence(F.lit(0), F.lit(spare)), F.array(day, F.lit(0)), lambda a, k: F.array(walk(F.get(a, 0), F.get(a, 1)), F.get(a, 1) + 1)), 0)


def _text_feistel(s: Column, key: str, kind: str, fixed: tuple[Column, Column] | None = None) -> Column:
    """A string of letters and digits, each permuted within its own class (or with fixed bases and zeros)."""

    def run(chars: Column) -> Column:
        bases = fixed[0] if fixed else F.transform(chars, _base)
        zeros = fixed[1] if fixed else F.transform(chars, _zero)
        values = F.zip_with(chars, zeros, lambda c, z: F.ascii(c) - z)
        return F.array_join(F.zip_with(feistel(values, bases, key, kind), zeros, lambda v, z: F.chr((v + z).cast("long"))), "")

    return let(_chars(s), run)


def _refill(pattern: Column, new: Column, kept: str = "[^A-Za-z0-9]") -> Column:
    """``pattern`` with its letters and digits replaced, one after another, by those of ``new``."""

    def run(told: Column) -> Column:
        place = lambda k: F.length(F.regexp_replace(F.substring(pattern, F.lit(1), k + 1), kept, ""))
        return F.array_join(F.transform(_chars(pattern), lambda c, k: F.when(c.rlike(kept), c).otherwise(F.substring(told, place(k), F.lit(1)))), "")

    return let(new, run)


def _digits(s: Column) -> Column:
    return F.regexp_replace(s, "[^0-9]", "")


def _luhn(s: Column) -> Column:
    """Weighted digit sum of a number with its check digit."""
    n = F.reverse(_chars(s))
    each = F.transform(n, lambda c, k: F.when(k % 2 == 0, c.cast("int")).otherwise(c.cast("int") * 2 - F.when(c.cast("int") > 4, 9).otherwise(0)))
    return F.aggregate(each, F.lit(0), lambda a, b: a + b)


def _mod97(s: Column) -> Column:
    def add(a: Column, c: Column) -> Column:
        return F.when(c.between("0", "9"), (a * 10 + F.ascii(c) - 48) % 97).otherwise((a * 100 + F.ascii(c) - 55) % 97)

    return F.aggregate(_chars(s), F.lit(0), add)


def _day(m: Column) -> Column:
    iso = m.rlike("^[0-9]{4}")
    plain = F.when(iso, m).otherwise(F.concat(F.substring(m, 7, 4), F.lit("-"), F.substring(m, 4, 2), F.lit("-"), F.substring(m, 1, 2)))
    return F.datediff(F.try_to_date(plain, "yyyy-MM-dd"), F.lit("1900-01-01").cast("date"))


def kind_of(m: Column) -> Column:
    """The kind of a candidate that is valid; '' for any other."""
    whole = lambda k: m.rlike("^(?:" + FORMS[k] + ")$")
    bare = F.replace(m, F.lit(" "), F.lit(""))
    area = F.substring(m, 1, 3)
    return (
        F.when(F.contains(m, F.lit("@")), "mail")
        .when(whole("iban"), F.when(_mod97(F.concat(F.substring(bare, F.lit(5), F.length(bare)), F.substring(bare, 1, 4))) == 1, "iban").otherwise(""))
        .when(whole("date"), F.when(_day(m).isNotNull(), "date").otherwise(""))
        .when(whole("ssn"), F.when((area == "000") | (area == "666") | (F.substring(m, 5, 2) == "00") | (F.substring(m, 8, 4) == "0000"), "").otherwise("ssn"))
        .when(whole("ip"), "ip")
        .when(whole("phone"), "phone")
        .otherwise(F.when(_luhn(_digits(m)) % 10 == 0, "card").otherwise(""))
    )


def _prefixes(m: Column) -> Column:
    """The beginnings of a candidate that end where one of its groups does, shortest first."""
    parts = lambda p: F.transform(p, lambda _, k: F.left(m, F.length(F.array_join(F.slice(p, F.lit(1), k + 1), "-"))))
    return let(F.split(m, "[ -]"), parts)


def value_at(m: Column) -> Column:
    """(sure, loose): the value that begins a candidate, and what is one only if the candidate is taken whole.

    Other digits or capitals may follow a card or an IBAN.  A card is the shortest valid
    beginning whose groups, but for the last, have four digits at least; an IBAN is the valid
    one of its country's length, or else the longest.  Cards in other groups are valid only as a whole.
    """
    none = F.struct(F.lit("").alias("text"), F.lit("").alias("kind"))
    text = lambda t, kind: F.struct(t.alias("text"), F.lit(kind).alias("kind"))
    bare = lambda p: F.replace(p, F.lit(" "), F.lit(""))
    of_land = lambda p: F.contains(F.lit(IBAN_LENGTHS), F.concat(F.left(p, F.lit(2)), F.length(bare(p)).cast("string")))
    ibans = F.filter(_prefixes(m), lambda p: p.rlike("^(?:" + FORMS["iban"] + ")$") & (kind_of(p) == "iban"))
    iban = let(ibans, lambda a: F.coalesce(F.get(F.filter(a, of_land), 0), F.get(F.reverse(a), 0)))
    cards = F.filter(_prefixes(m), lambda p: p.rlike("^(?:[0-9]{4,}[ -])*[0-9]+$") & F.length(_digits(p)).between(13, 19) & (_luhn(_digits(p)) % 10 == 0))
    card = F.get(cards, 0)

    def told(kind: Column) -> Column:
        first = F.when(m.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9 ]*$"), let(iban, lambda p: F.when(p.isNull(), none).otherwise(text(p, "iban"))))
        first = first.when(m.rlike("^[0-9][0-9 -]*$") & kind.isin("", "card"), let(card, lambda p: F.when(p.isNull(), none).otherwise(text(p, "card"))))
        first = first.otherwise(F.struct(F.when(kind != "", m).otherwise("").alias("text"), kind.alias("kind")))
        return F.struct(first.alias("sure"), (kind == "card").alias("loose"))

    return let(kind_of(m), told)


def scan(text: Column) -> Column:
    """(head, elements): the text before the first candidate, and for each candidate's beginning the
    value that is taken there ('' for none), its kind, and the text up to the next beginning without
    what a value covers.  Left to right, no two values overlap, and what no value covers is tried again.
    """
    starts = F.regexp_extract_all(text, F.lit(PATTERN), F.lit(1))

    def cut(s: Column) -> Column:
        gaps = s["gaps"]
        parts = F.zip_with(s["starts"], F.slice(gaps, F.lit(2), F.size(s["starts"])), lambda m, g: F.struct(m.alias("m"), F.concat(F.left(m, F.lit(1)), g).alias("rest"), value_at(m).alias("value")))
        item = "struct<text:string,kind:string,rest:string>"
        none = F.struct(F.lit("").alias("text"), F.lit("").alias("kind"))

        def step(a: Column, x: Column) -> Column:
            sure, whole = x["value"]["sure"], x["value"]["loose"] & (a["tried"] <= 0)
            # A part of a value that was taken is no value, and a whole that failed is tried again only in groups.
            taken = F.when(a["covered"] > 0, none).when(sure["kind"] != "", sure).when(whole, F.struct(x["m"].alias("text"), F.lit("card").alias("kind"))).otherwise(none)

            def go_on(v: Column) -> Column:
                size = F.length(x["rest"])
                covered = F.when(v["kind"] != "", F.length(v["text"])).otherwise(a["covered"])
                tried = F.when(v["kind"] != "", 0).when((a["covered"] <= 0) & (a["tried"] <= 0), F.length(x["m"])).otherwise(a["tried"])
                one = F.struct(v["text"].alias("text"), v["kind"].alias("kind"), F.substring(x["rest"], covered + 1, size).alias("rest"))
                return F.struct(F.greatest(F.lit(0), covered - size).alias("covered"), F.greatest(F.lit(0), tried - size).alias("tried"), F.concat(a["part"], F.array(one)).alias("part"))

            return let(taken, go_on)

        # A step copies what was gathered so far, so PART elements are gathered apart and then set aside.
        def run(all_: Column) -> Column:
            begin = F.struct(F.lit(0).alias("covered"), F.lit(0).alias("tried"), F.array().cast(f"array<array<{item}>>").alias("parts"))
            empty = F.array().cast(f"array<{item}>")

            def next_part(a: Column, i: Column) -> Column:
                state = F.struct(a["covered"].alias("covered"), a["tried"].alias("tried"), empty.alias("part"))
                done = F.aggregate(F.slice(all_, i * PART + 1, F.lit(PART)), state, step)
                return let(done, lambda r: F.struct(r["covered"].alias("covered"), r["tried"].alias("tried"), F.concat(a["parts"], F.array(r["part"])).alias("parts")))

            return F.aggregate(F.sequence(F.lit(0), F.floor(F.size(all_) / PART).cast("int")), begin, next_part, lambda a: F.flatten(a["parts"]))

        return F.struct(F.get(gaps, 0).alias("head"), let(parts, run).alias("elements"))

    return let(F.struct(starts.alias("starts"), F.split(text, PATTERN, -1).alias("gaps")), cut)


def pseudonym(m: Column, kind: Column, key: str) -> Column:
    # An address keeps its signs: they are places of base 1.
    tail = F.substring_index(m, ".", -1)
    mail = F.concat(_text_feistel(F.left(m, F.length(m) - F.length(tail)), key, "mail"), tail)

    number = _digits(m)
    checked = lambda body: F.concat(body, F.pmod(-_luhn(F.concat(body, F.lit("0"))), F.lit(10)).cast("string"))
    card = _refill(m, let(_text_feistel(F.left(number, F.length(number) - 1), key, "card"), checked))

    lead = F.when(F.length(number) == 11, F.regexp_extract(m, r"^\+?1", 0)).otherwise("")
    local = F.substring(m, F.length(lead) + 1, F.length(m))
    ten = F.right(number, F.lit(10))
    eight = lambda a, b: F.transform(F.sequence(F.lit(0), F.lit(9)), lambda k: F.when(k.isin(0, 3), a).otherwise(b))
    american = F.concat(lead, _refill(local, _text_feistel(ten, key, "phone", (eight(8, 10), eight(50, 48)))))
    # Elsewhere the code (and a zero in brackets) or the leading zero stays, and the next digit is no zero.
    code = F.regexp_extract(m, rf"^(?:\+{_CODE}(?:[ .-]?\(0\))?|0)[ .-]?", 0)
    abroad = F.substring(m, F.length(code) + 1, F.length(m))
    nine = lambda a, b: let(F.size(F.split(_digits(abroad), "")), lambda n: F.transform(F.sequence(F.lit(1), n), lambda k: F.when(k == 1, a).otherwise(b)))
    # A first digit of 0 is kept: it has base 1.
    zero_first = F.substring(_digits(abroad), 1, 1) == "0"
    away = F.concat(code, _refill(abroad, _text_feistel(_digits(abroad), key, "phone-abroad", (nine(F.when(zero_first, 1).otherwise(9), 10), nine(F.when(zero_first, 48).otherwise(49), 48)))))
    phone = F.when(m.rlike(rf"^(?:\+(?!1)|0)"), away).otherwise(american)

    area = F.substring(m, 1, 3).cast("int")
    ssn_in = F.array(area - 1 - F.when(area > 666, 1).otherwise(0), F.substring(m, 5, 2).cast("int") - 1, F.substring(m, 8, 4).cast("int") - 1)
    ssn_out = lambda s: F.format_string("%03d-%02d-%04d", F.get(s, 0) + 1 + F.when(F.get(s, 0) >= 665, 1).otherwise(0), F.get(s, 1) + 1, F.get(s, 2) + 1)
    ssn = let(feistel(ssn_in, F.array(F.lit(898), F.lit(99), F.lit(9999)), key, "ssn"), ssn_out)

    bare = F.replace(m, F.lit(" "), F.lit(""))
    land = F.left(m, F.lit(2))
    with_check = lambda inner: F.concat(land, F.lpad((98 - _mod97(F.concat(inner, land, F.lit("00")))).cast("string"), 2, "0"), inner)
    iban = _refill(m, let(_text_feistel(F.substring(bare, F.lit(5), F.length(bare)), key, "iban"), with_check))

    ip = F.array_join(F.transform(feistel(F.transform(F.split(m, r"\."), lambda x: x.cast("int")), F.array(*[F.lit(256)] * 4), key, "ip"), lambda v: v.cast("string")), ".")

    sign = F.substring(m, 3, 1)
    date = let(day_pseudonym(_day(m), key), lambda d: F.date_add(F.lit("1900-01-01").cast("date"), d))
    day = F.when(m.rlike("^[0-9]{4}"), F.date_format(date, "yyyy-MM-dd")).otherwise(F.concat(F.date_format(date, "dd"), sign, F.date_format(date, "MM"), sign, F.date_format(date, "yyyy")))

    by = {"mail": mail, "card": card, "phone": phone, "ssn": ssn, "iban": iban, "ip": ip, "date": day}
    out = F.when(kind == "mail", by["mail"])
    for k in KINDS[1:]:
        out = out.when(kind == k, by[k])
    return out.otherwise(m)


def pseudonymise(docs: DataFrame, key: str = DEFAULT_KEY) -> DataFrame:
    """doc_id, the new text, and how many values of each kind were replaced."""
    df = docs.select("doc_id", "text")
    df = df.withColumn("_scan", F.when(F.col("text").rlike(_ANY), scan(F.col("text"))))
    pieces = F.transform("_scan.elements", lambda e: F.concat(pseudonym(e["text"], e["kind"], key), e["rest"]))
    many = lambda kind: F.coalesce(F.size(F.filter("_scan.elements", lambda e: e["kind"] == kind)), F.lit(0))
    counts = [many(kind).cast("long").alias(f"n_{kind}") for kind in KINDS]
    any_ = F.exists("_scan.elements", lambda e: e["kind"] != "")
    return df.select("doc_id", F.when(any_, F.concat("_scan.head", F.array_join(pieces, ""))).otherwise(F.col("text")).alias("text"), *counts)
