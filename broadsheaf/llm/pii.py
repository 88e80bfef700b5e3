"""Format-preserving pseudonyms by a keyed Feistel permutation, in DataFrame functions only.

Found values keep their format: separators, length, character classes, checksums and calendars stay valid. The
characters of a value are read as one whole number below the size of its domain, which a Feistel network of eight
rounds (keyed by SHA-256) permutes; results outside the domain walk on through the permutation. Names in addresses
and secrets go through an unbalanced network of two passes, character by character within each class. A permutation is one-to-one, so equal values get equal pseudonyms in every
document and different values get different ones.

What is found, in this order where several would match at one place:

==========  =====================================================  ==========================================
kind        validated by                                           kept
==========  =====================================================  ==========================================
email       shape                                                  lengths, separators, top-level domain
secret      shape: password= / token = "..." / AKIA...             prefix, alphabet and case
iban        two letters, check digits mod 97                       country; check digits are made valid again
card        13-19 digits, Luhn                                     separators; last digit is made valid again
ipv4        four numbers up to 255                                 a valid address of numbers without leading 0
ssn         ddd-dd-dddd, not 000/666/9xx, 00 or 0000               separators
phone       + and country code, or (ddd) ddd-dddd, ddd-ddd-dddd    country code, separators
date        yyyy-mm-dd, yyyy/mm/dd, dd.mm.yyyy, mm/dd/yyyy, valid  separators; a valid day of 1900-2099
==========  =====================================================  ==========================================

Defined cases: null texts stay null, empty ones empty; texts without a find are unchanged, byte for byte;
repeated rows give repeated results; an empty table an empty one; other columns are passed through by
``pseudonymise`` unless they are named like ``out_col`` or ``found_col``, which replace them. A card or IBAN beside other numbers
or words is found by its groups, the longest run that passes first; by chance (one in ten) a card is taken together with a short
number next to it. ``back`` holds for a value alone.
"""

from __future__ import annotations

import secrets

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

ROUNDS = 8
#: The setting that holds the key. The key must not be public: the permutation can be turned back with it.
KEY_SETTING = "spark.broadsheaf.pseudonym.key"
#: Private-use characters that no find holds: the first marks finds while a text is taken apart, the third tells their kind, the second escapes all.
OPEN, SHUT, NEXT = "\ue000", "\ue001", "\ue002"

EMAIL = r"(?<![A-Za-z0-9À-ɏ._%+-])[A-Za-z0-9À-ɏ][A-Za-z0-9À-ɏ._%+-]*+@(?:[A-Za-z0-9-]+\.)+[A-Za-z]{2,}"
SECRET = r"(?:(?i:password|passwd|pwd|secret|token|api_?key|access_?key)\s?[=:]\s?[\"']?[A-Za-z0-9+/_-]{12,}|(?<![A-Za-z0-9])AKIA[A-Z0-9]{16}(?![A-Za-z0-9])|(?<![A-Za-z0-9])[0-9a-f]{40}(?![A-Za-z0-9])|(?<![A-Za-z0-9])[0-9A-F]{40}(?![A-Za-z0-9]))"
IBAN = r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:[ ]?[A-Z0-9]{4}){2,7}(?:[ ]?[A-Z0-9]{1,3})?(?![A-Za-z0-9])"
CARD = r"(?<![0-9A-Za-z+.-])(?=[0-9](?:[ -]?[0-9]){12})(?:[0-9]++(?![A-Za-z]|\.[0-9]))(?:[ -][0-9]++(?![A-Za-z]|\.[0-9]))*+"
IPV4 = r"(?<![0-9A-Za-z.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9A-Za-z]|\.[0-9])"
SSN = r"(?<![0-9A-Za-z.+-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9A-Za-z]|[.-][0-9])"
PHONE = r"(?:\+[0-9]{1,3}[ .-]?(?:\([0-9]{1,4}\)[ .-]?)?[0-9]{2,4}(?:[ .-]?[0-9]{2,4}){1,3}|(?<![0-9A-Za-z(+.-])(?:\([0-9]{3}\)[ ]?|[0-9]{3}[-.])[0-9]{3}[-.][0-9]{4})(?![0-9A-Za-z]|[.-][0-9])"
DATE = r"(?<![0-9A-Za-z./-])(?:[0-9]{4}-[0-9]{2}-[0-9]{2}|[0-9]{4}/[0-9]{2}/[0-9]{2}|[0-9]{2}\.[0-9]{2}\.[0-9]{4}|[0-9]{2}/[0-9]{2}/[0-9]{4})(?![0-9A-Za-z]|[./-][0-9])"
KINDS = {"email": EMAIL, "secret": SECRET, "iban": IBAN, "date": DATE, "ssn": SSN, "ipv4": IPV4, "phone": PHONE, "card": CARD}
#: No find is possible in a text without a match of this; it keeps the costly patterns off most texts.
HINT = r"@|[0-9](?:[ .()/-]?[0-9]){5}|AKIA|[=:]\s?[\"']?[A-Za-z0-9+/_-]{12}|[0-9a-fA-F]{40}|[0-9]{1,3}\.[0-9]{1,3}\.[0-9]"


def feistel_digits(digits: Column, key: Column, back: bool = False) -> Column:
    """A keyed permutation of the strings of as many decimal digits (up to 36): halves are added to in turns.

    A string of one digit is shifted by a keyed number. Works on halves of up to 18 digits, each in two numbers.
    """
    n = F.length(digits)
    left_n = F.floor(n / 2).cast("int")

    # a lambda binds each round's halves once, so that the expression does not double from round to round
    state = F.array(F.substring(digits, F.lit(1), left_n), F.substring(digits, left_n + 1, n - left_n))
    rounds = F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)) if back else F.sequence(F.lit(0), F.lit(ROUNDS - 1))

    def step(s: Column, r: Column) -> Column:
        even = F.pmod(r, F.lit(2)) == 0
        key_r = F.concat_ws("#", key, r.cast("string"))
        half, by = F.when(even, s[0]).otherwise(s[1]), F.when(even, s[1]).otherwise(s[0])
        low_n = F.least(F.length(half), F.lit(9))
        high_n = F.length(half) - low_n
        out = []
        for part, size, tag in ((F.substring(half, F.lit(1), high_n), high_n, "a"), (F.substring(half, high_n + 1, low_n), low_n, "b")):
            mod = F.pow(F.lit(10.0), size).cast("long")
            digest = F.substring(F.sha2(F.concat_ws("|", key_r, F.lit(tag), by), 256), 50, 15)
            keyed = F.pmod(F.conv(digest, 16, 10).cast("long"), mod)
            value = F.pmod(F.coalesce(part.try_cast("long"), F.lit(0)) + (-keyed if back else keyed), mod)
            out.append(F.when(size > 0, F.lpad(value.cast("string"), size, "0")).otherwise(F.lit("")))
        new = F.concat(*out)
        return F.when(even, F.array(new, s[1])).otherwise(F.array(s[0], new))

    return F.aggregate(rounds, state, step, lambda s: F.concat(s[0], s[1]))


def feistel_below(value: Column, size: int, key: Column, back: bool = False) -> Column:
    """A keyed permutation of the whole numbers below ``size`` (a literal): a Feistel network on the smallest square
    that holds them, and a walk through it until the number is below ``size`` again.

    The walk takes at most 64 steps and ends at the first hit. The sizes used here fill at least 99 % of their squares,
    so a walk of 64 steps without a hit has a chance of 1e-128.
    """
    side = int(size**0.5)
    while side * side < size:
        side += 1
    rounds = F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)) if back else F.sequence(F.lit(0), F.lit(ROUNDS - 1))

    def once(v: Column) -> Column:
        def step(s: Column, r: Column) -> Column:
            even = F.pmod(r, F.lit(2)) == 0
            half, by = F.when(even, s[0]).otherwise(s[1]), F.when(even, s[1]).otherwise(s[0])
            digest = F.substring(F.sha2(F.concat_ws("|", key, r.cast("string"), by.cast("string")), 256), 50, 15)
            keyed = F.pmod(F.conv(digest, 16, 10).cast("long"), F.lit(side))
            new = F.pmod(half + (-keyed if back else keyed), F.lit(side))
            return F.when(even, F.array(new, s[1])).otherwise(F.array(s[0], new))

        start = F.array(F.floor(v / side).cast("long"), F.pmod(v, F.lit(side)).cast("long"))
        return F.aggregate(rounds, start, step, lambda s: s[0] * side + s[1])

    walk = F.aggregate(
        F.sequence(F.lit(1), F.lit(64)),
        F.struct(value.cast("long").alias("v"), F.lit(False).alias("ok")),
        lambda s, _: F.when(s["ok"], s).otherwise(F.transform(F.array(once(s["v"])), lambda v: F.struct(v.alias("v"), (v < size).alias("ok")))[0]),
    )
    return F.when(walk["ok"], walk["v"]).otherwise(value.cast("long"))


def _refill(shape: Column, chars: Column, what: str) -> Column:
    """``shape`` with its characters of the class ``what`` replaced by ``chars`` in order."""
    marks = F.split(F.regexp_replace(shape, f"({what})", OPEN), OPEN, -1)
    return F.concat(F.element_at(marks, 1), F.concat_ws("", F.transform(F.sequence(F.lit(1), F.length(chars)), lambda i: F.concat(F.substring(chars, i, F.lit(1)), F.get(marks, i)))))


def luhn_sum(digits: Column, skip: int = 0) -> Column:
    """The weighted digit sum; with ``skip`` 1, of a number that lacks its last digit."""
    n = F.length(digits)

    def weighted(i: Column) -> Column:
        d = F.substring(digits, n - i, F.lit(1)).cast("int")
        return F.when(F.pmod(i + skip, F.lit(2)) == 1, F.when(d > 4, 2 * d - 9).otherwise(2 * d)).otherwise(d)

    return F.aggregate(F.transform(F.sequence(F.lit(0), n - 1), weighted), F.lit(0), lambda a, x: a + x)


def luhn_ok(digits: Column) -> Column:
    return F.pmod(luhn_sum(digits), F.lit(10)) == 0


def _bound(value: Column, use) -> Column:
    """``use(value)`` with the value computed once: a lambda's variable is not evaluated again at each use."""
    return F.transform(F.array(value), use)[0]


def _card(v: Column, key: Column, back: bool) -> Column:
    """A run of digit groups: from each group on, the longest run of groups with 13 to 19 digits that passes is a card."""
    k = F.concat(key, F.lit(":card"))

    def longest(groups: Column, i: Column) -> Column:
        """Groups of the longest card from group i on, 0 if none."""
        some = F.transform(F.sequence(F.least(F.size(groups) - i, F.lit(19)), F.lit(1), F.lit(-1)), lambda m: F.struct(m.alias("m"), F.array_join(F.slice(groups, i + 1, m), "").alias("d")))
        # columns of small numbers are no cards: groups have three digits or more, or the run is one number in all
        shaped = lambda m: (m == F.size(groups)) | F.forall(F.slice(groups, i + 1, m), lambda x: F.length(x) >= 3)
        return F.coalesce(F.get(F.filter(some, lambda x: F.length(x["d"]).between(13, 19) & x["d"].rlike("^[0-9]+$") & shaped(x["m"]) & luhn_ok(x["d"])), F.lit(0))["m"], F.lit(0))

    def card(digits: Column, shape: Column) -> Column:
        body = feistel_digits(F.substring(digits, F.lit(1), F.length(digits) - 1), k, back)
        return _bound(body, lambda x: _refill(shape, F.concat(x, F.pmod(10 - F.pmod(luhn_sum(x, 1), F.lit(10)), F.lit(10)).cast("string")), "[0-9]"))

    def whole(g: Column) -> Column:
        found = F.filter(F.transform(F.sequence(F.lit(0), F.size(g["groups"]) - 1), lambda i: F.struct(i.alias("i"), longest(g["groups"], i).alias("m"))), lambda x: x["m"] > 0)

        def step(s: Column, x: Column) -> Column:
            before = F.array_join(F.slice(g["pieces"], s["next"] + 1, x["i"] - s["next"]), "")
            made = card(F.array_join(F.slice(g["groups"], x["i"] + 1, x["m"]), ""), F.array_join(F.slice(g["pieces"], x["i"] + 1, x["m"]), ""))
            return F.when(s["next"] > x["i"], s).otherwise(F.struct(F.concat(s["out"], before, made).alias("out"), (x["i"] + x["m"]).alias("next")))

        return F.aggregate(found, F.struct(F.lit("").alias("out"), F.lit(0).alias("next")), step, lambda s: F.concat(s["out"], F.array_join(F.slice(g["pieces"], s["next"] + 1, F.size(g["pieces"])), "")))

    # the groups, and each with the separator before it
    return _bound(F.struct(F.split(v, "[ -]").alias("groups"), F.split(F.regexp_replace(v, "([ -])", f"{OPEN}$1"), OPEN, -1).alias("pieces")), whole)


def mod97(s: Column) -> Column:
    """Remainder of an IBAN-like string (letters count 10 to 35) by 97."""
    low = F.split(s, "")
    return F.aggregate(F.filter(low, lambda c: c != ""), F.lit(0), lambda a, c: F.pmod(F.when(c >= "A", a * 100 + (F.ascii(c) - 55)).otherwise(a * 10 + (F.ascii(c) - 48)), F.lit(97)))


def _iban(v: Column, key: Column, back: bool) -> Column:
    """The longest run of groups from the start that passes; digit groups after it may hold a card."""

    def checked(flat: Column) -> Column:
        body = F.substring(flat, F.lit(5), F.length(flat) - 4)
        return F.length(body).between(11, 30) & (mod97(F.concat(body, F.substring(flat, 1, 4))) == 1)

    def written(part: Column) -> Column:
        flat = F.replace(part, F.lit(" "), F.lit(""))
        land, body = F.substring(flat, 1, 2), F.substring(flat, F.lit(5), F.length(flat) - 4)
        new = _refill(body, feistel_digits(F.regexp_replace(body, "[^0-9]", ""), F.concat(key, F.lit(":iban"), land, F.regexp_replace(body, "[0-9]", "0")), back), "[0-9]")
        return _bound(new, lambda x: _refill(part, F.concat(land, F.lpad((98 - mod97(F.concat(x, land, F.lit("00")))).cast("string"), 2, "0"), x), "[A-Z0-9]"))

    def whole(groups: Column) -> Column:
        sizes = F.filter(F.sequence(F.size(groups), F.lit(1), F.lit(-1)), lambda m: F.forall(F.array(F.array_join(F.slice(groups, F.lit(1), m), "")), checked))

        def put(m: Column) -> Column:
            rest = F.array_join(F.slice(groups, m + 1, F.size(groups)), " ")
            return F.concat(written(F.array_join(F.slice(groups, F.lit(1), m), " ")), F.when(rest != "", F.concat(F.lit(" "), _card(rest, key, back))).otherwise(F.lit("")))

        return F.get(F.transform(F.slice(sizes, 1, 1), put), F.lit(0))

    return F.coalesce(_bound(F.split(v, " "), whole), v)


def _ipv4(v: Column, key: Column, back: bool) -> Column:
    parts = F.transform(F.split(v, r"\."), lambda x: x.cast("long"))
    ok = F.forall(F.split(v, r"\."), lambda x: (x.cast("int") <= 255) & (x == x.cast("int").cast("string")))
    number = ((parts[0] * 256 + parts[1]) * 256 + parts[2]) * 256 + parts[3]
    new = F.transform(F.array(feistel_below(number, 256**4, F.concat(key, F.lit(":ipv4")), back)), lambda n: F.concat_ws(".", F.shiftrightunsigned(n, 24).cast("string"), F.pmod(F.shiftrightunsigned(n, 16), F.lit(256)).cast("string"), F.pmod(F.shiftrightunsigned(n, 8), F.lit(256)).cast("string"), F.pmod(n, F.lit(256)).cast("string")))[0]
    return F.when(ok, new).otherwise(v)


def _ssn(v: Column, key: Column, back: bool) -> Column:
    a, g, s = (F.substring(v, *x).cast("long") for x in ((1, 3), (5, 2), (8, 4)))
    ok = a.between(1, 899) & (a != 666) & (g > 0) & (s > 0)
    number = ((a - 1 - F.when(a > 666, 1).otherwise(0)) * 99 + (g - 1)) * 9999 + (s - 1)

    def shown(n: Column) -> Column:
        area = F.floor(n / (99 * 9999)) + 1
        return F.concat_ws("-", F.lpad((area + F.when(area >= 666, 1).otherwise(0)).cast("string"), 3, "0"), F.lpad((F.pmod(F.floor(n / 9999), F.lit(99)) + 1).cast("string"), 2, "0"), F.lpad((F.pmod(n, F.lit(9999)) + 1).cast("string"), 4, "0"))

    new = F.transform(F.array(feistel_below(number, 898 * 99 * 9999, F.concat(key, F.lit(":ssn")), back)), shown)[0]
    return F.when(ok, new).otherwise(v)


def _phone(v: Column, key: Column, back: bool) -> Column:
    code = F.regexp_extract(v, r"^(\+[0-9]{1,3}(?=[ .(-])|\+[0-9]|)", 1)
    rest = F.substring(v, F.length(code) + 1, F.length(v))
    digits = F.regexp_replace(rest, "[^0-9]", "")
    return F.when(F.length(digits).between(6, 14), F.concat(code, _refill(rest, feistel_digits(digits, F.concat(key, F.lit(":phone")), back), "[0-9]"))).otherwise(v)


#: Days of 1900-01-01 to 2099-12-31.
DAYS = 73049


def _date(v: Column, key: Column, back: bool) -> Column:
    forms = (("^[0-9]{4}-", "yyyy-MM-dd"), ("^[0-9]{4}/", "yyyy/MM/dd"), (r"^[0-9]{2}\.", "dd.MM.yyyy"), ("^[0-9]{2}/", "MM/dd/yyyy"))
    parsed = F.coalesce(*[F.when(v.rlike(shape), F.try_to_date(v, form)) for shape, form in forms], F.when(v.rlike("^[0-9]{2}/"), F.try_to_date(v, "dd/MM/yyyy")))
    day = F.datediff(parsed, F.lit("1900-01-01").cast("date"))
    new = F.transform(F.array(F.date_add(F.lit("1900-01-01").cast("date"), feistel_below(day, DAYS, F.concat(key, F.lit(":date")), back).cast("int"))), lambda d: F.coalesce(
        *[F.when(v.rlike(shape) & (F.try_to_date(v, form).isNotNull()), F.date_format(d, form)) for shape, form in forms], F.date_format(d, "dd/MM/yyyy")))[0]
    return F.when(parsed.isNotNull() & day.between(0, DAYS - 1), new).otherwise(v)


def _letters(v: Column, key: Column, back: bool, hex_only: bool = False) -> Column:
    """Any string: every letter and digit is shifted within its class by a keyed stream that depends on the others.

    Two passes, the second from the other end: in each the shift of a character is keyed by the characters before it
    (as they were before the pass for one way and are after it for the other), which is an unbalanced Feistel network.
    """
    chars = F.filter(F.split(v, ""), lambda c: c != "")

    def passed(cs: Column, tag: str, back_: bool) -> Column:
        def step(s: Column, c: Column) -> Column:
            digest = F.conv(F.substring(F.sha2(F.concat_ws("|", key, F.lit(tag), s["seen"]), 256), 50, 15), 16, 10).cast("long")
            code = F.ascii(c)
            fresh = c
            for lo, size, shape in ((48, 10, "[0-9]"), (97, 6 if hex_only else 26, "[a-f]" if hex_only else "[a-z]"), (65, 6 if hex_only else 26, "[A-F]" if hex_only else "[A-Z]")):
                fresh = F.when(c.rlike(f"^{shape}$"), F.char(lo + F.pmod(code - lo + (-digest if back_ else digest), F.lit(size)))).otherwise(fresh)
            return F.struct(F.concat(s["out"], fresh).alias("out"), F.concat(s["seen"], c if not back_ else fresh).alias("seen"))

        return F.aggregate(cs, F.struct(F.lit("").alias("out"), F.lit("").alias("seen")), step, lambda s: s["out"])

    split = lambda x: F.filter(F.split(x, ""), lambda c: c != "")
    if back:
        return passed(split(F.reverse(passed(split(F.reverse(v)), "2", True))), "1", True)
    # the first pass keys on the plain characters before; the second, from the end, on the first pass's characters
    return F.reverse(passed(split(F.reverse(passed(chars, "1", False))), "2", False))


def _email(v: Column, key: Column, back: bool) -> Column:
    name, host = F.substring_index(v, "@", 1), F.substring_index(v, "@", -1)
    top = F.substring_index(host, ".", -1)
    rest = F.substring(host, F.lit(1), F.length(host) - F.length(top) - 1)
    k = F.concat(key, F.lit(":email"))
    return F.concat(_letters(name, k, back), F.lit("@"), _letters(rest, F.concat(k, F.lit(":host")), back), F.lit("."), top)


def _secret(v: Column, key: Column, back: bool) -> Column:
    head = F.regexp_extract(v, r"^((?:(?i:password|passwd|pwd|secret|token|api_?key|access_?key)\s?[=:]\s?[\"']?)|AKIA|)", 1)
    body = F.substring(v, F.length(head) + 1, F.length(v))
    k = F.concat(key, F.lit(":secret"))
    hexes = body.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$")
    return F.concat(head, F.when(hexes, _letters(body, k, back, True)).otherwise(_letters(body, k, back)))


MAKERS = {"email": _email, "secret": _secret, "iban": _iban, "date": _date, "ssn": _ssn, "ipv4": _ipv4, "phone": _phone, "card": _card}


def pseudonym(value: Column, key: str, back: bool = False) -> Column:
    """The pseudonym of one found value (its kind is told by its shape); ``back`` gives the value of a pseudonym."""
    k = F.lit(key)
    out = value
    for kind, pattern in reversed(KINDS.items()):
        out = F.when(value.rlike(f"^(?:{pattern})$"), MAKERS[kind](value, k, back)).otherwise(out)
    return out


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text", out_col: str = "text", found_col: str | None = "n_found") -> DataFrame:
    """``docs`` with ``out_col`` the text with pseudonyms, and ``found_col`` how many values were replaced."""
    # one capturing group a kind: a find is marked with as many NEXT before it as there are kinds before its own
    every = "|".join(f"({p})" for p in KINDS.values())
    mark = OPEN + NEXT.join(f"${i + 1}" for i in range(len(KINDS))) + OPEN
    text = F.col(text_col).cast("string")
    # segments: even places are plain text, odd places are finds
    hinted = F.coalesce(text.rlike(HINT), F.lit(False))
    safe = text
    for c, name in ((SHUT, "S"), (OPEN, "O"), (NEXT, "N")):
        safe = F.replace(safe, F.lit(c), F.lit(SHUT + name))
    parts = F.when(hinted, F.split(F.regexp_replace(safe, every, mark), OPEN, -1))

    def made(x: Column) -> Column:
        """The find and its pseudonym."""
        out = F.lit(None).cast("string")
        for i, kind in reversed(list(enumerate(KINDS))):
            out = F.when(F.get(x, F.lit(i)) != "", MAKERS[kind](F.get(x, F.lit(i)), F.lit(key), False)).otherwise(out)
        return F.struct(F.array_join(x, "").alias("a"), out.alias("b"))

    both = F.transform(parts, lambda x, i: F.when(F.pmod(i, F.lit(2)) == 1, F.transform(F.array(F.split(x, NEXT, -1)), made)[0]).otherwise(F.struct(x.alias("a"), x.alias("b"))))
    joined = F.transform(F.array(both), lambda s: F.struct(F.array_join(F.transform(s, lambda x: x["b"]), "").alias("text"), F.size(F.filter(s, lambda x: x["a"] != x["b"])).alias("n")))[0]
    held = "__done"
    while held in docs.columns:
        held += "_"
    new = F.col(held)["text"]
    for c, name in ((NEXT, "N"), (OPEN, "O"), (SHUT, "S")):
        new = F.replace(new, F.lit(SHUT + name), F.lit(c))
    done = docs.withColumn(held, F.when(hinted, joined)).withColumn(out_col, F.when(F.col(held).isNotNull(), new).otherwise(text))
    if found_col:
        done = done.withColumn(found_col, F.coalesce(F.col(held)["n"], F.lit(0)))
    return done.drop(held)


def session_key(spark: SparkSession) -> str:
    """The key that the session's configuration names. Where it names none, one is drawn for this session and kept in it:
    values stay linked within the session only, and nobody can turn them back."""
    key = spark.conf.get(KEY_SETTING, None) or spark.sparkContext.getConf().get(KEY_SETTING)
    if not key:
        key = secrets.token_hex(16)
        spark.conf.set(KEY_SETTING, key)
    return key
