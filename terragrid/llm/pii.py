"""Format-preserving pseudonyms for personal numbers, dates and addresses.

Validated values (cards by the Luhn rule, bank accounts by modulo 97, social
security numbers, telephone numbers, IPv4 addresses, dates of the calendar, and
the local parts of e-mail addresses) are replaced by a keyed permutation within
their format, with DataFrame functions only.  Kinds are taken one after the
other, each guarded only against longer numbers of its own kind; what a kind
takes is hidden from the later ones.  Bank accounts and cards are tried from the
longest candidate to the shortest until the check digits fit, and what is left
of a candidate is looked at again.  The permutation is a Feistel
network: in each round the characters of one half move on within their class
(0-9, a-z, A-Z; 2-9 where a number must not begin with 0 or 1) by a keyed hash
of the other half, the type and the round.  Dates are numbers of days in a span
of 400 years, which is 189 x 773 days, and addresses are two 16-bit halves;
both go through a Feistel network on the two residues.  Check digits are
computed anew, so that a pseudonym is as valid as the value.  Letters of e-mail
addresses are permuted in lower case and keep their capitals.

One key gives one permutation: equal values stay equal in all documents,
whatever separators they are written with, different values stay different.

Nulls: a null text stays null.  Rows with equal texts get equal results.  Empty
texts and tables stay empty.  Input columns named like an output are replaced.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .runtime import free_name, let

ROUNDS = 6
EMAIL = r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9](?:[A-Za-z0-9-]*[A-Za-z0-9])?(?:\.[A-Za-z0-9-]+)*\.[A-Za-z]{2,}"
IBAN = r"[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?"
ISO_DATE = r"\d{4}-\d{2}-\d{2}"
SLASH_DATE = r"\d{1,2}[/.]\d{1,2}[/.]\d{4}"
IPV4 = r"\d{1,3}(?:\.\d{1,3}){3}"
SSN = r"\d{3}-\d{2}-\d{4}"
PHONE = r"(?:\+?\d{1,3}[ .-]?)?(?:\(\d{3}\) ?|\d{3}[ .-])\d{3}[ .-]\d{4}|\+\d{1,3}(?:[ .-]?\d{2,4}){2,5}"
CARD = r"\d(?:[ -]?\d){12,18}"
#: solid lengths of IBANs by country; those of other countries are told by their check digits only
IBAN_LENGTHS = {c: int(n) for n, cs in (x.split(":") for x in (
    "15:NO 16:BE 18:DK,FI,FK,FO,GL,NL,SD 19:MK,SI 20:AT,BA,EE,KZ,LT,LU,MN,XK 21:CH,HR,LI,LV 22:BG,BH,CR,DE,GB,GE,IE,ME,RS,VA "
    "23:AE,GI,IL,IQ,OM,SO,TL 24:AD,CZ,ES,MD,PK,RO,SA,SE,SK,TN,VG 25:LY,PT,ST 26:IS,TR 27:BI,DJ,FR,GR,IT,MC,MR,SM 28:AL,AZ,BY,CY,DO,GT,HN,HU,LB,NI,PL,SV "
    "29:BR,EG,PS,QA,UA 30:JO,KW,MU,YE 31:MT,SC 32:LC 33:RU").split()) for c in cs.split(",")}
LISTED = rf"(?:{'|'.join(sorted(IBAN_LENGTHS))})\d{{2}}"


def _iban_shapes():
    for n in sorted(set(IBAN_LENGTHS.values())):
        cs, q, r = "|".join(c for c, x in IBAN_LENGTHS.items() if x == n), *divmod(n - 4, 4)
        yield rf"(?:{cs})\d{{2}}(?: ?[A-Z0-9]{{4}}){{{q}}}" + (rf" ?[A-Z0-9]{{{r}}}" if r else "")
    yield rf"(?!{LISTED})[A-Z]{{2}}\d{{2}}(?: ?(?!{LISTED})[A-Z0-9]{{4}}){{2,7}}(?: ?(?!{LISTED})[A-Z0-9]{{1,3}})?"


def _alone(p: str, before: str = "", behind: str = "") -> str:
    """``p`` not inside a word, nor in a longer value with the separators ``before`` and ``behind``."""
    return "(?<![A-Za-z0-9])" + (rf"(?<!\d{before})" if before else "") + f"(?:{p})(?![A-Za-z0-9])" + (rf"(?!{behind}\d)" if behind else "")


#: groups of digits, 13 digits at least, and what makes the last group part of something else
CARD_RUN = r"(?<![A-Za-z0-9])(?<!\d\.)(?=\d(?:[ -]?\d){12})\d++(?:[ -]\d++)*+(?:[A-Za-z]|\.\d)?+"
NUMBERS = "|".join((_alone(ISO_DATE, "-", "-"), _alone(SLASH_DATE, "[/.]", "[/.]"), _alone(IPV4, r"\.", r"\."), _alone(SSN, "-", "-")))
#: marks of values that are taken: MARK and a character of the kind; ESCAPE stands for MARK itself
MARK, ESCAPE = "", ""
OUTPUTS = ("n_found", "safe_text")


def _hash(key: str, kind: str, round_: Column, *half: Column) -> Column:
    return F.sha2(F.concat_ws("|", F.lit(key), F.lit(kind), round_.cast("string"), *half).cast("binary"), 256)


def _rounds(start: Column, step) -> Column:
    """The rounds of the network, as a loop: nested lambdas would make the plan as deep as there are rounds."""
    return F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), start, step)


def _draw(digests: Column, at: Column) -> Column:
    """The 4-hex-digit number at place ``at``: a digest has 16 of them."""
    return F.conv(F.substring(F.get(digests, F.floor(at / 16).cast("int")), F.pmod(at, F.lit(16)) * 4 + 1, F.lit(4)), 16, 10).cast("int")


def _move(c: Column, first: Column, by: Column) -> Column:
    """Character ``c`` moved on within its class; first: digits 2-9 only."""
    a = F.ascii(c)
    turn = lambda low, size: F.chr(F.lit(low) + F.pmod(a - low + by, F.lit(size)))
    return (
        F.when(first & a.between(50, 57), turn(50, 8))
        .when(first, c)
        .when(a.between(48, 57), turn(48, 10))
        .when(a.between(97, 122), turn(97, 26))
        .when(a.between(65, 90), turn(65, 26))
        .otherwise(c)
    )


def feistel_text(value: Column, key: str, kind: str, strict: tuple[int, ...] = ()) -> Column:
    """Permutation of strings of one shape; ``strict``: places (from 0) of digits that stay within 2-9."""

    def step(x, r):
        stays = lambda i: (i < F.floor(F.size(x) / 2)) == (r % 2 == 1)
        other = F.array_join(F.filter(x, lambda _, i: stays(i)), "")
        digests = F.transform(F.sequence(F.lit(0), F.floor((F.size(x) - 1) / 16).cast("int")), lambda b: _hash(key, kind, r, other, b.cast("string")))
        return let(digests, lambda d: F.transform(x, lambda c, i: F.when(stays(i), c).otherwise(_move(c, i.isin(*strict) if strict else F.lit(False), _draw(d, i)))))

    chars = let(F.filter(F.split(value, ""), lambda c: c != ""), lambda x: F.when(F.size(x) > 0, _rounds(x, step)).otherwise(x))
    return F.array_join(chars, "")


def feistel_pair(left: Column, right: Column, sizes: tuple[int, int], key: str, kind: str) -> Column:
    """Permutation of pairs of numbers below ``sizes`` as struct(l, r)."""
    def step(p, r):
        by = lambda other: F.conv(F.substring(_hash(key, kind, r, other.cast("string")), 1, 12), 16, 10).cast("long")
        even = F.struct(F.pmod(p["l"] + by(p["r"]), F.lit(sizes[0])).cast("long").alias("l"), p["r"].alias("r"))
        odd = F.struct(p["l"].alias("l"), F.pmod(p["r"] + by(p["l"]), F.lit(sizes[1])).cast("long").alias("r"))
        return F.when(r % 2 == 0, even).otherwise(odd)

    return _rounds(F.struct(left.cast("long").alias("l"), right.cast("long").alias("r")), step)


def _fold(chars: Column, zero: int, step) -> Column:
    return F.aggregate(chars, F.lit(zero), step)


def luhn(digits: Column) -> Column:
    """Sum of the Luhn rule of a string of digits; a multiple of 10 if valid."""
    def at(s, x):
        d = F.get(x, s["i"]).cast("int")
        d = F.when(s["i"] % 2 == 1, F.when(d > 4, d * 2 - 9).otherwise(d * 2)).otherwise(d)
        return F.struct((s["n"] + d).alias("n"), (s["i"] + 1).alias("i"))

    chars = F.filter(F.split(F.reverse(digits), ""), lambda c: c != "")
    return let(chars, lambda x: F.aggregate(x, F.struct(F.lit(0).alias("n"), F.lit(0).alias("i")), lambda s, _: at(s, x), lambda s: s["n"]))


def mod97(code: Column) -> Column:
    """Remainder of letters and digits, letters as 10 to 35."""
    chars = F.filter(F.split(code, ""), lambda c: c != "")
    return _fold(chars, 0, lambda s, c: F.when(F.ascii(c) >= 65, (s * 100 + F.ascii(c) - 55) % 97).otherwise((s * 10 + F.ascii(c) - 48) % 97))


def _fill(shape: Column, solid: Column, pattern: str) -> Column:
    """The characters of ``solid`` laid where ``shape`` has characters of ``pattern``, separators kept."""
    def body(s):
        step = lambda acc, c: F.when(c.rlike(pattern), F.struct(F.concat(acc["o"], F.substring(solid, acc["i"] + 1, 1)).alias("o"), (acc["i"] + 1).alias("i"))).otherwise(F.struct(F.concat(acc["o"], c).alias("o"), acc["i"].alias("i")))
        return F.aggregate(s, F.struct(F.lit("").alias("o"), F.lit(0).alias("i")), step, lambda acc: acc["o"])

    return let(F.filter(F.split(shape, ""), lambda c: c != ""), body)


def _digits(v: Column) -> Column:
    return F.regexp_replace(v, r"\D", "")


def _card(v: Column, key: str) -> Column:
    def body(d):
        return let(feistel_text(F.substring(d, F.lit(1), F.length(d) - 1), key, "card"), lambda p: _fill(v, F.concat(p, F.pmod(-luhn(F.concat(p, F.lit("0"))), F.lit(10)).cast("string")), r"\d"))

    return let(_digits(v), body)


def _iban(v: Column, key: str) -> Column:
    def body(s):
        new = feistel_text(F.substring(s, F.lit(5), F.length(s) - 4), key, "iban")
        return let(new, lambda p: _fill(v, F.concat(F.substring(s, 1, 2), F.lpad((98 - mod97(F.concat(p, F.substring(s, 1, 2), F.lit("00")))).cast("string"), 2, "0"), p), r"[A-Z0-9]"))

    return let(F.regexp_replace(v, " ", ""), body)


def _phone(v: Column, key: str) -> Column:
    """The country code stays; area and exchange codes don't begin with 0 or 1."""
    def body(d):
        n = F.length(d)
        ten = F.when(n >= 10, let(F.substring(d, n - 9, F.lit(10)), lambda x: F.concat(F.substring(d, F.lit(1), n - 10), feistel_text(x, key, "phone", (0, 3)))))
        return _fill(v, F.coalesce(ten, F.concat(F.substring(d, 1, 2), feistel_text(F.substring(d, F.lit(3), n), key, "phone"))), r"\d")

    return let(_digits(v), body)


def _ipv4(v: Column, key: str) -> Column:
    def body(o):
        n = F.transform(o, lambda x: x.cast("int"))
        return let(n, lambda q: let(feistel_pair(q[0] * 256 + q[1], q[2] * 256 + q[3], (65536, 65536), key, "ipv4"), lambda p: F.concat_ws(".", F.floor(p["l"] / 256), p["l"] % 256, F.floor(p["r"] / 256), p["r"] % 256)))

    return let(F.split(v, r"\."), body)


def _email(v: Column, key: str) -> Column:
    """The local part moves within its lower-case letters and keeps its capitals, so that spellings in other cases stay linked."""
    def body(local):
        new = feistel_text(F.lower(local), key, "email")
        return F.concat(F.array_join(F.zip_with(F.split(new, ""), F.split(local, ""), lambda n, o: F.when(o.rlike("[A-Z]"), F.upper(n)).otherwise(n)), ""), F.lit("@"), F.substring_index(v, "@", -1))

    return let(F.substring_index(v, "@", 1), body)


#: areas 001 to 899 without 666, groups 01 to 99; serials 0001 to 9999
SSN_SIZES = (898 * 99, 9999)


def _ssn(v: Column, key: str) -> Column:
    """Within the numbers that can be given out: area, group and serial by their rank."""
    def body(d):
        area, group, serial = (F.substring(d, a, n).cast("int") for a, n in ((1, 3), (4, 2), (6, 4)))
        pair = feistel_pair((area - F.when(area > 666, 2).otherwise(1)) * 99 + group - 1, serial - 1, SSN_SIZES, key, "ssn")

        def put(p):
            rank = F.floor(p["l"] / 99)
            return _fill(v, F.concat(F.lpad((rank + F.when(rank >= 665, 2).otherwise(1)).cast("string"), 3, "0"), F.lpad((p["l"] % 99 + 1).cast("string"), 2, "0"), F.lpad((p["r"] + 1).cast("string"), 4, "0")), r"\d")

        return let(pair, put)

    return let(_digits(v), body)


#: days of the span 1800-01-01 to 2199-12-31, and its first day as a number
SPAN, FIRST = (189, 773), "1800-01-01"


def _date(day: Column, key: str) -> Column:
    n = F.date_diff(day, F.lit(FIRST).cast("date"))
    return let(feistel_pair(F.floor(n / SPAN[1]), n % SPAN[1], SPAN, key, "date"), lambda p: F.date_add(F.lit(FIRST).cast("date"), (p["l"] * SPAN[1] + p["r"]).cast("int")))


def pseudonym(v: Column, key: str) -> Column:
    """The pseudonym of a match; the match itself if it isn't valid."""
    whole = lambda p: v.rlike(rf"^(?:{p})$")
    parts = F.split(v, r"[/.]")
    as_date = lambda d, m: F.try_to_date(F.concat_ws("-", F.get(parts, F.lit(2)), F.lpad(F.get(parts, F.lit(m)), 2, "0"), F.lpad(F.get(parts, F.lit(d)), 2, "0")), "yyyy-MM-dd")
    iso = F.try_to_date(v, "yyyy-MM-dd")
    in_span = lambda d: d.isNotNull() & d.between(F.lit(FIRST).cast("date"), F.lit("2199-12-31").cast("date"))
    sep = F.regexp_extract(v, r"[/.]", 0)
    day_first, month_first = as_date(0, 1), as_date(1, 0)
    print_as = lambda d, shape: F.when(shape == "dmy", F.concat_ws("", F.date_format(d, "dd"), sep, F.date_format(d, "MM"), sep, F.date_format(d, "yyyy"))).otherwise(F.concat_ws("", F.date_format(d, "MM"), sep, F.date_format(d, "dd"), sep, F.date_format(d, "yyyy")))
    octets_ok = F.forall(F.split(v, r"\."), lambda x: x.cast("int") <= 255)
    ssn_ok = ~v.rlike(r"^(?:000|666|9)|^\d{3}-00|0000$")
    solid = F.regexp_replace(v, " ", "")
    return (
        F.when(whole(EMAIL), _email(v, key))
        .when(whole(IBAN), F.when(mod97(F.concat(F.substring(solid, F.lit(5), F.length(solid)), F.substring(solid, 1, 4))) == 1, _iban(v, key)).otherwise(v))
        .when(whole(ISO_DATE), F.when(in_span(iso), F.date_format(_date(iso, key), "yyyy-MM-dd")).otherwise(v))
        .when(whole(SLASH_DATE), F.when((sep == ".") & in_span(day_first), print_as(_date(day_first, key), F.lit("dmy"))).when(in_span(month_first), print_as(_date(month_first, key), F.lit("mdy"))).when(in_span(day_first), print_as(_date(day_first, key), F.lit("dmy"))).otherwise(v))
        .when(whole(IPV4), F.when(octets_ok, _ipv4(v, key)).otherwise(v))
        .when(whole(SSN), F.when(ssn_ok, _ssn(v, key)).otherwise(v))
        .when(whole(CARD), F.when(luhn(_digits(v)) % 10 == 0, _card(v, key)).when(whole(PHONE), _phone(v, key)).otherwise(v))
        .when(whole(PHONE), _phone(v, key))
        .otherwise(v)
    )


def _taken(v: Column, new: Column, mark: str) -> Column:
    """(t, values) of a candidate: t is the mark if its pseudonym differs, and the candidate if not."""
    return let(new, lambda n: F.when(n != v, F.struct(F.lit(mark).alias("t"), F.array(n).alias("values"))).otherwise(F.struct(v.alias("t"), F.array().cast("array<string>").alias("values"))))


def _none(v: Column) -> Column:
    return F.struct(v.alias("t"), F.array().cast("array<string>").alias("values"))


def _email_in(v: Column, key: str, mark: str) -> Column:
    return _taken(v, _email(v, key), mark)


def _iban_in(v: Column, key: str, mark: str) -> Column:
    """The longest run of whole groups from the first that has valid check digits."""
    def body(g):
        part = lambda k: F.array_join(F.slice(g, F.lit(1), k), "")
        fits = lambda k: (F.length(part(k)) >= 12) & ((k == F.size(g)) | ~v.rlike(f"^{LISTED}")) & (mod97(F.concat(F.substring(part(k), F.lit(5), F.length(part(k))), F.substring(part(k), 1, 4))) == 1)
        best = F.get(F.filter(F.sequence(F.size(g), F.lit(1), F.lit(-1)), fits), F.lit(0))

        def cut(k):
            old = F.array_join(F.slice(g, F.lit(1), k), " ")
            return let(old, lambda o: F.struct(F.concat(F.lit(mark), F.substring(v, F.length(o) + 1, F.length(v))).alias("t"), F.array(_iban(o, key)).alias("values")))

        return let(best, lambda k: F.when(k.isNull(), _none(v)).otherwise(cut(k)))

    return let(F.split(v, " "), body)


def _cards_in(v: Column, key: str, mark: str) -> Column:
    """Cards in a run of groups of digits: from the first group on, the longest valid number of whole groups."""
    def body(g):
        def fits(i, e):
            run = F.slice(g, i + 1, e - i)
            text = F.array_join(run, "")
            inner = F.concat(F.regexp_replace(F.get(g, i), "^[ -]", ""), F.array_join(F.slice(g, i + 2, e - i - 1), ""))
            longer = inner.contains("-") & (F.get(g, i).startswith("-") | F.coalesce(F.get(g, e).startswith("-"), F.lit(False)))
            return F.when(F.length(_digits(text)).between(13, 19) & ~text.rlike("[A-Za-z.]") & ~longer, luhn(_digits(text)) % 10 == 0).otherwise(False)

        def step(s, i):
            best = F.get(F.filter(F.sequence(F.least(i + 19, F.size(g)), i + 1, F.lit(-1)), lambda e: fits(i, e)), F.lit(0))

            def put(e):
                lead = F.regexp_extract(F.get(g, i), "^[ -]?", 0)
                old = F.concat(F.regexp_replace(F.get(g, i), "^[ -]", ""), F.array_join(F.slice(g, i + 2, e - i - 1), ""))
                return F.struct(e.alias("next"), F.concat(s["t"], lead, F.lit(mark)).alias("t"), F.concat(s["values"], F.array(_card(old, key))).alias("values"))

            return F.when(i < s["next"], s).otherwise(let(best, lambda e: F.when(e.isNull(), F.struct((i + 1).alias("next"), F.concat(s["t"], F.get(g, i)).alias("t"), s["values"].alias("values"))).otherwise(put(e))))

        start = F.struct(F.lit(0).alias("next"), F.lit("").alias("t"), F.array().cast("array<string>").alias("values"))
        return F.aggregate(F.sequence(F.lit(0), F.size(g) - 1), start, step, lambda s: F.struct(s["t"].alias("t"), s["values"].alias("values")))

    return let(F.regexp_extract_all(v, F.lit(r"[ -]?\d+(?:[A-Za-z]|\.\d)?"), F.lit(0)), body)


#: in the order in which they take values
STAGES = (
    (_alone(EMAIL), "@", _email_in),
    (_alone("|".join(f"(?:{p})" for p in _iban_shapes())), r"[A-Z]{2}\d{2}", _iban_in),
    (NUMBERS, r"\d[-/.]\d", lambda v, key, mark: _taken(v, pseudonym(v, key), mark)),
    (CARD_RUN, r"\d(?:[ -]?\d){12}", _cards_in),
    (_alone(PHONE, "[.-]", "[.-]"), r"\d{2}", lambda v, key, mark: _taken(v, _phone(v, key), mark)),
)


def pseudonymise(docs: DataFrame, key: str, text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` with safe_text and n_found (values replaced, long).  Who knows the key can invert the pseudonyms."""
    if not key:
        raise ValueError("pseudonyms need a key")
    text = F.col(f"`{text_col}`").cast("string")
    name = free_name(docs, "__matches")
    woven = lambda rest, between: F.array_join(F.transform(rest, lambda x, i: F.concat(x, F.coalesce(F.get(between, i), F.lit("")))), "")
    out = docs.withColumn(name, F.struct(F.when(text.rlike(r"[0-9@]"), F.replace(text, F.lit(MARK), F.lit(ESCAPE))).alias("t")))
    for n, (pattern, hint, found_in) in enumerate(STAGES):
        mark = MARK + chr(0xE002 + n)
        now = F.col(f"{name}.t")
        hits = F.when(now.rlike(hint), F.transform(F.regexp_extract_all(now, F.lit(pattern), F.lit(0)), lambda v: found_in(v, key, mark)))  # noqa: B023
        before = [F.col(f"{name}.v{i}").alias(f"v{i}") for i in range(n)]
        hit = lambda h: F.struct(F.when(F.size(h) > 0, woven(F.split(now, pattern, -1), F.transform(h, lambda x: x["t"]))).otherwise(now).alias("t"), *before, F.when(F.size(h) > 0, F.flatten(F.transform(h, lambda x: x["values"]))).alias(f"v{n}"))  # noqa: B023, E731
        out = out.withColumn(name, let(hits, hit))
    safe, found = F.col(f"{name}.t"), F.lit(0)
    for n in reversed(range(len(STAGES))):
        values = F.col(f"{name}.v{n}")
        safe = F.when(F.size(values) > 0, woven(F.split(safe, MARK + chr(0xE002 + n), -1), values)).otherwise(safe)
        found = found + F.when(F.size(values) > 0, F.size(values)).otherwise(0)
    kept = [F.col(f"`{c}`") for c in docs.columns if c not in OUTPUTS]
    safe = F.when(found > 0, F.replace(safe, F.lit(ESCAPE), F.lit(MARK)))
    return out.select(*kept, found.cast("long").alias("n_found"), F.coalesce(safe, text).alias("safe_text"))
