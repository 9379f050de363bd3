"""Surrogates for personal data: keyed, type-consistent and distinct (native)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.session import Cut

#: Titles that mark a name, by the gender they show: fixed values.
TITLES = {
    "f": ["Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Srta", "Signora", "Madame", "Mme", "Mlle", "Lady", "Госпожа", "Κυρία"],
    "m": ["Mr", "Herr", "Señor", "Sr", "Signor", "Monsieur", "Sir", "Lord", "Господин", "Κύριος"],
    "n": ["Dr", "Prof"],
}
#: Words that stand uncapitalised inside names and stay as they are: fixed values.
PARTICLES = ["de", "del", "der", "den", "des", "la", "las", "los", "le", "van", "von", "vom", "zu", "zur", "da", "das", "dos", "di", "du", "el", "al", "bin", "ibn", "ben", "ter", "y", "af", "av"]
_TITLE = "(?:" + "|".join(t for group in TITLES.values() for t in group) + r")\.?"
#: One or more titles with what follows them up to the name.
_TITLED = rf"(?:{_TITLE}(?:\h+|\h*\n\h*))++"
_PARTICLE = rf"(?:(?:{'|'.join(PARTICLES)})\h+)*+"
_WORD = r"(?:\p{Lu}\.(?=\h*+\p{Lu})|\p{Lu}[\p{L}\p{M}]*+(?:['’](?!s(?!\p{L}))\p{L}[\p{L}\p{M}]*+)*+(?:-\p{L}[\p{L}\p{M}]*+)*+)"
_EDGE, _END = r"(?<![\p{L}\p{N}_])", r"(?![\p{L}\p{N}_])"
_OCTET = r"(?:25[0-5]|2[0-4]\d|1\d\d|[1-9]?\d)"
_H16 = "[0-9a-fA-F]{1,4}"
_MARK = "(?:sk|ghp|gho|xox[abp]|AKIA|AIza|eyJ)"
#: A web token: two or three parts, of which the first begins as encoded JSON does.
_TOKEN = r"eyJ[A-Za-z0-9_-]{5,}+\.[A-Za-z0-9_-]{5,}+(?:\.[A-Za-z0-9_-]*+)?"
#: Java patterns by kind, in order of precedence where they overlap. Repeats are possessive, so that long runs cost one pass.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]++@[\p{L}\p{N}-]++(?:\.[\p{L}\p{N}-]++)++",
    "name": rf"{_EDGE}{_TITLED}{_PARTICLE}{_WORD}(?:\h*+(?<=[\h.]){_PARTICLE}{_WORD})*+",
    "iban": _EDGE + r"(?:[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?|(?=(?: ?[a-z]{0,4} ?\d){12})[a-z]{2}\d{2}(?: ?[a-z0-9]{4}){3,7}(?: ?[a-z0-9]{1,3})?)" + _END,
    "ip": rf"(?<![\p{{L}}\p{{N}}.])(?:{_OCTET}\.){{3}}{_OCTET}(?!\.?[\p{{L}}\p{{N}}])",
    "ip6": rf"(?<![\p{{L}}\p{{N}}:])(?=[0-9a-fA-F:]*\d)(?:(?:{_H16}:){{7}}{_H16}|(?:{_H16}:){{1,6}}(?::{_H16}){{1,6}}|(?:{_H16}:){{1,7}}:)(?![\p{{L}}\p{{N}}:])",
    "phone": r"\+\d(?:[ .()/-]{0,2}\d){6,14}(?![\p{L}\p{N}])|(?<![\p{L}\p{N}+])(?:\(\d{3}\) ?\d{3}[-. ]\d{4}|\d{3}-\d{3}-\d{4}|\d{3}\.\d{3}\.\d{4}|0\d{2,4}[ /-]\d{6,8}"
    r"|0\d(?:[ .-]\d{2}){4}|0\d{2,4}[ -]\d{3,4}[ -]\d{3,4}|\(0\d{1,4}\) ?\d{3,4}[ -]?\d{3,4}|[679]\d{2} \d{3} \d{3})(?![\p{L}\p{N}]|[-. ]\d)",
    "ssn": _EDGE + r"\d{3}-\d{2}-\d{4}" + _END,
    "card": _EDGE + r"(?:\d{4}(?:-\d{4}){3}|\d{4}(?: \d{4}){3}|\d{13,19})" + _END,
    "secret": _EDGE + rf"(?:{_TOKEN}|(?=[a-fA-F]*\d)[0-9a-fA-F]{{32,}}+|{_MARK}(?=[A-Za-z_-]*\d)[-_]?[A-Za-z0-9_-]{{16,}}+|(?<=://)[^\s:/@]++:[^\s/@]++(?=@))" + _END,
}
ANY = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: A text without any of these has no entity; it spares most texts the long pattern.
HINT = rf"\d|@|{_TITLE}\s"
#: Country calling codes of one and of two digits; all others have three: fixed values.
CODES_1 = ["1", "7"]
CODES_2 = ["20", "27", "30", "31", "32", "33", "34", "36", "39", "40", "41", "43", "44", "45", "46", "47", "48", "49", "51", "52", "53", "54", "55", "56", "57", "58", "60", "61", "62", "63", "64", "65", "66", "81", "82", "84", "86", "90", "91", "92", "93", "94", "95", "98"]
#: First and last code points within which characters change places: digits and the letters of one script and case: fixed values.
RANGES = [
    (0x30, 0x39), (0x61, 0x7A), (0x41, 0x5A), (0xE0, 0xF6), (0xF8, 0xFE), (0xC0, 0xD6), (0xD8, 0xDE), (0x3B1, 0x3C1), (0x3C3, 0x3C9), (0x391, 0x3A1), (0x3A3, 0x3A9),
    (0x430, 0x44F), (0x410, 0x42F), (0x5D0, 0x5EA), (0x621, 0x63A), (0x905, 0x939), (0xE01, 0xE2E), (0x3041, 0x3096), (0x30A1, 0x30FA), (0x4E00, 0x9FA5), (0xAC00, 0xD7A3),
]
#: Consonants, vowels, and endings of female, male and other given names by script: fixed values.
SOUNDS = {
    "latin": ("bdfgklmnprstvz", "aeiou", "a", "n", "i"),
    "cyrillic": ("бвгдзклмнпрст", "аеиоу", "а", "н", "и"),
    "greek": ("βγδζκλμνπρστφ", "αειου", "α", "ν", "ι"),
}
#: Rounds of the keyed permutation.
ROUNDS = 6


def kind_of(surface: Column) -> Column:
    out = F.lit("secret")
    for kind in reversed(list(PATTERNS)[:-1]):
        out = F.when(surface.rlike(f"^(?:{PATTERNS[kind]})$"), F.lit(kind)).otherwise(out)
    return out


def _chars(text: Column) -> Column:
    """The characters of a text that is not empty."""
    return F.split(text, "")


def _lowered(text: Column) -> Column:
    """Lower case, character for character."""
    return F.array_join(F.transform(_chars(text), lambda c: F.substring(F.lower(c), 1, 1)), "")


def _alnum(text: Column) -> Column:
    return F.regexp_replace(text, r"[^\p{L}\p{N}]", "")


def canonical(kind: Column, surface: Column) -> Column:
    """What mentions of one entity have in common: case and spacing aside. Names have no such form; see ``_names``."""
    return (
        F.when(kind.isin("email", "ip6"), _lowered(surface))
        .when(kind == "ip", surface)
        .when(kind == "phone", F.concat(F.when(surface.startswith("+"), F.lit("+")).otherwise(F.lit("")), _alnum(surface)))
        .when(kind == "secret", surface)
        .when(kind == "iban", F.upper(_alnum(surface)))
        .otherwise(_alnum(surface))
    )


def _bound(value: Column, f) -> Column:
    """``f(value)`` with value computed once; a lambda's variable is, an expression in its body isn't."""
    return F.get(F.transform(F.array(value), f), F.lit(0))


def _round(key: Column, values: Column, sizes: Column, r: Column, sign: int) -> Column:
    """One Feistel round: the values of one half move by what key, round and the other half say, each within its size."""
    n = F.size(values)
    half = F.floor(n / 2).cast("int")
    first = r % 2 == 0
    other = F.when(first, F.slice(values, half + 1, n - half)).otherwise(F.slice(values, 1, half))
    seed = F.concat(key, F.lit("\x1f"), r.cast("string"), F.lit("\x1f"), F.array_join(F.transform(other, lambda x: x.cast("string")), ","))
    blocks = _bound(seed, lambda s: F.transform(F.sequence(F.lit(0), F.floor(n / 16).cast("int")), lambda b: F.sha2(F.concat(s, F.lit("\x1f"), b.cast("string")), 256)))

    def moved(digests: Column) -> Column:
        amount = lambda i: F.conv(F.substring(F.get(digests, F.floor(i / 16).cast("int")), F.lit(1) + (i % 16) * 4, F.lit(4)), 16, 10).cast("int")
        return F.transform(values, lambda x, i: F.when((i < half) == first, F.pmod(x + sign * amount(i), F.get(sizes, i))).otherwise(x))

    return _bound(blocks, moved)


def permuted(key: Column, values: Column, sizes: Column) -> Column:
    """Another array of the same ``sizes``, each value below its size: a keyed bijection that leaves no array as it is, but where all sizes are 1.

    ``key`` also names the form, the pattern of what surrounds the values. P is a Feistel network; x goes to the inverse of P
    of P(x) with its first value of size 2 or more moved on by one. That is one-to-one, so distinctness needs no rounds of drawing and a form all of whose
    values occur is no special case; and it has no fixed point, as moving on has none.
    """
    there = F.aggregate(F.sequence(F.lit(0), F.lit(ROUNDS - 1)), values, lambda v, r: _round(key, v, sizes, r, 1))
    first = F.array_position(F.transform(sizes, lambda n: n > 1), F.lit(True)) - 1
    next_ = _bound(there, lambda v: F.transform(v, lambda x, i: F.when(i == first, (x + 1) % F.get(sizes, i)).otherwise(x)))
    return F.aggregate(F.sequence(F.lit(ROUNDS - 1), F.lit(0), F.lit(-1)), next_, lambda v, r: _round(key, v, sizes, r, -1))


def _low(code: Column, hexed: Column) -> tuple[Column, Column]:
    """First code point and size of the range in which a character changes places; size 1 where it stays."""
    low, size = code, F.lit(1)
    for a, b in RANGES:
        n = F.when(hexed, F.lit(6)).otherwise(F.lit(b - a + 1)) if a in (0x61, 0x41) else F.lit(b - a + 1)
        low, size = F.when(code.between(a, b), F.lit(a)).otherwise(low), F.when(code.between(a, b), n).otherwise(size)
    return low, size


def _char(code: Column) -> Column:
    return F.decode(F.unhex(F.lpad(F.hex(code.cast("long")), 8, "0")), "UTF-32")


def _luhn_check(digits: Column) -> Column:
    """The digit that, put after ``digits``, makes their Luhn sum 0 mod 10."""
    n = F.size(digits)
    doubled = lambda x: x * 2 - F.when(x > 4, 9).otherwise(0)
    total = F.aggregate(F.transform(digits, lambda x, i: F.when((n - i) % 2 == 1, doubled(x.cast("int"))).otherwise(x.cast("int"))), F.lit(0), lambda a, x: a + x)
    return F.pmod(-total, F.lit(10))


def _iban_check(country: Column, body: Column) -> Column:
    """The two check digits of an account number, by ISO 7064."""
    add = lambda a, c: F.when(c.rlike("[0-9]"), (a * 10 + c.cast("int")) % 97).otherwise((a * 100 + F.ascii(F.upper(c)) - 55) % 97)
    return F.lit(98) - F.aggregate(_chars(F.concat(body, country, F.lit("00"))), F.lit(0), add)


def surrogates(entities: DataFrame, key: str) -> DataFrame:
    """``entities(kind, canon)`` with ``surrogate``, for all kinds but names; of one kind, no two share one and none keeps its own.

    What stays of an entity is its form: the kind of each character, an e-mail's top-level domain, a phone's country code, a card's first
    digit, an account's country, a secret's mark, the lengths of octets, and whether a check digit is right.
    """
    kind, canon = F.col("kind"), F.col("canon")
    code = F.regexp_extract(canon, rf"^\+({'|'.join(CODES_1)}|{'|'.join(CODES_2)}|\d{{3}})", 0)
    head = (
        F.when(kind == "phone", code).when(kind == "card", F.substring(canon, 1, 1)).when(kind == "iban", F.substring(canon, 1, 2))
        .when((kind == "secret") & ~canon.rlike("^[0-9a-fA-F]+$"), F.regexp_extract(canon, f"^{_MARK}", 0)).otherwise(F.lit(""))
    )
    tail = F.when(kind == "email", F.regexp_extract(canon, r"\.[^.]*$", 0)).when(kind == "card", F.substring(canon, -1, 1)).otherwise(F.lit(""))
    rows = entities.select("kind", "canon", head.alias("head"), tail.alias("tail"), F.when(kind == "iban", F.substring(canon, 3, 2)).otherwise(F.lit("")).alias("check"))
    start = F.length("head") + F.length("check")
    rows = rows.withColumn("body", F.substring(canon, start + 1, F.length(canon) - start - F.length("tail")))
    hexed = (kind == "ip6") | ((kind == "secret") & (F.col("head") == "") & canon.rlike("^[0-9a-fA-F]+$"))
    # what changes places: an address's octets by their number of digits, else characters
    octet = lambda o: F.struct(o.cast("int").alias("code"), F.when(F.length(o) == 1, 0).when(F.length(o) == 2, 10).otherwise(100).alias("low"), F.when(F.length(o) == 1, 10).when(F.length(o) == 2, 90).otherwise(156).alias("size"))
    letter = lambda c: _bound(F.ascii(c), lambda a: F.struct(a.alias("code"), _low(a, hexed)[0].alias("low"), _low(a, hexed)[1].alias("size")))
    places = F.when(kind == "ip", F.transform(F.split("body", r"\."), octet)).otherwise(F.transform(_chars(F.col("body")), letter))
    rows = rows.select("*", F.inline(F.array(F.struct(places.alias("places")))))
    rows = rows.select("*", F.inline(F.array(F.struct(
        F.transform("places", lambda p: F.when(p["size"] > 1, p["code"] - p["low"]).otherwise(0)).alias("values"), F.transform("places", lambda p: p["size"]).alias("sizes"),
        F.concat_ws("\x1f", F.lit(key), kind, "head", F.array_join(F.transform("places", lambda p: F.concat_ws(".", F.when(p["size"] > 1, p["low"]).otherwise(p["code"]), p["size"])), ",")).alias("form"),
    ))))
    rows = rows.select("*", F.inline(F.array(F.struct(permuted(F.sha2("form", 256), F.col("values"), F.col("sizes")).alias("put")))))
    put = F.transform("places", lambda p, i: F.when(p["size"] > 1, p["low"] + F.get("put", i)).otherwise(p["code"]))
    rows = rows.select("*", F.inline(F.array(F.struct(F.when(kind == "ip", F.array_join(F.transform(put, lambda x: x.cast("string")), ".")).otherwise(F.array_join(F.transform(put, _char), "")).alias("new")))))
    # a right check digit stays right, a wrong one as wrong as it was
    luhn = lambda b: _luhn_check(_chars(F.concat("head", b)))
    last = F.pmod(F.col("tail").cast("int") - luhn(F.col("body")) + luhn(F.col("new")), F.lit(10)).cast("string")
    twin = F.lpad(F.pmod(F.col("check").cast("int") - _iban_check(F.col("head"), F.col("body")) + _iban_check(F.col("head"), F.col("new")), F.lit(100)).cast("string"), 2, "0")
    whole = F.when(kind == "card", F.concat("head", "new", last)).when(kind == "iban", F.concat("head", twin, "new")).otherwise(F.concat("head", "new", "tail"))
    return rows.select("kind", "canon", whole.alias("surrogate"))


def _words_of(surface: Column) -> Column:
    return F.regexp_extract_all(F.regexp_replace(surface, f"^{_TITLED}", ""), F.lit(r"[^\s\p{Pd}.]+\.?"), F.lit(0))


def _syllables(script: str, number: Column, count: int) -> Column:
    """``count`` syllables that spell ``number``, one to one below (consonants x vowels) ** count."""
    consonants, vowels = SOUNDS[script][:2]
    n, parts = len(consonants) * len(vowels), []
    for i in range(count):
        d = F.pmod(F.floor(number / n**i).cast("long"), F.lit(n))
        parts += [F.substring(F.lit(consonants), (F.floor(d / len(vowels)) + 1).cast("int"), F.lit(1)), F.substring(F.lit(vowels), (d % len(vowels) + 1).cast("int"), F.lit(1))]
    return F.concat(*parts)


def _by_script(script: Column, made) -> Column:
    return F.when(script == "cyrillic", made("cyrillic")).when(script == "greek", made("greek")).otherwise(made("latin"))


def name_words(words: DataFrame, key: str) -> DataFrame:
    """``words(role, gender, word)``, distinct, with ``put``: made-up words, of which no two of one role and gender are equal.

    A word's draw depends on the key and the word alone. The collision check: words that drew the same, or an
    actual word of the corpus, are put in an order by hash, and all but the first get syllables that spell their rank. A rank's syllables
    make a longer word than any draw has, so the longer words neither equal draws nor, as they hold draw and rank, each other.
    Single letters (initials) change places by permutation. No step repeats.
    """
    script = F.when(F.col("word").rlike(r"\p{IsCyrillic}"), "cyrillic").when(F.col("word").rlike(r"\p{IsGreek}"), "greek").otherwise("latin")
    drawn = F.conv(F.substring(F.sha2(F.concat_ws("\x1f", F.lit(key), "role", "gender", "word"), 256), 1, 12), 16, 10).cast("long")
    rows = words.where(F.length("word") > 1).select("*", script.alias("script"), drawn.alias("n"))
    base = _by_script(F.col("script"), lambda s: _syllables(s, F.col("n"), 3))
    rows = Cut(rows.select("*", base.alias("base")), "name-words").df

    def ending(s: str) -> Column:
        f, m, n = SOUNDS[s][2:]
        return F.when(F.col("role") == "family", {"latin": "k", "cyrillic": "к", "greek": "ς"}[s]).when(F.col("gender") == "f", f).when(F.col("gender") == "m", m).otherwise(n)

    whole = F.concat("base", _by_script(F.col("script"), ending))
    actual = words.select(F.col("word").alias("_actual")).distinct()
    taken = rows.join(actual, whole == F.col("_actual"), "left")
    w = Window.partitionBy("role", "gender", "base").orderBy(F.xxhash64("word"), "word")
    rank = F.row_number().over(w) - F.when(F.col("_actual").isNull(), 1).otherwise(0)
    ranked = taken.withColumn("rank", rank.cast("long"))

    def spelled(s: str) -> Column:
        n = len(SOUNDS[s][0]) * len(SOUNDS[s][1])
        out, below = F.lit(""), 0
        for k in (1, 2, 3, 4):  # rank 1 to n, then to n + n ** 2 and so on
            out = F.when(F.col("rank") > below, _syllables(s, F.col("rank") - 1 - below, k)).otherwise(out)
            below += n**k
        return out

    put = F.concat("base", _by_script(F.col("script"), spelled), _by_script(F.col("script"), ending))
    initials = words.where(F.length("word") == 1).select("role", "gender", "word", F.ascii("word").alias("code"))
    low, size = _low(F.col("code"), F.lit(False))
    initials = initials.select("*", low.alias("low"), size.alias("size"))
    moved = permuted(F.sha2(F.concat_ws("\x1f", F.lit(key), "role", "gender", "low"), 256), F.array(F.col("code") - F.col("low")), F.array("size"))
    initials = initials.select("role", "gender", "word", _char(F.col("low") + F.get(moved, F.lit(0))).alias("put"))
    return ranked.select("role", "gender", "word", put.alias("put")).unionByName(initials)


def _names(surfaces: DataFrame, key: str) -> DataFrame:
    """``(surface, put)`` for the name mentions ``surfaces(surface)``, distinct.

    A person is the words after the titles, case aside. The title shows the gender; under titles
    of no gender the person has the one that other mentions of the same words show (the commoner, f if equal). The last word is the
    family name, which stays the same beside any given name; given names end by gender. Title, particles, punctuation and case stay.
    """
    gender = F.when(F.col("surface").rlike(r"(?:^|\s)(?:" + "|".join(TITLES["f"]) + r")\.?\s"), "f").when(F.col("surface").rlike(r"(?:^|\s)(?:" + "|".join(TITLES["m"]) + r")\.?\s"), "m")
    rows = surfaces.select("surface", F.filter(_words_of(F.col("surface")), lambda x: x.rlike(r"^\p{Lu}") | x.rlike(r"^(?!(?:" + "|".join(PARTICLES) + r")$)")).alias("words"), gender.alias("shown"))
    rows = rows.withColumn("words", F.transform("words", lambda x: _lowered(F.regexp_replace(x, r"\.$", "")))).withColumn("person", F.array_join("words", " "))
    by = rows.groupBy("person").agg(F.count_if(F.col("shown") == "f").alias("f"), F.count_if(F.col("shown") == "m").alias("m"))
    by = by.select("person", F.when((F.col("f") == 0) & (F.col("m") == 0), "n").when(F.col("f") >= F.col("m"), "f").otherwise("m").alias("known"))
    rows = rows.join(by, "person").withColumn("gender", F.coalesce("shown", "known"))
    each = rows.select("surface", F.size("words").alias("of"), "gender", F.posexplode("words").alias("at", "word"))
    role = F.when(F.col("at") + 1 == F.col("of"), "family").otherwise("given")
    each = each.select("surface", "at", "word", role.alias("role"), F.when(role == "given", F.col("gender")).otherwise("").alias("gender"))
    each = Cut(each, "name-mentions").df
    made = name_words(each.select("role", "gender", "word").distinct(), key)
    put = each.join(made, ["role", "gender", "word"]).groupBy("surface").agg(F.transform(F.sort_array(F.collect_list(F.struct("at", "put"))), lambda x: x["put"]).alias("puts"))
    # words that are no particles are replaced one after the other
    title = F.regexp_extract("surface", f"^{_TITLED}", 0)
    rest = F.substring("surface", F.length(title) + 1, F.length("surface"))
    mark = r"(?<![\p{L}\p{M}'’])(?!(?:" + "|".join(PARTICLES) + r")(?:[\s]))[\p{L}][\p{L}\p{M}'’]*+"
    old, gaps = F.regexp_extract_all(rest, F.lit(mark), F.lit(0)), F.split(rest, mark, -1)
    cased = lambda o, p: F.when((F.length(o) > 1) & (o == F.upper(o)), F.upper(p)).when(o.rlike(r"^\p{Lu}"), F.concat(F.upper(F.substring(p, 1, 1)), F.substring(p, 2, 1 << 20))).otherwise(p)
    new = F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(cased(F.get(old, i), F.get("puts", i)), F.lit(""))))
    return put.select("surface", F.concat(title, F.array_join(new, "")).alias("put"))


def rendered(kind: Column, surface: Column, found: Column) -> Column:
    """The surrogate ``found`` in the form of a mention: its punctuation, spacing and case."""
    stream = F.regexp_replace(found, r"^\+", "")
    spaced = F.transform(F.split(surface, r"[\p{L}\p{N}]", -1), lambda g, i: F.concat(g, F.coalesce(F.substring(stream, i + 1, F.lit(1)), F.lit(""))))
    mail = _bound(F.struct(_chars(surface).alias("s"), _chars(found).alias("f")), lambda x: F.transform(x["s"], lambda c, i: F.when(c.rlike(r"\p{Lu}"), F.upper(F.get(x["f"], i))).otherwise(F.get(x["f"], i))))
    spaced = F.array_join(spaced, "")
    spaced = F.when((kind == "iban") & (surface == F.lower(surface)), F.lower(spaced)).otherwise(spaced)
    return F.when(kind.isin("email", "ip6"), F.array_join(mail, "")).when(kind.isin("ip", "secret"), found).otherwise(spaced)


def is_account(surface: Column) -> Column:
    """Whether what looks like an account number is one: its check digits are right, or it is mostly digits, mistyped."""
    plain = F.upper(_alnum(surface))
    right = F.substring(plain, 3, 2).cast("int") == _iban_check(F.substring(plain, 1, 2), F.substring(plain, 5, 1 << 20))
    return right | (F.length(F.regexp_replace(plain, "[^0-9]", "")) >= 10)


def replace_pii(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with personal data in ``text`` replaced by surrogates, and ``n_entities``.

    E-mail and IP addresses, phone, card, social-security and account numbers, secrets, and names
    after a title are found by pattern. Phone and card numbers have the lengths that their standards allow (15 and 19 digits); of the rest none has a
    length beyond which it fails. Names are known by their capitals, so not in scripts without case. A mention's surrogate depends on ``key`` (a secret of the
    caller's: who knows it can undo numbers and addresses), on its kind and on its canonical value, so
    mentions of one entity, in any document or form, get the same one (coreference), in the mention's own form (see ``surrogates``, ``_names``). Within a kind
    different entities get different surrogates and none keeps its value. In a form whose values are few, such as addresses of one-digit octets,
    a surrogate may be another entity's true value; where all occur, it must be.

    Null text stays null and empty text empty, with 0 entities; rows that repeat doc_id and text get the same
    text; a null doc_id is a value like another; an incoming ``n_entities`` is replaced, other columns are kept as they are. An
    empty table gives an empty result. Texts of any length are read whole, in one task each. Only texts with entities are shuffled.
    """
    own = [c for c in docs.columns if c != "n_entities"]
    rows = docs.select(*own)
    has = F.coalesce(F.col("text").rlike(HINT) & F.col("text").rlike(ANY), F.lit(False))
    plain = rows.where(~has).withColumn("n_entities", F.lit(0))
    some = rows.where(has)
    mentions = some.select(
        F.col("doc_id").alias("_d"), F.xxhash64("text").alias("_t"), F.posexplode(F.regexp_extract_all("text", F.lit(ANY), F.lit(0))).alias("_i", "surface")
    )
    mentions = Cut(mentions, "mentions").df
    # a fixed number of partitions, for what is done with each distinct mention is dear and its bytes are few
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    surfaces = mentions.select("surface").distinct().repartition(parts, "surface").withColumn("kind", kind_of(F.col("surface")))
    # a part number in the form of an account number is no entity
    surfaces = surfaces.withColumn("kind", F.when((F.col("kind") == "iban") & ~is_account(F.col("surface")), "none").otherwise(F.col("kind")))
    surfaces = Cut(surfaces, "surfaces").df
    others = surfaces.where("kind not in ('name', 'none')").withColumn("canon", canonical(F.col("kind"), F.col("surface")))
    others = Cut(others, "canonical").df
    known = surrogates(others.select("kind", "canon").distinct().repartition(parts, "kind", "canon"), key)
    found = others.join(Cut(known, "surrogates").df, ["kind", "canon"]).select("surface", rendered(F.col("kind"), F.col("surface"), F.col("surrogate")).alias("put"))
    found = found.union(_names(surfaces.where("kind = 'name'").select("surface"), key))
    found = found.withColumn("real", F.lit(1)).union(surfaces.where("kind = 'none'").select("surface", F.col("surface").alias("put"), F.lit(0)))
    found = Cut(found, "rendered").df
    puts = mentions.join(found, "surface").groupBy("_d", "_t").agg(F.sort_array(F.collect_set(F.struct("_i", "put", "real"))).alias("_all"))
    puts = puts.select("_d", "_t", F.col("_all.put").alias("_put"), F.aggregate("_all.real", F.lit(0), lambda a, x: a + x).alias("_n"))
    keyed = some.withColumn("_tk", F.xxhash64("text"))
    joined = keyed.join(puts, F.col("doc_id").eqNullSafe(F.col("_d")) & (F.col("_tk") == F.col("_t")))
    gaps = F.split("text", ANY, -1)
    text = F.array_join(F.transform(gaps, lambda g, i: F.concat(g, F.coalesce(F.get("_put", i), F.lit("")))), "")
    changed = joined.select(*[text.alias("text") if c == "text" else F.col(c) for c in own], F.col("_n").alias("n_entities"))
    return plain.unionByName(changed)
