"""Surrogate generation for personal data, in DataFrame and SQL functions only.

1. One pattern finds candidates in whole texts; checks that a pattern can't make (Luhn, issuer, modulo 97) decide what is an entity.
2. Entities are reduced to a canonical form (an e-mail address without case, a phone number with its country code), so that mentions of one
   thing share one surrogate: coreference holds across spellings, documents and runs.
3. A form is a frame that stays (prefix of a key, country code, issuer, country, top-level domain, first octet) and a body. The
   body's characters, each within its own alphabet (digits, or the letters of one script), go through a keyed permutation of all bodies of
   that shape: a Feistel network, a shift of every character, and the network backwards. No body stays as it is, and no two meet. Check digits
   are made anew. Names are drawn from lists of their gender and script, surnames from syllables.
4. Surrogates are checked over the whole corpus: one that is another entity's surrogate, or is itself an entity of the corpus, is
   drawn again with the next key, names with one syllable more, until all are distinct and new. A body's shape of which the corpus holds over
   a quarter of all values has too few new ones: there the permutation's values stay, which are distinct, and none of them its own.
5. Surrogates are written back in the spelling of each mention. Only documents with candidates are shuffled.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .storage import Scratch, spread_join

#: Titles by gender and script; the surrogate keeps the title and draws names from the lists of its gender and script.
TITLES = {
    ("f", "latin"): ["Mrs", "Ms", "Miss", "Madame", "Mme", "Mademoiselle", "Mlle", "Frau", "Señora", "Sra", "Señorita", "Srta"],
    ("m", "latin"): ["Mr", "Monsieur", "Herr", "Señor", "Sr"],
    ("f", "cyrillic"): ["Госпожа", "Г-жа"],
    ("m", "cyrillic"): ["Господин", "Г-н"],
}
GIVEN = {
    ("f", "latin"): ["Alma", "Berta", "Clara", "Dora", "Elsa", "Flora", "Greta", "Hanna", "Irma", "Julia", "Karla", "Lena", "Marta", "Nora", "Olga", "Paula"],
    ("m", "latin"): ["Adam", "Bruno", "Conrad", "David", "Emil", "Felix", "Georg", "Hugo", "Ivan", "Jonas", "Karl", "Leon", "Martin", "Noel", "Oscar", "Paul"],
    ("f", "cyrillic"): ["Анна", "Вера", "Дарья", "Елена", "Жанна", "Зоя", "Ирина", "Клара", "Лариса", "Мария", "Нина", "Ольга", "Полина", "Раиса", "Софья", "Тамара"],
    ("m", "cyrillic"): ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Захар", "Игорь", "Кирилл", "Леонид", "Максим", "Никита", "Олег", "Павел", "Роман", "Степан"],
}
#: A surname is a chain of syllables and an ending, so that there are far more than names to be replaced.
SYLLABLES = {
    "latin": ["bar", "cor", "del", "fen", "gal", "hol", "jan", "kel", "lor", "mar", "nol", "per", "rol", "sal", "tor", "ven"],
    "cyrillic": ["бар", "вол", "гор", "дол", "жар", "зор", "кол", "лор", "мар", "нов", "пол", "рад", "сол", "тор", "фед", "яр"],
}
ENDINGS = {("f", "latin"): "en", ("m", "latin"): "en", ("f", "cyrillic"): "ова", ("m", "cyrillic"): "ов"}
_TITLE = "|".join(sorted((t for ts in TITLES.values() for t in ts), key=len, reverse=True))

#: Lower-case words that belong to the capitalised word after them: these anywhere in a name, articles only at its begin or after these.
_ARTICLES = "der|den|dem|het|'t|\u2019t|zu|zum|zur|la|las|los|le|lo"
_PARTICLES = rf"(?:van|von und zu|von|vom|de|del|della|di|da|do|dos|du|des|ter|ten|te|af|av|bin|bint|ibn|ben|al|el|y|e|St\.|Ste\.)(?: (?:{_ARTICLES}))?"
#: Kept with the title.
_DEGREES = r"(?:(?:Dr|Prof)\.? ){0,3}"
#: What follows a capital inside a word: letters, and hyphens and apostrophes with what they join, but no English clitics.
_JOINED = r"(?:['\u2019\u2010\u2011-](?!(?i:s|d|ll|ve|re|m)(?![\p{L}\p{M}]))[\p{L}\p{M}]++)"
_WORD = rf"(?:(?:d|l|dell|dall|t|o)['\u2019]|(?:al|el|ad|as|an|ar|ul|ibn|ben|bin|abd)-)?\p{{Lu}}(?:[\p{{L}}\p{{M}}]++{_JOINED}*+|{_JOINED}++)"
#: A part of a name: initials, particles, and a word. A further part is no other title and no "Jr".
_PART = r"(?:\p{{Lu}}(?:\.[ -]?| )){{0,6}}(?:" + _PARTICLES.replace("{", "{{").replace("}", "}}") + r" ){{0,3}}{stop}" + _WORD.replace("{", "{{").replace("}", "}}")
_STOP = rf"(?!(?:{_TITLE}|Jr|Jnr|II|III|IV)(?![\p{{L}}\p{{N}}]))"

OCTET = r"(?:25[0-5]|2[0-4]\d|1?\d?\d)"
#: What is looked for, in order of preference where candidates begin at the same place.
PATTERNS = {
    "email": r"(?<![\p{L}\p{N}._%+-])[\p{L}\p{N}._%+-]{1,64}+@(?:[\p{L}\p{N}-]{1,63}\.){1,8}\p{L}{2,24}",
    "secret": r"\b(?i:token|secret|password|passwd|pwd|api[_-]?key|access[_-]?key)[\"']?\s{0,3}[=:]\s{0,3}[\"']?[A-Za-z0-9+/_.=-]{8,}+",
    "key": r"\b(?:AKIA[0-9A-Z]{16}|gh[opsu]_[A-Za-z0-9]{36}|sk-[A-Za-z0-9]{20,}+)\b",
    "iban": r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?\b",
    "mac": r"\b[0-9A-Fa-f]{2}(?::[0-9A-Fa-f]{2}){5}\b",
    "ip": rf"(?<![\d.])(?:{OCTET}\.){{3}}{OCTET}(?!\.?\d)",
    "ssn": r"(?<![\d-])\d{3}-\d{2}-\d{4}(?![\d-])",
    "phone": r"(?<![\d+])\+\d{1,3}[ .-]?(?:\(\d{1,4}\)|\d{1,4})(?:[ .-]?\d{2,4}){2,4}(?!\d)|(?<!\d)\(\d{3}\) ?\d{3}[ .-]\d{4}(?!\d)|(?<![\d.-])\d{3}[.-]\d{3}[.-]\d{4}(?![\d-])",
    "card": r"(?<!\d)(?:\d{4}(?:[ -]\d{4}){3}|\d{4}[ -]\d{6}[ -]\d{5}|\d{13,19})(?!\d)",
    "name": rf"(?<![\p{{L}}\p{{N}}])(?:{_TITLE})\.? {_DEGREES}(?:(?:{_ARTICLES}) )?{_PART.format(stop='')}(?: {_PART.format(stop=_STOP)})*+",
}
PATTERN = "|".join(f"(?:{p})" for p in PATTERNS.values())
#: What can be without any digit and @.
WORDED = "|".join(f"(?:{PATTERNS[p]})" for p in ("secret", "key", "mac", "name"))
#: Lower-case alphabets, (first code point, letters, step) each; a character is replaced by one of its own alphabet. Other letters stay.
ALPHABETS = [
    (0x30, 10, 1), (0x61, 26, 1), (0xE0, 23, 1), (0xF8, 8, 1), (0x101, 28, 2), (0x13A, 8, 2), (0x14B, 23, 2), (0x17A, 3, 2),  # digits, Latin
    (0x3AC, 4, 1), (0x3B1, 25, 1), (0x3CA, 5, 1), (0x430, 48, 1), (0x561, 38, 1), (0x10D0, 43, 1),  # Greek, Cyrillic, Armenian, Georgian
    (0x5D0, 27, 1), (0x621, 26, 1), (0x641, 10, 1), (0x905, 53, 1), (0xE01, 46, 1),  # Hebrew, Arabic, Devanagari, Thai
    (0x3041, 86, 1), (0x30A1, 90, 1), (0x4E00, 20992, 1), (0xAC00, 11172, 1),  # kana, Han, Hangul
]
HEX = "0123456789abcdef"
#: Rounds of the Feistel network, in each direction.
ROUNDS = 4
#: A shape of which the corpus holds this share of all values is crowded.
CROWDED = 0.25
#: Country calling codes (fixed values): one digit, two digits; all others have three.
CALLING = r"1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|\d{3}"


def _s(text: str) -> Column:
    return F.lit(text)


def _number(bits: Column, at: Column) -> Column:
    """The number in 4 hex digits at a position."""
    return F.conv(F.substr(bits, at, F.lit(4)), 16, 10).cast("int")


def stream(key: str, *parts: Column) -> Column:
    """128 hex digits that depend on the key and the parts."""
    return F.sha2(F.concat_ws("\x1f", F.lit(key), *parts), 512)


def _alphabet(c: Column, hexadecimal: Column) -> Column:
    """first, size and step of a character's alphabet; of a size of 1 for what stays."""
    at = F.ascii(c)  # the code point
    kind = lambda first, size, step: F.struct(F.lit(first).alias("first"), F.lit(size).alias("size"), F.lit(step).alias("step"))
    out = F.when(hexadecimal & c.rlike("[0-9a-f]"), kind(-1, 16, 1))
    for first, size, step in ALPHABETS:
        inside = at.between(first, first + (size - 1) * step)
        out = out.when(inside if step == 1 else inside & ((at - first) % step == 0), kind(first, size, step))
    return out.otherwise(kind(0, 1, 1))


def permuted(places: Column, sizes: Column, key: str, *tweak: Column) -> Column:
    """A keyed permutation, without a fixed point, of all arrays of numbers below the given sizes."""
    n, half = F.size(places), F.floor(F.size(places) / 2).cast("int")
    left, right = (lambda a: F.slice(a, F.lit(1), half)), (lambda a: F.slice(a, half + 1, n - half))
    own = lambda k: F.when(k % 2 == 0, left(sizes)).otherwise(right(sizes))

    def moved(a: Column, most: Column, bits: Column, sign: int) -> Column:
        one = lambda b, m: F.transform(a, lambda x, i: F.pmod(x + sign * _number(b, F.pmod(i * 4, F.lit(128)) + 1), m[i]))
        # both are evaluated once, not for each element
        return F.transform(F.array(F.struct(bits.alias("b"), most.alias("m"))), lambda v: one(v["b"], v["m"]))[0]

    bits = lambda k, other: stream(key, *tweak, k.cast("string"), F.array_join(other.cast("array<string>"), ","))
    pair = lambda a, b: F.struct(a.alias("a"), b.alias("b"))
    steps = F.sequence(F.lit(0), F.lit(ROUNDS - 1))
    there = lambda v, k: pair(v["b"], moved(v["a"], own(k), bits(k, v["b"]), 1))
    back = lambda v, k: pair(moved(v["b"], own(k), bits(k, v["a"]), -1), v["a"])
    middle = stream(key, _s("middle"), *tweak)

    def shifted(a: Column) -> Column:
        one = lambda b: F.transform(F.arrays_zip(a.alias("x"), sizes.alias("m")), lambda v, i: F.when(v["m"] == 1, 0).otherwise(F.pmod(v["x"] + 1 + F.pmod(_number(b, F.pmod(i * 4, F.lit(128)) + 1), F.greatest(v["m"] - 1, F.lit(1))), v["m"])))
        return F.transform(F.array(middle), one)[0]

    first = F.aggregate(steps, pair(left(places), right(places)), there, lambda v: F.concat(v["a"], v["b"]))
    turned = F.transform(F.array(first), shifted)
    last = F.transform(turned, lambda a: F.aggregate(F.reverse(steps), pair(left(a), right(a)), back, lambda v: F.concat(v["a"], v["b"])))
    return last[0]


def luhn_sum(digits: Column) -> Column:
    """The Luhn sum of a digit string; 0 modulo 10 is valid."""

    def one(c: Column, i: Column) -> Column:
        d = c.try_cast("int") * (F.pmod(i, F.lit(2)) + 1)
        return d - F.when(d > 9, 9).otherwise(0)

    return F.aggregate(F.transform(F.split(F.reverse(digits), ""), one), F.lit(0), lambda a, x: a + x)


def rest_97(text: Column) -> Column:
    """Digits and lower-case letters (a is 10) as one number modulo 97."""
    value = lambda c: F.when(c.rlike("[0-9]"), F.ascii(c) - 48).otherwise(F.ascii(c) - 87)
    return F.aggregate(F.split(text, ""), F.lit(0), lambda a, c: F.pmod(a * F.when(c.rlike("[0-9]"), 10).otherwise(100) + value(c), F.lit(97)))


def classify(e: Column) -> Column:
    """The type of a candidate, null if it is none after all."""
    digits = F.regexp_replace(e, r"\D", "")
    issuer = r"^(?:4\d{12}(?:\d{3}){0,2}|5[1-5]\d{14}|2[2-7]\d{14}|3[47]\d{13}|3[0689]\d{12}|35\d{14}|6(?:011|5\d\d)\d{12})$"
    out = None
    for name, pattern in PATTERNS.items():
        # lookarounds hold at the ends of the string
        found = e.rlike(f"^(?:{pattern})$")
        if name == "card":
            # other long numbers are left alone
            found = found & digits.rlike(issuer) & (luhn_sum(digits) % 10 == 0)
        if name == "iban":
            bare = F.lower(F.regexp_replace(e, " ", ""))
            found = found & (rest_97(F.concat(F.substr(bare, F.lit(5), F.length(bare)), F.substring(bare, 1, 4))) == 1)
        out = F.when(found, F.lit(name)) if out is None else out.when(found, F.lit(name))
    return out


SECRET_VALUE = r"^[^=:]*[=:]\s{0,3}[\"']?([A-Za-z0-9+/_.=-]{8,}+)$"
NAME_PARTS = rf"^(({_TITLE})\.? {_DEGREES})(.*)$"


def _phone(e: Column) -> Column:
    """"+code number"; the forms without a country code are those of code 1."""
    digits = F.regexp_replace(e, r"\D", "")
    return F.when(e.startswith("+"), F.regexp_replace(digits, rf"^({CALLING})", "+$1 ")).otherwise(F.concat(_s("+1 "), digits))


def canonical(kind: Column, e: Column) -> Column:
    """What mentions of one entity have in common."""
    bare = F.lower(F.regexp_replace(e, r"[^\p{L}\p{N}]", ""))
    title = F.regexp_extract(e, NAME_PARTS, 2)
    # without particles and in one case, so that spellings of a name agree
    name = F.initcap(F.regexp_replace(F.regexp_extract(e, NAME_PARTS, 3), rf"(?:^|(?<= ))(?:{_PARTICLES}|{_ARTICLES}) ", ""))
    gender = F.when(title.isin([t for (g, _), ts in TITLES.items() if g == "f" for t in ts]), "f").otherwise("m")
    return (
        F.when(kind == "email", F.lower(e))
        .when(kind == "phone", _phone(e))
        .when(kind == "secret", F.regexp_extract(e, SECRET_VALUE, 1))
        .when(kind.isin("key", "ip"), e)
        .when(kind == "name", F.concat_ws(" ", gender, name))
        .otherwise(bare)
    )


#: What stays at the begin of a form, by kind; the last digit of cards and the check digits of IBANs are made anew.
FRAMES = {
    "domain": "^", "email": "^", "secret": "^", "key": "^(?:AKIA|gh[opsu]_|sk-)", "iban": "^[a-z]{2}", "mac": "^", "ssn": "^", "phone": r"^\+\d+ \d",
    "ip": r"^(?:192\.168\.|172\.(?:1[6-9]|2\d|3[01])\.|169\.254\.|\d+\.)", "card": r"^(?:4|5\d|3[47]|\d{4})",
}


def draw(forms: DataFrame, key: str) -> DataFrame:
    """Adds surrogate, shape (a number for what stays of a form) and room (the logarithm of the number of forms of that shape).

    forms: kind, form, attempt and place (the surrogate of an address's domain, else null).
    """
    kind, form = F.col("kind"), F.col("form")
    frame = None
    for name, pattern in FRAMES.items():
        frame = (F.when if frame is None else frame.when)(kind == name, F.regexp_extract(form, pattern, 0))
    top = F.concat(_s("."), F.substring_index(form, ".", -1))
    split = forms.withColumn("_frame", F.coalesce(frame, _s(""))).withColumn("_tail", F.when(kind == "domain", top).when(kind == "email", F.concat(_s("@"), F.substring_index(form, "@", -1))).otherwise(""))
    rest = F.substr(form, F.length("_frame") + 1, F.length(form) - F.length("_frame") - F.length("_tail"))
    rest = F.when(kind == "card", F.substr(rest, F.lit(1), F.length(rest) - 1)).when(kind == "iban", F.substr(rest, F.lit(3), F.length(rest))).otherwise(rest)
    split = split.withColumn("_body", F.when(kind != "name", rest))
    is_hex = (kind == "mac") | (kind.isin("secret", "key") & F.col("_body").rlike("^[0-9a-fA-F]{16,}$"))
    octets = kind == "ip"
    split = split.withColumn("_chars", F.when(octets, F.split("_body", r"\.")).otherwise(F.split(F.lower("_body"), "")))
    octet = F.struct(F.lit(-2).alias("first"), F.lit(256).alias("size"), F.lit(1).alias("step"))
    split = split.withColumn("_hex", is_hex).withColumn("_kinds", F.when(octets, F.transform("_chars", lambda c: octet)).otherwise(F.transform("_chars", lambda c: _alphabet(c, F.col("_hex")))))
    number = lambda c, k: F.when(k["first"] == -2, c.try_cast("int")).when(k["first"] == -1, F.instr(_s(HEX), c) - 1).when(k["size"] == 1, 0).otherwise(((F.ascii(c) - k["first"]) / k["step"]).cast("int"))
    split = split.withColumn("_places", F.zip_with("_chars", "_kinds", number)).withColumn("_sizes", F.transform("_kinds", lambda k: k["size"]))
    split = split.withColumn("_new", permuted(F.col("_places"), F.col("_sizes"), key, kind, F.col("_frame"), F.col("_tail"), F.col("attempt").cast("string")))
    letter = lambda at: F.decode(F.unhex(F.lpad(F.hex(at), 4, "0")), "UTF-16BE")
    again = lambda v: F.when(v["k"]["first"] == -2, v["n"].cast("string")).when(v["k"]["first"] == -1, F.substr(_s(HEX), v["n"] + 1, F.lit(1))).when(v["k"]["size"] == 1, v["c"]).otherwise(letter(v["k"]["first"] + v["n"] * v["k"]["step"]))
    zipped = F.arrays_zip(F.col("_new").alias("n"), F.col("_kinds").alias("k"), F.col("_chars").alias("c"))
    made = F.transform(zipped, again)
    split = split.withColumn("_made", F.when(octets, F.array_join(made, ".")).otherwise(F.array_join(made, "")))
    whole, body = F.concat("_frame", "_made"), F.col("_made")
    check = F.pmod(F.lit(10) - luhn_sum(F.concat(whole, _s("0"))) % 10, F.lit(10)).cast("string")
    checks = F.lpad((F.lit(98) - rest_97(F.concat(body, F.col("_frame"), _s("00")))).cast("string"), 2, "0")
    surrogate = (
        F.when(kind == "name", _name(form, F.col("attempt"), key)).when(kind == "email", F.concat(body, _s("@"), F.col("place"))).when(kind == "domain", F.concat(body, F.col("_tail")))
        .when(kind == "card", F.concat(whole, check)).when(kind == "iban", F.concat("_frame", checks, "_made")).when(kind.isin("secret", "key"), F.concat("_frame", _recase(body, F.col("_body")))).otherwise(whole)
    )
    room = F.when(kind == "name", F.lit(float("inf"))).otherwise(F.aggregate("_sizes", F.lit(0.0), lambda a, n: a + F.log(n)))
    shape = F.xxhash64("kind", "_frame", "_tail", F.transform("_kinds", lambda k: k["first"]), F.transform(F.arrays_zip("_kinds", "_chars"), lambda v: F.when(v["_kinds"]["size"] == 1, v["_chars"])))
    return split.withColumns({"surrogate": surrogate, "shape": shape, "room": room}).select(*forms.columns, "surrogate", "shape", "room")


def _recase(text: Column, like: Column) -> Column:
    """Upper case where ``like`` has it; both have the same length."""
    mixed = F.array_join(F.zip_with(F.split(text, ""), F.split(like, ""), lambda t, m: F.when(F.lower(m) != m, F.upper(t)).otherwise(t)), "")
    return F.when(F.upper(like) == like, F.upper(text)).when(F.lower(like) == like, text).otherwise(mixed)


def _name(form: Column, attempt: Column, key: str) -> Column:
    """Names of a form "gender [name ...] name": the last is the surname, which is drawn by itself, as is each given name."""
    gender, rest = F.substring(form, 1, 1), F.substr(form, F.lit(3), F.length(form))
    parts = F.split(rest, " ")
    script = F.when(rest.rlike(r"\p{IsCyrillic}"), "cyrillic").otherwise("latin")
    last = F.element_at(parts, -1)
    cyrillic_root = F.regexp_replace(last, "(?:ова|ев|ева|ов|ин|ина)$", "")
    root = F.when(script == "cyrillic", cyrillic_root).otherwise(last)

    def out(g: str, s: str) -> Column:
        # a name that collides grows, so that there are always enough
        syllable = lambda k: F.element_at(F.array(*map(F.lit, SYLLABLES[s])), F.pmod(_number(stream(key, _s("surname"), root, attempt.cast("string"), k.cast("string")), F.lit(1)), F.lit(16)) + 1)
        surname = F.concat(F.initcap(F.array_join(F.transform(F.sequence(F.lit(0), attempt + 2), syllable), "")), F.lit(ENDINGS[g, s]))
        names = F.array(*map(F.lit, GIVEN[g, s]))

        def one(part: Column) -> Column:
            n = F.pmod(F.conv(F.substring(stream(key, _s("given"), _s(g), part), 1, 4), 16, 10).cast("int"), F.lit(16))
            # the next of the list that isn't in the name itself
            turned = F.concat(F.slice(names, n + 1, F.lit(16)), F.slice(names, F.lit(1), n))
            return F.coalesce(F.try_element_at(F.array_except(turned, parts), F.lit(1)), F.element_at(turned, 1))

        given = F.transform(F.slice(parts, F.lit(1), F.size(parts) - 1), one)
        return F.array_join(F.concat(given, F.array(surname)), " ")

    names = None
    for (g, s) in GIVEN:
        here = (gender == g) & (script == s)
        names = F.when(here, out(g, s)) if names is None else names.when(here, out(g, s))
    return F.concat_ws(" ", gender, names)


def render(kind: Column, e: Column, form: Column, surrogate: Column) -> Column:
    """The surrogate in a mention's own spelling: its punctuation, its case, its prefix."""
    chars = F.split(e, "")
    # the surrogate's letters and digits take the places of the mention's, from the right
    source = F.regexp_replace(surrogate, r"[^\p{L}\p{N}]", "")
    count = F.length(F.regexp_replace(e, r"[^\p{L}\p{N}]", ""))

    def place(c: Column, i: Column) -> Column:
        before = F.length(F.regexp_replace(F.substr(e, F.lit(1), i + 1), r"[^\p{L}\p{N}]", ""))
        at = before - (count - F.length(source))
        new = F.substr(source, at, F.lit(1))
        return F.when(c.rlike(r"[^\p{L}\p{N}]") | (at < 1), c).when(F.lower(c) != c, F.upper(new)).otherwise(new)

    spelt = F.array_join(F.transform(chars, place), "")
    prefixed = F.concat(F.substr(e, F.lit(1), F.length(e) - F.length(form)), surrogate)
    titled = F.concat(F.regexp_extract(e, NAME_PARTS, 1), F.substr(surrogate, F.lit(3), F.length(surrogate)))
    return F.when(kind == "secret", prefixed).when(kind.isin("ip", "key"), surrogate).when(kind == "name", titled).otherwise(spelt)


def resolve(forms: DataFrame, key: str, s: Scratch) -> DataFrame:
    """(kind, form, surrogate): distinct and new surrogates of settled forms (kind, form, place).

    Every round draws those again that collide; as at most half of a shape's values are taken, each round settles half of them or more, and names
    have a longer surname in each.
    """
    n = forms.count()
    drawn = draw(forms.withColumn("attempt", F.lit(0)), key)
    first = s.settle(drawn, "first", n, 50_000)
    few = first.where(F.col("room") <= math.log(max(n, 1) / CROWDED)).groupBy("kind", "shape").agg(F.count("*").alias("m"), F.max("room").alias("room"))
    crowded = s.settle(few.where(F.log(F.col("m") / CROWDED) >= F.col("room")).select("kind", "shape", "m", F.lit(True).alias("crowded")), "crowded")
    drawn = s.settle(spread_join(first.drop("room"), crowded, ["kind", "shape"], "m", n, "left").drop("shape"), "drawn", n, 50_000)
    s.drop(first, crowded)
    while True:
        values = drawn.select("kind", F.col("surrogate").alias("value"), "form").unionByName(drawn.select("kind", F.col("form").alias("value"), F.lit(None).cast("string").alias("form")))
        met = values.groupBy("kind", "value").agg(F.min("form").alias("owner"), F.count("form").alias("k"), F.count("*").alias("all"))
        met = met.where("k > 1 or k = 1 and all > k").select("kind", F.col("value").alias("surrogate"), "owner", (F.col("all") > F.col("k")).alias("real"))
        todo = drawn.join(met, ["kind", "surrogate"]).where("crowded is null and (real or owner <> form)").select("kind", "form", "place", (F.col("attempt") + 1).alias("attempt"), "crowded")
        todo = s.settle(todo, "todo")
        if todo.isEmpty():
            s.drop(todo)
            return drawn.select("kind", "form", "surrogate")
        again = s.settle(draw(todo, key).drop("shape", "room"), "again")
        old, drawn = drawn, s.settle(drawn.join(again.select("kind", "form"), ["kind", "form"], "left_anti").unionByName(again), "drawn", n, 50_000)
        s.drop(old, todo, again)


def dictionary(mentions: DataFrame, key: str, s: Scratch) -> DataFrame:
    """(e, new, n) of every distinct mention that is an entity: the surrogate in its spelling, and how often it is there."""
    kinds = mentions.groupBy("e").agg(F.count("*").alias("n")).withColumn("kind", classify(F.col("e"))).where("kind is not null")
    kinds = s.settle(kinds.withColumn("form", canonical(F.col("kind"), F.col("e"))), "mentions")
    forms = kinds.select("kind", "form").distinct()
    forms = s.settle(forms.withColumn("domain", F.when(F.col("kind") == "email", F.substring_index("form", "@", -1))), "forms")
    # an address's domain has a surrogate of its own: two people at one place stay at one place
    domains = s.settle(forms.where("domain is not null").groupBy("domain").agg(F.count("*").alias("n")), "domains")
    places = resolve(s.settle(domains.select(F.lit("domain").alias("kind"), F.col("domain").alias("form"), F.lit(None).cast("string").alias("place")), "domain-forms"), key, s)
    places = s.settle(domains.join(places.select(F.col("form").alias("domain"), F.col("surrogate").alias("place")), "domain"), "places")
    total = places.agg(F.sum("n")).first()[0] or 0
    placed = spread_join(forms.where("domain is not null"), places, "domain", "n", total).select("kind", "form", "place")
    forms = s.settle(placed.unionByName(forms.where("domain is null").select("kind", "form", F.lit(None).cast("string").alias("place"))), "placed")
    drawn = resolve(forms, key, s)
    out = kinds.join(drawn, ["kind", "form"])
    return s.settle(out.select("e", render(F.col("kind"), F.col("e"), F.col("form"), F.col("surrogate")).alias("new"), "n"), "dictionary")


def replace(docs: DataFrame, key: str, text: str = "text", count: str = "n_entities") -> DataFrame:
    """The documents with every entity's surrogate in its place, and the number of replaced mentions.

    All other columns are kept as they are, whatever their names; a column named like ``count`` is replaced. Null and empty texts, and texts
    without entities, stay as they are, with 0 mentions; long texts are searched whole. Repeated rows are treated alike, each by itself. An empty
    table stays empty. The result depends on the key and the set of entities, not on order or partitions.
    """
    s = Scratch(docs.sparkSession)
    docs = docs.drop(count)
    columns = docs.columns
    # most patterns need a digit or an @: texts without either are only searched for the others
    found = F.when(F.col(text).rlike("[0-9@]"), F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))).otherwise(F.regexp_extract_all(text, F.lit(WORDED), F.lit(0)))
    # one pass of the pattern over the corpus, whose result is written down with the rows; that fixes the ids too
    marked = docs.select(F.struct(*columns).alias("row"), found.alias("found")).withColumn("found", F.when(F.size("found") > 0, F.col("found")))
    marked = s.settle(marked.withColumn("id", F.monotonically_increasing_id()), "marked")
    clean = marked.where("found is null").select("row.*").withColumn(count, F.lit(0).cast("long"))
    found = marked.where("found is not null")
    mentions = found.select("id", F.posexplode("found").alias("at", "e"))
    known = dictionary(mentions, key, s)
    total = known.agg(F.sum("n")).first()[0] or 0
    placed = spread_join(mentions, known, "e", "n", total).groupBy("id").agg(F.map_from_entries(F.collect_list(F.struct("at", "new"))).alias("new"))
    rebuilt = found.join(placed, "id", "left")
    pieces = F.split(F.col("row")[text], PATTERN, -1)
    mention = F.transform("found", lambda e, i: F.coalesce(F.col("new")[i], e))
    joined = F.array_join(F.zip_with(pieces, mention, lambda p, m: F.concat(p, F.coalesce(m, F.lit("")))), "")
    rebuilt = rebuilt.select(
        *(joined.alias(c) if c == text else F.col("row")[c].alias(c) for c in columns),
        F.when(F.col("new").isNotNull(), F.size("new")).otherwise(0).cast("long").alias(count),
    )
    return clean.unionByName(rebuilt)
