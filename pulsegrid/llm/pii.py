"""Surrogates for personal data: keyed, type-consistent, format-preserving, distinct and coreferent.

DataFrame expressions only.  A surrogate is a function of the key, the type
and the canonical form of an entity, so all mentions in all documents get the
same one without a join.  It is a keyed permutation of the values of the
entity's own format, so distinct entities stay distinct by construction,
however densely a format is used.  Only given names, which come from short
lists to show a gender, can meet: the distinct persons are aggregated, those
whose full names would meet are numbered, and this small table is joined to the
documents that mention them.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import lru_cache

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from pulsegrid.llm.common import materialise

#: Titles by gender, and given names by gender and script.
TITLES = {
    "m": ["Mr", "Sir", "Herr", "Señor", "Sr", "Monsieur", "господин"],
    "f": ["Mrs", "Ms", "Miss", "Madam", "Frau", "Señora", "Sra", "Madame", "Mme", "госпожа"],
    "n": ["Dr", "Prof", "Mx", "доктор"],
}
GIVEN = {
    ("m", "latin"): ["Adam", "Bruno", "Carl", "David", "Emil", "Felix", "Gabriel", "Hugo", "Ivan", "Jonas", "Karl", "Leon", "Martin", "Noah", "Oscar", "Paul"],
    ("f", "latin"): ["Alice", "Bella", "Clara", "Diana", "Elena", "Flora", "Greta", "Helena", "Irene", "Julia", "Klara", "Laura", "Maria", "Nora", "Olivia", "Paula"],
    ("n", "latin"): ["Alex", "Ariel", "Casey", "Dana", "Eden", "Jamie", "Jordan", "Kim", "Morgan", "Noel", "Quinn", "Robin", "Sam", "Sasha", "Taylor", "Toni"],
    ("m", "cyrillic"): ["Антон", "Борис", "Виктор", "Глеб", "Денис", "Егор", "Захар", "Игорь", "Кирилл", "Лев", "Максим", "Никита", "Олег", "Павел", "Роман", "Степан"],
    ("f", "cyrillic"): ["Алла", "Вера", "Галина", "Дарья", "Елена", "Жанна", "Зоя", "Инна", "Кира", "Лидия", "Мария", "Нина", "Ольга", "Полина", "Раиса", "София"],
    ("m", "greek"): ["Αλέξης", "Βασίλης", "Γιώργος", "Δημήτρης", "Ηλίας", "Θανάσης", "Κώστας", "Λευτέρης", "Μάριος", "Νίκος", "Ορέστης", "Πέτρος", "Σπύρος", "Τάσος", "Φώτης", "Χρήστος"],
    ("f", "greek"): ["Άννα", "Βάσω", "Γεωργία", "Δήμητρα", "Ελένη", "Ζωή", "Ιωάννα", "Κατερίνα", "Λίνα", "Μαρία", "Νίκη", "Ουρανία", "Πηνελόπη", "Ρένα", "Σοφία", "Χριστίνα"],
    ("n", "greek"): ["Άλεξ", "Άρια", "Βάλια", "Γιάννι", "Έλλη", "Ζήνα", "Ηρώ", "Θάλεια", "Ίρις", "Κλειώ", "Λήδα", "Μέλπω", "Νέλλη", "Ρούλα", "Τόνι", "Χάρις"],
    ("n", "cyrillic"): ["Валя", "Женя", "Саша", "Слава", "Шура", "Паша", "Вася", "Гера", "Лера", "Миша", "Никки", "Рома", "Сима", "Тоша", "Юра", "Ян"],
}
#: Letters that take each other's place: digits, hex digits, letters by case, and vowels and consonants of names by script.
DIGITS, LETTERS, HEX = "0123456789", "abcdefghijklmnopqrstuvwxyz", "abcdef"
VOWELS, CONSONANTS = "aeiouy", "bcdfghjklmnpqrstvwxz"
ACCENTED = "áàâäéèêëíìîïóòôöúùûü"
MARKED = "ñçøåæœłęćąśźżńőűčšžěřůğşđ"
CYRILLIC_VOWELS, CYRILLIC_CONSONANTS = "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщ"
GREEK, GREEK_ACCENTED = "αβγδεζηθικλμνξοπρστυφχψω", "άέήίόύώ"
OTHERS = [ACCENTED, MARKED, CYRILLIC_VOWELS, CYRILLIC_CONSONANTS, GREEK, GREEK_ACCENTED]
#: What takes each other's place in a secret without any letter or digit.
PUNCTUATION = "!$%&()*+-./<>?@[]^_{|}~#"


@lru_cache(maxsize=1)
def letter_classes() -> list[list[tuple[int, int, int]]]:
    """All other letters and digits, by script, category and whether upper and lower case lead to each other: runs (first code, step, number) of each class.

    The script is the first word of a character's name.  Classes of one
    character are taken together.
    """
    known = set(DIGITS + "".join(a + a.upper() for a in (LETTERS, *OTHERS)))
    classes: dict[tuple, list[int]] = {}
    for code in range(128, sys.maxunicode + 1):
        c = chr(code)
        kind_ = unicodedata.category(c)
        if kind_[0] in "LN" and c not in known:
            other = c.upper() if kind_ == "Ll" else c.lower()
            paired = kind_ not in ("Ll", "Lu") or len(other) == 1 and (other.lower() if kind_ == "Ll" else other.upper()) == c
            classes.setdefault((unicodedata.name(c, "?").split()[0], kind_, paired), []).append(code)
    alone = [codes[0] for codes in classes.values() if len(codes) == 1]
    out = []
    for codes in [c for c in classes.values() if len(c) > 1] + [alone]:
        runs, at = [], 0
        while at < len(codes):
            n = {step: next((j for j in range(1, len(codes) - at) if codes[at + j] - codes[at] != j * step), len(codes) - at) for step in (1, 2)}
            step = 1 if n[1] >= n[2] else 2
            runs.append((codes[at], step, n[step]))
            at += n[step]
        out.append(runs)
    return out


@lru_cache(maxsize=1)
def _class_tables() -> dict[str, str]:
    """letter_classes() as SQL arrays: of each run its first and last code, step, class and offset; runs by the upper bits of codes; first run, number of runs and size of each class."""
    runs = [(a, a + step * (n - 1), step, k, sum(r[2] for r in each[:i])) for k, each in enumerate(letter_classes()) for i, (a, step, n) in enumerate(each)]
    blocks: list[list[int]] = [[] for _ in range((max(r[1] for r in runs) >> 8) + 1)]
    for at, (low, high, *_) in enumerate(runs):
        for b in range(low >> 8, (high >> 8) + 1):
            blocks[b].append(at)
    flat = lambda v: f"array({', '.join(map(str, v))})"
    out = {name: flat(column) for name, column in zip(("low", "high", "step", "class", "offset"), zip(*runs))}
    starts, at = [], 0
    for each in letter_classes():
        starts.append(at)
        at += len(each)
    out |= {"start": flat(starts), "runs": flat(map(len, letter_classes())), "size": flat(sum(r[2] for r in each) for each in letter_classes())}
    return out | {"block": "array(" + ", ".join(flat(b) if b else "cast(array() as array<int>)" for b in blocks) + ")"}

_KEY = r"\bAKIA[0-9A-Z]{16}\b|\b[0-9a-fA-F]{32,}\b|\bgh[pousr]_[A-Za-z0-9]{20,}|\bsk-[A-Za-z0-9]{20,}"


def _quoted(q: str) -> str:
    """A value of four characters at least between quotes q, escaped characters counted as one; a key in quotes is left to its own format."""
    return rf"{q}(?!(?:{_KEY}){q})(?!(?:[^{q}\\\n]|\\.){{0,3}}{q})[^{q}\\\n]*+(?:\\.[^{q}\\\n]*+)*+{q}(?![\p{{L}}\p{{N}}])"


#: Fixed formats of the entities, tried in this order.
FORMATS = {
    "email": r"[A-Za-z0-9][A-Za-z0-9._%+-]*@[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+",
    "ip": r"(?<![\d.])(?:\d{1,3}\.){3}\d{1,3}(?!\d|\.\d)",
    "secret": r"(?i:\b(?:password|passwd|pwd|secret|token|api_?key|access_?key)\b[\"']?\s{0,2}[=:]\s{0,2})(?:" + _quoted('"') + "|" + _quoted("'") + rf"|(?:[\"'](?!{_KEY}))?[^\s\"',;]{{4,}})",
    "key": _KEY,
    "phone": r"(?<![\d+])\+?(?:\d{1,3}[ .-]?)?\(\d{2,4}\)[ .-]?\d{3,4}[ .-]\d{3,4}(?!\d)|(?<![\d+])\+\d{1,3}(?:[ .-]\d{2,4}){2,4}(?!\d)|(?<![\d.+-])\d{3}[.-]\d{3}[.-]\d{4}(?!\d)",
    "card": r"(?<![\d+])(?:\d{4}[ -]){3}\d{1,7}(?!\d)|(?<![\d+])\d{13,19}(?!\d)",
}
_NAME = r"\p{Lu}[\p{L}'-]+"
_TITLE = "(?:" + "|".join(x for ts in TITLES.values() for t in ts for x in dict.fromkeys((t, t.upper()))) + r")\.? "
FORMATS["person"] = rf"(?<!\p{{L}}){_TITLE}{_NAME}(?: {_NAME})?"
ANY = "|".join(f"(?:{x})" for x in FORMATS.values())
#: What every entity contains, besides "=" or ":" for a secret; other texts are passed over without the full pattern.
#: The look-ahead settles most places of a text by one character.
HINT = r"[0-9@]|(?=[" + "".join(sorted({t[0] for ts in TITLES.values() for t in ts} | {t[0].upper() for ts in TITLES.values() for t in ts})) + r"])" + _TITLE + "|AKIA|gh[pousr]_|sk-|[a-fA-F]{32}"
#: Parts of an assignment: name, sign and opening quote; the value; the closing quote.
_ASSIGNED = r"(?s)^([^=:]*[=:]\s*[\"']?)(.*?)([\"']?)$"


def _bound(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.transform(F.array(value), use)[0]


def kind(e: Column) -> Column:
    """Type of a detected entity: the first format it has."""
    out = F.lit(None).cast("string")
    for k, pattern in reversed(FORMATS.items()):
        out = F.when(e.rlike(f"^(?:{pattern})$"), F.lit(k)).otherwise(out)
    return out


def _gender(title: Column) -> Column:
    of = lambda g: F.lower(title).isin([t.lower() for t in TITLES[g]])
    return F.when(of("m"), "m").when(of("f"), "f").otherwise("n")


def canonical(e: Column, k: Column) -> Column:
    """What mentions of one entity have in common.

    Letter case of e-mail addresses and names, separators of numbers and
    leading zeros of addresses don't count.  A person is the gender of the
    title with all names given: "Mr John Smith" and "Mr Peter Smith" are two,
    and "Mr Smith" names either, as in the original.
    """
    person = F.concat(_gender(F.regexp_extract(e, r"^([^\s.]+)", 1)), F.lit(" "), F.initcap(F.regexp_replace(e, r"^\S+ ", "")))
    return (
        F.when(k == "email", F.lower(e))
        .when(k == "ip", F.array_join(F.transform(F.split(e, r"\."), lambda o: o.cast("int").cast("string")), "."))
        .when(k.isin("card", "phone"), F.regexp_replace(e, r"[^0-9]", ""))
        .when(k == "secret", F.regexp_extract(e, _ASSIGNED, 2))
        .when(k == "person", person)
        .otherwise(e)
    )


# --------------------------------------------------------------- permutations


_STAYS = "struct<v:int,m:int,a:string>"


def _classed(c: Column) -> Column:
    """A character as a place of its letter class, whose name is # and a number; null if it has none."""
    t = {k: F.expr(v) for k, v in _class_tables().items() if k != "runs"}
    code = F.ascii(c)
    runs = F.coalesce(F.get(t["block"], F.shiftright(code, 8)), F.array().cast("array<int>"))
    run = F.get(F.filter(runs, lambda p: (code >= t["low"][p]) & (code <= t["high"][p]) & ((code - t["low"][p]) % t["step"][p] == 0)), F.lit(0))
    place = lambda p: F.struct((t["offset"][p] + F.floor((code - t["low"][p]) / t["step"][p])).cast("int").alias("v"), t["size"][t["class"][p]].alias("m"), F.concat(F.lit("#"), t["class"][p]).alias("a"))
    return _bound(run, lambda p: F.when(p.isNotNull(), place(p)))


def _of_class(a: Column, v: Column) -> Column:
    """The character at a place of a letter class."""
    t = {k: F.expr(x) for k, x in _class_tables().items() if k in ("low", "step", "offset", "start", "runs")}
    k = F.substring(a, 2, 9).cast("int")
    run = F.array_max(F.filter(F.sequence(t["start"][k], t["start"][k] + t["runs"][k] - 1), lambda p: t["offset"][p] <= v))
    code = _bound(run, lambda p: t["low"][p] + (v - t["offset"][p]) * t["step"][p])
    return F.decode(F.unhex(F.lpad(F.hex(code), 8, "0")), "UTF-32")


def _places(s: Column, alphabets: Column, first: Column, last: Column) -> Column:
    """The characters of a string as an array of (v: place in its alphabet a, m: size of a); a character of none of the alphabets and of no letter class, or not from first to last (from 1), is its own."""

    def one(i):
        c = F.substring(s, i, F.lit(1))
        inside = i.between(first, last)
        listed = F.when(inside, F.get(F.filter(alphabets, lambda a: F.call_function("instr", a, c) > 0), F.lit(0)))
        stays = F.struct(F.lit(0).alias("v"), F.lit(1).alias("m"), c.alias("a"))
        plain = lambda a: F.struct((F.call_function("instr", a, c) - 1).alias("v"), F.length(a).alias("m"), a.alias("a"))
        return _bound(listed, lambda a: F.when(a.isNotNull(), plain(a)).when(inside & (F.ascii(c) > 127), F.coalesce(_classed(c), stays)).otherwise(stays))

    return F.when(F.length(s) > 0, F.transform(F.sequence(F.lit(1), F.length(s)), one)).otherwise(F.array().cast(f"array<{_STAYS}>"))


def _text(places: Column) -> Column:
    char = lambda x: F.when((x["m"] > 1) & x["a"].startswith("#"), _of_class(x["a"], x["v"])).otherwise(F.substring(x["a"], x["v"] + 1, F.lit(1)))
    return F.array_join(F.transform(places, char), "")


def permuted(rows: DataFrame, name: str, key: str, rounds: int = 4) -> DataFrame:
    """rows whose column `name`, an array of (places, tweak), becomes an array of the permuted places.

    A keyed permutation, without fixed points, of all arrays of places over the
    same alphabets: an alternating Feistel network whose halves are moved place
    by place, so every place stays in its alphabet and no value leaves its
    format; between it and its inverse every place is moved on by one.  Either
    half holds places that can move; where there is but one such place, it is
    moved on by a keyed number instead of one.  What stays is part of the tweak.
    """

    def digest(x, r, of):
        return F.sha2(F.concat_ws("\x1f", F.lit(key), x["tweak"], F.lit(str(r)), of), 512)

    def moved(part, by, sign=1):
        return F.transform(part, lambda x, i: F.struct(F.pmod(x["v"] + sign * by(i, x["m"]), x["m"]).cast("int").alias("v"), x["m"].alias("m"), x["a"].alias("a")))

    def halves(x):
        free = F.filter(F.transform(x["places"], lambda p, i: F.when(p["m"] > 1, i + 1).otherwise(0)), lambda i: i > 0)
        half = _bound(free, lambda f: F.when(F.size(f) > 1, F.get(f, F.floor(F.size(f) / 2).cast("int") - 1)).otherwise(0))
        stays = F.array_join(F.transform(F.filter(x["places"], lambda p: p["m"] == 1), lambda p: p["a"]), "")
        cut = lambda h: F.struct(F.concat_ws("\x1f", x["tweak"], stays).alias("tweak"), F.slice(x["places"], F.lit(1), h).alias("l"), F.slice(x["places"], h + 1, F.size(x["places"]) - h).alias("r"))
        return _bound(half, cut)

    def turn(r, sign):
        """The right half is moved by the left one in even rounds, the left by the right in odd ones."""
        source, target = ("l", "r") if r % 2 == 0 else ("r", "l")

        def one(x):
            seed = F.array_join(F.transform(x[source], lambda p: p["v"].cast("string")), ",")
            # four hex digits for each of 32 places, and for those beyond the same again, on by seven
            by = lambda d: lambda i, m: F.conv(F.substring(d, F.pmod(i, F.lit(32)).cast("int") * 4 + 1, F.lit(4)), 16, 10).cast("int") + F.floor(i / 32).cast("int") * 7
            new = _bound(digest(x, r, seed), lambda d: moved(x[target], by(d), sign))
            both = {source: x[source], target: new}
            return F.struct(x["tweak"].alias("tweak"), both["l"].alias("l"), both["r"].alias("r"))

        return one

    def on(x):
        alone = F.size(x["l"]) == 0
        keyed = lambda d: lambda i, m: F.when(alone & (m > 2), 1 + F.conv(F.substring(d, 1, 8), 16, 10).cast("long") % (m - 1)).otherwise(1)
        on_ = lambda part: _bound(F.when(alone, digest(x, "one", F.lit(""))), lambda d: moved(part, keyed(d)))
        return F.struct(x["tweak"].alias("tweak"), on_(x["l"]).alias("l"), on_(x["r"]).alias("r"))

    forth = [turn(r, 1) for r in range(rounds)]
    back = [turn(r, -1) for r in reversed(range(rounds))]
    # one projection a step: lambdas nested in each other would be resolved anew for every level
    for step in [halves, *forth, on, *back, lambda x: F.concat(x["l"], x["r"])]:
        rows = rows.withColumn(name, F.transform(name, step))
    return rows


def _sets(*alphabets: str) -> Column:
    return F.array(*map(F.lit, alphabets))


def _alphabets(s: Column) -> Column:
    """Digits for digits and letters for letters by case; hex stays hex; what has neither letters nor digits keeps to punctuation."""
    hexed = (s.rlike("^[0-9a-f]+$") & s.rlike("[a-f]")) | s.rlike("^[0-9a-fA-F]{32,}$")
    plain = [DIGITS, LETTERS, LETTERS.upper()]
    more = [x for a in OTHERS for x in (a, a.upper())]
    return F.when(hexed, _sets(DIGITS, HEX, HEX.upper())).when(s.rlike(r"^\p{ASCII}*[0-9A-Za-z]\p{ASCII}*$"), _sets(*plain)).when(s.rlike(r"[\p{L}\p{N}]"), _sets(*plain, *more)).otherwise(_sets(PUNCTUATION))


def _luhn_sum(digits: Column) -> Column:
    """Luhn sum of a digit string, the last digit counted singly."""
    n = F.length(digits)
    values = F.transform(
        F.sequence(F.lit(1), n),
        lambda i: _bound(
            F.substring(digits, i, F.lit(1)).cast("int") * F.when(F.pmod(n - i, F.lit(2)) == 1, 2).otherwise(1), lambda v: F.when(v > 9, v - 9).otherwise(v)
        ),
    )
    return F.aggregate(values, F.lit(0), lambda a, v: a + v)


def _check_digit(stem: Column) -> Column:
    """The digit that makes stem and it Luhn-valid."""
    return F.pmod(F.lit(10) - F.pmod(_luhn_sum(F.concat(stem, F.lit("0"))), F.lit(10)), F.lit(10))


def _off_check(card: Column) -> Column:
    """How far the last digit is off the check digit of the others: 0 if the number is valid."""
    n = F.length(card)
    return F.pmod(F.substring(card, n, F.lit(1)).cast("int") - _check_digit(F.substring(card, F.lit(1), n - 1)), F.lit(10))


#: Numbers of an address that mean something keep their place; the others of a place take each other's: (numbers left out, in order) for each place.
_FIRST, _AFTER_172, _AFTER_192 = [10, 127, 172, 192], list(range(16, 32)), [168]


def _ip_places(canon: Column) -> Column:
    """The numbers of an address; 10, 127, 172.16-31 and 192.168 stay what they are, and a number over 255 stays over it."""

    def place(o, i, first):
        of = lambda v, m, a: F.struct(v.cast("int").alias("v"), F.lit(m).alias("m"), F.lit(a).alias("a"))
        less = lambda out: o - sum(F.when(o > x, 1).otherwise(0) for x in out)
        stays = F.struct(F.lit(0).alias("v"), F.lit(1).alias("m"), o.cast("string").alias("a"))
        return (
            F.when(o > 255, of(o - 256, 744, "high"))
            .when((i == 0) & o.isin(_FIRST), stays)
            .when(i == 0, of(less(_FIRST), 256 - len(_FIRST), "first"))
            .when((i == 1) & (first == 172) & o.isin(_AFTER_172), of(o - 16, 16, "inner"))
            .when((i == 1) & (first == 172), of(less(_AFTER_172), 240, "outer"))
            .when((i == 1) & (first == 192) & o.isin(_AFTER_192), stays)
            .when((i == 1) & (first == 192), of(less(_AFTER_192), 255, "other"))
            .otherwise(of(o, 256, "any"))
        )

    octets = F.transform(F.split(canon, r"\."), lambda o: o.cast("int"))
    return _bound(octets, lambda o: F.transform(o, lambda x, i: place(x, i, o[0])))


def _address(places: Column) -> Column:
    """The address that places stand for."""

    def number(x):
        v, a = x["v"], x["a"]
        first = v
        for out in _FIRST:
            first = F.when(first >= out, first + 1).otherwise(first)
        n = F.when(a == "high", v + 256).when(a == "first", first).when(a == "inner", v + 16).when((a == "outer") & (v >= 16), v + 16).when((a == "other") & (v >= 168), v + 1).otherwise(v)
        return F.when(x["m"] == 1, a).otherwise(n.cast("string"))

    return F.array_join(F.transform(places, number), ".")


def _script(name: Column) -> Column:
    return F.when(name.rlike(r"\p{IsCyrillic}"), "cyrillic").when(name.rlike(r"\p{IsGreek}"), "greek").otherwise("latin")


def _given_at(canon: Column, key: str) -> Column:
    """Which of the sixteen given names of its gender and script a full name gets."""
    return F.conv(F.substring(F.sha2(F.concat_ws("\x1f", F.lit(key), F.lit("given"), canon), 256), 1, 4), 16, 10).cast("int") % 16


def _person(e: Column, canon: Column, key: str, number: Column, surname: Column) -> Column:
    """Title kept; a given name of its gender and script, with further ones by its number where persons would meet; capitals as in the original."""
    gender, script = F.substring(canon, 1, 1), _script(canon)
    lists = F.lit(None).cast("array<string>")
    for (g, s), known in GIVEN.items():
        lists = F.when((gender == g) & (script == s), F.array(*map(F.lit, known))).otherwise(lists)

    def named(names):
        # numbers from 1 on add names: their digits to base 16
        digits = F.transform(F.sequence(F.lit(0), F.floor(F.log2(F.greatest(number, F.lit(1))) / 4).cast("int")), lambda j: F.floor(number / F.pow(F.lit(16.0), j)).cast("int") % 16)
        more = F.when(number > 0, F.transform(digits, lambda d: F.element_at(names, d + 1))).otherwise(F.array().cast("array<string>"))
        return F.concat(F.array_join(F.concat(F.array(F.element_at(names, _given_at(canon, key) + 1)), more), "-"), F.lit(" "))

    given = F.when(F.size(F.split(canon, " ")) > 2, _bound(lists, named)).otherwise("")
    both = F.concat(given, F.initcap(surname))
    return F.concat(F.regexp_extract(e, r"^(\S+ )", 1), F.when(e.rlike(r" \p{Lu}[\p{Lu}'-]+$"), F.upper(both)).otherwise(both))


def _fill(shape: Column, digits: Column) -> Column:
    """The digits of a string put, in order, for the digits of a shape."""

    def filled(x):
        shape, digits = x["s"], x["d"]
        parts = F.transform(
            F.sequence(F.lit(1), F.length(shape)),
            lambda i: F.when(
                F.substring(shape, i, F.lit(1)).rlike("[0-9]"), F.substring(digits, F.length(F.regexp_replace(F.substring(shape, F.lit(1), i), "[^0-9]", "")), F.lit(1))
            ).otherwise(F.substring(shape, i, F.lit(1))),
        )
        return F.array_join(parts, "")

    return _bound(F.struct(shape.alias("s"), digits.alias("d")), filled)


_MARK = "^(AKIA|gh[pousr]_|sk-)"


def _domain(canon: Column) -> tuple[Column, Column]:
    """(name, top domain with its dot) of an e-mail address."""
    domain = F.substring_index(canon, "@", -1)
    return F.regexp_replace(domain, r"\.[^.]+$", ""), F.regexp_extract(domain, r"(\.[^.]+)$", 1)


def _part(k: Column, canon: Column) -> Column:
    """What of an entity is permuted: (part, alphabets, first and last place that may change, tweak, which stays the same).

    An e-mail's local part (its domain is permuted by itself), a card but for
    its last digit, which stays as far off the check digit as it was, a key but
    for its issuer's mark, a surname, or all.  A card's first digit, a phone's if
    0 or 1, and the last two letters of a Cyrillic surname of five or more,
    which tell the gender, stay.
    """
    part = (
        F.when(k == "email", F.substring_index(canon, "@", 1)).when(k == "card", F.substring(canon, F.lit(1), F.length(canon) - 1)).when(k == "key", F.regexp_replace(canon, _MARK, ""))
        .when(k == "person", F.lower(F.substring_index(canon, " ", -1))).otherwise(canon)
    )

    def described(p):
        names = _sets(VOWELS, CONSONANTS, *OTHERS)
        sets = F.when(k == "person", names).when(k.isin("card", "phone"), _sets(DIGITS)).otherwise(_alphabets(p))
        first = F.when((k == "card") | ((k == "phone") & canon.rlike("^[01]")), 2).otherwise(1)
        last = F.length(p) - F.when((k == "person") & (F.length(p) >= 5) & p.rlike(r"\p{IsCyrillic}"), 2).otherwise(0)
        same = F.when(k == "email", F.substring_index(canon, "@", -1)).when(k == "card", _off_check(canon).cast("string")).when(k == "key", F.regexp_extract(canon, _MARK, 1)).otherwise("")
        return F.struct(p.alias("p"), sets.alias("sets"), first.alias("first"), last.alias("last"), F.concat_ws(" ", k, same).alias("tweak"))

    return _bound(part, described)


def _shown(f: Column, number: Column, places: Column, domain: Column, key: str) -> Column:
    """Replacement of a mention f (k, c, e) from the permuted places of its part and of its domain."""
    k, canon, e = f["k"], f["c"], f["e"]
    of = lambda i: F.regexp_extract(e, _ASSIGNED, i)
    card = lambda x: F.concat(x, F.pmod(_check_digit(x) + _off_check(canon), F.lit(10)).cast("string"))
    text = _text(places)
    return (
        F.when(k == "ip", _address(places))
        .when(k == "email", F.concat(text, F.lit("@"), _text(domain), _domain(canon)[1]))
        .when(k == "card", _fill(e, _bound(text, card)))
        .when(k == "phone", _fill(e, text))
        .when(k == "secret", F.concat(of(1), text, of(3)))
        .when(k == "key", F.concat(F.regexp_extract(canon, _MARK, 1), text))
        .when(k == "person", _person(e, canon, key, number, text))
    )


def replaced(rows: DataFrame, key: str) -> DataFrame:
    """rows (found: array of (k, c, e); numbers: map of persons' numbers) with s, the array of replacements."""
    rows = rows.withColumn("main", F.transform("found", lambda f: _part(f["k"], f["c"])))
    spelt = lambda x: F.struct(_places(x["p"], x["sets"], x["first"], x["last"]).alias("places"), x["tweak"].alias("tweak"))
    rows = rows.withColumn("main", F.transform("main", spelt))
    ip = lambda x, f: F.when(f["k"] == "ip", F.struct(_ip_places(f["c"]).alias("places"), x["tweak"].alias("tweak"))).otherwise(x)
    rows = permuted(rows.withColumn("main", F.zip_with("main", "found", ip)), "main", key)

    def domain(f):
        name, top = _domain(f["c"])
        name = F.when(f["k"] == "email", name).otherwise("")
        return F.struct(name.alias("p"), _alphabets(name).alias("sets"), F.lit(1).alias("first"), F.length(name).alias("last"), F.concat(F.lit("domain "), top).alias("tweak"))

    rows = permuted(rows.withColumn("domain", F.transform("found", domain)).withColumn("domain", F.transform("domain", spelt)), "domain", key)
    number = lambda f: F.coalesce(F.col("numbers")[f["c"]], F.lit(0))
    shown = F.transform("found", lambda f, i: _shown(f, number(f), F.get("main", i), F.get("domain", i), key))
    return rows.withColumn("s", shown).drop("main", "domain")


def _entity(e: Column) -> Column:
    return _bound(kind(e), lambda k: F.struct(k.alias("k"), canonical(e, k).alias("c"), e.alias("e")))


def _detected(docs: DataFrame) -> DataFrame:
    """Adds found, the entities of a text in order; empty for most."""
    none = F.array().cast("array<struct<k:string,c:string,e:string>>")
    hinted = F.coalesce(F.contains("text", F.lit("=")) | F.contains("text", F.lit(":")) | F.col("text").rlike(HINT), F.lit(False))
    return docs.withColumn("found", F.when(hinted, F.transform(F.regexp_extract_all("text", F.lit(ANY), F.lit(0)), _entity)).otherwise(none))


def numbered_persons(names: DataFrame, key: str) -> DataFrame:
    """(c, number) of the full names (c) that would get the names of another person; of those that meet the first by c has none.

    Persons with one surname get one surname, so only they can meet, in one of
    sixteen given names; numbered, they are told apart by further ones.
    """
    own = names.distinct()
    w = Window.partitionBy(F.substring("c", 1, 1), F.substring_index("c", " ", -1), _script(F.col("c")), _given_at(F.col("c"), key)).orderBy("c")
    return own.where(F.size(F.split("c", " ")) > 2).select("c", (F.row_number().over(w) - 1).alias("number")).where("number > 0")


#: Up to so many rows that mention numbered persons are broadcast; more are joined by a shuffle.
BROADCAST_ROWS = 100_000


def surrogates(docs: DataFrame, key: str) -> DataFrame:
    """Every row of docs (doc_id, text, ...) with its entities replaced in text, and entities, an array of (k, e, s).

    k: email, ip, secret (the value of an assignment), key, phone, card or
    person (a title with names).  Replacements keep length classes, digits,
    letter cases, separators, the mark of a key's issuer, a card's first digit
    and Luhn validity, ranges of addresses, an e-mail's top domain (equal
    domains stay equal), a person's title, gender and script; persons with
    one surname still have one.  Distinct entities of a type stay distinct in
    every corpus, and none is its own surrogate; in a format that is densely
    used a surrogate can be the value of another entity, which itself has
    another one.  Letters and digits of every script take the places of others
    of their script and case (a class of one letter: of another such class).
    Punctuation stays, but in secrets that have nothing else; a secret of
    symbols beyond ASCII alone is the one entity that stays what it is.  Given
    names of other scripts than Cyrillic and Greek become Latin ones.  Which of
    two entities of a format with two values gets which surrogate does not
    depend on the key, as only one is not the original.  The rest of a text is untouched; null and
    empty texts stay.  Rows with the same text come out alike.  Columns named
    entities are replaced.
    """
    docs = docs.drop("entities")
    names = docs.columns
    # other columns wait in one struct, so that none is taken for a column of this plan
    docs = docs.select(F.col("doc_id"), F.col("text"), F.struct(*[F.col(f"`{c}`") for c in names]).alias("_given"))
    keyed = docs.withColumn("row_key", F.xxhash64("doc_id", "text"))
    # names in any place are looked for, so this finds the persons of _detected() at least
    titled = keyed.where(F.col("text").rlike(FORMATS["person"])).select("row_key", F.explode(F.regexp_extract_all("text", F.lit(f"({FORMATS['person']})"), F.lit(1))).alias("e"))
    persons = materialise(titled.select("row_key", canonical(F.col("e"), F.lit("person")).alias("c")).distinct(), "persons")
    numbers = materialise(numbered_persons(persons.select("c"), key), "numbers")
    affected = persons.join(numbers, "c").groupBy("row_key").agg(F.map_from_entries(F.collect_set(F.struct("c", "number"))).alias("numbers"))
    affected = materialise(affected, "affected")
    rows, n = _detected(keyed), affected.count()
    if n == 0:
        rows = rows.withColumn("numbers", F.lit(None).cast("map<string,int>"))
    else:
        rows = rows.join(F.broadcast(affected) if n <= BROADCAST_ROWS else affected, "row_key", "left")
    rows = replaced(rows, key)
    done = F.zip_with("found", "s", lambda f, s: F.struct(f["k"].alias("k"), f["e"].alias("e"), s.alias("s")))
    rows = rows.withColumn("entities", F.when(F.size("found") > 0, done).otherwise(F.array().cast("array<struct<k:string,e:string,s:string>>")))
    between = F.split("text", ANY, -1)
    joined = F.array_join(F.zip_with(between, F.transform("entities", lambda x: x["s"]), lambda b, s: F.concat(b, F.coalesce(s, F.lit("")))), "")
    text = F.when(F.size("entities") > 0, joined).otherwise(F.col("text"))
    return rows.select(*[text.alias("text") if c == "text" else F.col("_given").getField(c).alias(c) for c in names], "entities")
