"""PII surrogates, in DataFrame operations alone.

Entities are found by one search of each text, which cuts it into gaps and entities. What is replaced
are units: an address, a number without its spacing, or one part of a name. Each distinct unit gets
one keyed surrogate of its own type, worked out once: a Feistel network over its characters shifts
every digit and letter within its own small alphabet (digits, hexadecimal digits, vowels or
consonants of a script in one case), so case, script and pronounceability stay; IPv4 addresses are
permuted as 32-bit numbers, country codes stay, card numbers keep the state of their check digit and
IBANs get valid ones, and given names go to given names of the same gender and script. An entity takes
the surrogates of its units in its own spelling. So a surname is replaced alike alone, behind a title
and behind a given name, and one number alike in all spellings.

A collision check joins the surrogates with the units of the corpus: where a surrogate is itself a
real unit, or another's surrogate, maps of other keys are tried until one is neither. It is the unit
that is given another key, so all entities and documents that hold it follow. Given names before a
surname are not checked: their names are few and shared by many, and stay one-to-one. Where maps settle
none of those left, they get a longer surrogate made of a keyed digest (addresses, names, phone
numbers and secrets); numbers of a fixed form then keep their first one, which is another of the corpus.

A surname that a document names once is replaced wherever it stands as a word of its own in it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialize

ROUNDS = 4

# Alphabets of one class each.
DIGITS, HEX = "0123456789", "0123456789abcdef"
ALPHABETS = [
    DIGITS,
    "bcdfghjklmnpqrstvwxz", "aeiouy", "BCDFGHJKLMNPQRSTVWXZ", "AEIOUY",
    "çñßł", "àáâãäåèéêëìíîïòóôõöùúûü", "ÇÑŁ", "ÀÁÂÃÄÅÈÉÊËÌÍÎÏÒÓÔÕÖÙÚÛÜ",
    "бвгджзклмнпрстфхцчшщ", "аеиоуыэюя", "БВГДЖЗКЛМНПРСТФХЦЧШЩ", "АЕИОУЫЭЮЯ",
    "βγδζθκλμνξπρστφχψ", "αεηιουω", "ΒΓΔΖΘΚΛΜΝΞΠΡΣΤΦΧΨ", "ΑΕΗΙΟΥΩ",
]
# First and last letter of scripts without case, each an alphabet of its own.
SCRIPTS = [
    (0x4E00, 0x9FA5), (0x3041, 0x3096), (0x30A1, 0x30FA), (0xAC00, 0xD7A3),
    (0x0620, 0x064A), (0x05D0, 0x05EA), (0x0904, 0x0939), (0x0E01, 0x0E30), (0x10D0, 0x10F0),
]
# Titles that announce a name, and given names by gender and script.
TITLES = "Mr|Mrs|Ms|Miss|Mister|Dr|Doctor|Prof|Professor|Sir|Madam|Lady|Lord|Rev|Herr|Frau|Señor|Señora|Sr|Sra|Monsieur|Madame|Mme|Господин|Госпожа|Доктор|Κύριος|Κυρία"
# What announces a name without a title, what announces a secret, and country calling codes.
CALLED = ["My name is ", "my name is ", "Ich heiße ", "ich heiße ", "Je m'appelle ", "je m'appelle ", "Me llamo ", "me llamo ", "Меня зовут ", "меня зовут "]
SECRET_NAMES = "password|passwd|pwd|secret|api_key|apikey"
CALLING = "1|7|2[07]|3[0-469]|4[013-9]|5[1-8]|6[0-6]|8[1246]|9[0-58]|[0-9]{3}"
GIVEN = {
    "female latin": ["Alice", "Anna", "Carmen", "Claire", "Clara", "Elena", "Emma", "Hanna", "Ines", "Julia", "Laura", "Lucia", "Maria", "Marie", "Mary", "Nora", "Olivia", "Paula", "Sarah", "Sophie"],
    "male latin": ["Alexander", "Carlos", "David", "Felix", "Hans", "Hugo", "James", "Jean", "John", "Jorge", "Louis", "Lukas", "Manuel", "Martin", "Michael", "Paul", "Peter", "Pierre", "Robert", "Thomas"],
    "female cyrillic": ["Анна", "Вера", "Елена", "Ирина", "Мария", "Нина", "Ольга", "Татьяна"],
    "male cyrillic": ["Алексей", "Борис", "Виктор", "Дмитрий", "Иван", "Николай", "Павел", "Сергей"],
    "female greek": ["Άννα", "Ελένη", "Ιωάννα", "Κατερίνα", "Μαρία", "Σοφία"],
    "male greek": ["Γιώργος", "Δημήτρης", "Κώστας", "Νίκος", "Πέτρος", "Σπύρος"],
}

_WORD = r"[\p{L}\p{N}._%+\-]"
_OCTET = r"(?:25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
_NAMES = "|".join(n for names in GIVEN.values() for n in names)
#: A part of a name, without a possessive behind it.
_PART = r"\p{Lu}(?=[\p{L}'’\-])\p{L}*+(?:['’\-](?!s(?!\p{L}))\p{L}++)*+"
_GROUP = "[0-9A-Fa-f]{1,4}"
#: Entity types in the order in which they are tried; a text is searched for all of them at once.
TYPES = {
    "email": rf"(?<!{_WORD}){_WORD}++@[\p{{L}}\p{{N}}\-]++(?:\.[\p{{L}}\p{{N}}\-]++)++",
    "secret": rf"(?<![A-Za-z0-9])(?:[0-9a-f]{{32,128}}|[0-9A-F]{{32,128}}|AKIA[0-9A-Z]{{16}}|sk-[A-Za-z0-9_\-]{{20,}})(?![A-Za-z0-9])|(?<=(?:{SECRET_NAMES})(?:=|:|: | = ))[^\s\"',;=:]{{4,}}",
    "ip": rf"(?<![0-9.])(?:{_OCTET}\.){{3}}{_OCTET}(?![0-9]|\.[0-9])",
    "ip6": rf"(?<![0-9A-Za-z:.])(?:(?:{_GROUP}:){{7}}{_GROUP}|(?:{_GROUP}:){{1,6}}(?::{_GROUP}){{1,6}})(?![0-9A-Za-z:])",
    "phone": r"(?<![0-9+])\+[0-9]{1,3}[ .\-]?(?:\([0-9]{1,4}\)[ .\-]?)?[0-9]{2,4}(?:[ .\-]?[0-9]{2,4}){1,4}(?![0-9])|(?<![0-9(])\([0-9]{3}\) ?[0-9]{3}-[0-9]{4}(?![0-9])|(?<![0-9\-])[0-9]{3}-[0-9]{3}-[0-9]{4}(?![0-9\-])",
    "ssn": r"(?<![0-9\-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9\-])",
    "card": r"(?<![0-9])[0-9](?:[ \-]?[0-9]){12,18}(?![0-9])",
    "iban": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "person": rf"(?<!\p{{L}})(?:(?:{TITLES})\.? {_PART}(?: {_PART})?|(?:{_NAMES}) {_PART})|(?<=(?:{'|'.join(CALLED)})){_PART}(?: {_PART})?",
}
#: A private character that stands around entities where the text itself has none.
MARK = "\ue000"
_FOUND = {name: f"(?:{pattern})" for name, pattern in TYPES.items()}
# what its surroundings alone announce is split off, so that the rest need not be looked for everywhere
_SECRET, _ANNOUNCED = TYPES["secret"].split("|(?<=", 1)
_PERSON, _CALLED = TYPES["person"].rsplit("|(?<=", 1)
#: All types in one pattern. Each begins where a cheap look at one or two characters lets it: at the
#: beginning of a word, of a number, of a capitalised word, or behind a sign of assignment.
PATTERN = "|".join([
    rf"(?<![A-Za-z0-9])(?:{_FOUND['email']}|(?:{_SECRET})|{_FOUND['ip6']}|(?=\p{{Lu}})(?:{_FOUND['iban']}|{_PERSON}))",
    rf"(?=[0-9+(])(?:{_FOUND['ip']}|{_FOUND['phone']}|{_FOUND['ssn']}|{_FOUND['card']})",
    rf"(?=\p{{Lu}})(?<= )(?<={_CALLED}",
    rf"(?<=[=:]|[=:] )(?<={_ANNOUNCED}",
])


def entities(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(PATTERN), F.lit(0))


def pieces(text: Column) -> Column:
    """What lies before, between and after the entities, and the entities, in turn; found in one search of the text."""
    marked = F.split(F.regexp_replace(text, PATTERN, f"{MARK}$0{MARK}"), MARK, -1)
    ends = F.concat(entities(text), F.array(F.lit("")))
    apart = F.flatten(F.zip_with(F.split(text, PATTERN, -1), ends, lambda gap, e: F.array(gap, e)))
    return F.when(F.contains(text, F.lit(MARK)), F.slice(apart, F.lit(1), F.size(apart) - 1)).otherwise(marked)


def kind(entity: Column) -> Column:
    """The first type whose pattern the whole entity fits; what its surroundings alone announced is a person's name or else a secret."""
    out = F.when(F.lit(False), F.lit(""))
    for name, pattern in TYPES.items():
        out = out.when(F.regexp_like(entity, F.lit(f"^(?:{pattern})$")), F.lit(name))
    return out.when(F.regexp_like(entity, F.lit(f"^{_PART}(?: {_PART})?$")), F.lit("person")).otherwise(F.lit("secret"))


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of ``value``, which is worked out once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


_ALL = "".join(ALPHABETS)
_FIRST = [_ALL.index(x) for x in ALPHABETS for _ in x]
_SIZES = [len(x) for x in ALPHABETS for _ in x]


def _shifted(part: Column, other: Column, letters: Column, key: str, n: Column) -> Column:
    """``part`` with each character moved within its alphabet, as key, round and the other part say."""

    def move(i: Column, told: Column) -> Column:
        def moved(s: Column) -> Column:
            hexadecimal = F.char_length(letters) == len(HEX)
            first = F.when(hexadecimal, F.lit(0)).otherwise(F.get(F.lit(_FIRST), s.at - 1))
            size = F.when(hexadecimal, F.lit(len(HEX))).otherwise(F.get(F.lit(_SIZES), s.at - 1))
            to = first + F.pmod(F.xxhash64(told, i) % 1_000_003 + s.at - 1 - first, size).cast("int")
            return F.when(s.at > 0, F.substring(letters, to + 1, F.lit(1))).when(s.c < "\u0100", s.c).otherwise(let(F.ascii(s.c), lambda point: far(s.c, point)))

        def far(c: Column, point: Column) -> Column:
            out = F.when(F.lit(False), c)
            for lo, hi in SCRIPTS:
                to = lo + F.pmod(F.xxhash64(told, i) % 1_000_003 + point - lo, F.lit(hi - lo + 1))
                out = out.when(point.between(lo, hi), F.decode(F.unhex(F.lpad(F.hex(to), 8, "0")), "UTF-32"))
            return out.otherwise(c)

        return let(F.substring(part, i, F.lit(1)), lambda c: let(F.struct(c.alias("c"), F.when(c == "", F.lit(0)).otherwise(F.instr(letters, c)).alias("at")), moved))

    told = F.sha2(F.concat_ws("|", F.lit(key), n.cast("string"), other), 256)
    places = F.when(F.char_length(part) > 0, F.sequence(F.lit(1), F.char_length(part))).otherwise(F.array().cast("array<int>"))
    return let(told, lambda t: F.array_join(F.transform(places, lambda i: move(i, t)), ""))


def _feistel(text: Column, letters: Column, key: str) -> Column:
    """A keyed one-to-one map of the strings of one format (classes and punctuation by place)."""
    half = F.floor(F.char_length(text) / 2).cast("int")
    state = F.struct(F.substring(text, F.lit(1), half).alias("l"), F.substring(text, half + 1, F.char_length(text)).alias("r"))
    step = lambda s, n: F.struct(s.r.alias("l"), _shifted(s.l, s.r, letters, key, n).alias("r"))
    return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), state, step, lambda s: F.concat(s.l, s.r))  # ROUNDS is even


def _ip(entity: Column, key: str) -> Column:
    """A 32-bit Feistel network over the address."""

    def step(s: Column, n: Column) -> Column:
        mask = F.pmod(F.xxhash64(F.sha2(F.concat_ws("|", F.lit(key), n.cast("string"), s.r.cast("string")), 256)), F.lit(65536)).cast("int")
        return F.struct(s.r.alias("l"), s.l.bitwiseXOR(mask).alias("r"))

    four = lambda s: F.concat_ws(".", *(x.cast("string") for x in (F.shiftright(s.l, 8), s.l % 256, F.shiftright(s.r, 8), s.r % 256)))

    def permuted(p: Column) -> Column:
        start = F.struct((p[0] * 256 + p[1]).alias("l"), (p[2] * 256 + p[3]).alias("r"))
        return F.aggregate(F.sequence(F.lit(1), F.lit(ROUNDS)), start, step, four)

    return let(F.split(entity, r"\.").cast("array<int>"), permuted)


def _luhn(body: Column) -> Column:
    """The check digit of a string's digits."""

    def add(total: Column, i: Column, digits: Column) -> Column:
        d = F.substring(digits, F.char_length(digits) - i, F.lit(1)).cast("int")
        return total + F.when(i % 2 == 1, d).when(d > 4, d * 2 - 9).otherwise(d * 2)

    total = lambda digits: F.aggregate(F.sequence(F.lit(0), F.char_length(digits) - 1), F.lit(0), lambda t, i: add(t, i, digits))
    return let(F.regexp_replace(body, "[^0-9]", ""), lambda digits: F.pmod(-total(digits), F.lit(10)))


def characters(text: Column) -> Column:
    return F.filter(F.split(text, ""), lambda c: c != "")


def _remainder(text: Column) -> Column:
    """Modulo 97 of the number that a string of digits and capital letters (A is 10) spells."""

    def add(total: Column, c: Column) -> Column:
        value = F.ascii(c)
        return F.when(value < 58, (total * 10 + value - 48) % 97).otherwise((total * 100 + value - 55) % 97)

    return F.aggregate(characters(text), F.lit(0), add)


def units(entity: Column) -> Column:
    """Array of struct(space, value) of an entity: what is replaced by itself, in order; titles have an empty space."""
    plain = F.regexp_replace(entity, "[^0-9A-Za-z]", "")

    def part(word: Column, i: Column, words: Column) -> Column:
        title = F.regexp_like(word, F.lit(rf"^(?:{TITLES})\.?$")) & (i == 0)
        known = F.regexp_like(word, F.lit(f"^(?:{_NAMES})$"))
        # a given name stands before another part; alone it is a name like others, of its own kind
        space = F.when(title, "").when(known & (i + 1 < F.size(words)), "given").when(known, "alone").otherwise("name")
        return F.struct(space.alias("space"), word.alias("value"))

    def of(k: Column) -> Column:
        value = F.when(k.isin("email", "ip6"), F.lower(entity)).when(k == "phone", F.concat(F.when(F.startswith(entity, F.lit("+")), "+").otherwise(""), plain)).when(k.isin("card", "ssn", "iban"), plain).otherwise(entity)
        return F.when(k == "person", let(F.split(entity, " "), lambda w: F.transform(w, lambda x, i: part(x, i, w)))).otherwise(F.array(F.struct(k.alias("space"), value.alias("value"))))

    return let(kind(entity), of)


def _given(name: Column, key: str) -> Column:
    """Another given name of the same gender and script: a step round its list that the key alone decides."""
    out = name
    for group, names in GIVEN.items():
        by = 1 + F.pmod(F.xxhash64(F.sha2(F.lit(f"{key}|{group}"), 256)), F.lit(len(names) - 1)).cast("int")
        at = F.array_position(F.lit(names), name).cast("int")
        out = F.when(at > 0, F.get(F.lit(names), F.pmod(at - 1 + by, F.lit(len(names))))).otherwise(out)
    return out


#: What stays of a unit, by space: in front of the permuted part, and behind it.
_BEFORE = {"phone": rf"^(?:\+(?:{CALLING}))?", "iban": "^.{4}", "secret": "^(?:AKIA|sk-)?"}
_BEHIND = {"email": r"\.[^.]*$", "card": ".$"}


def surrogate(space: Column, value: Column, key: str) -> Column:
    """The keyed replacement of a unit: one-to-one within its space."""

    def kept(patterns: dict[str, str], u: Column) -> Column:
        out = F.when(F.lit(False), F.lit(""))
        for name, pattern in patterns.items():
            out = out.when(u.space == name, F.regexp_extract(u.value, pattern, 0))
        return out.otherwise(F.lit(""))

    def cut(u: Column) -> Column:
        low = (u.space == "ip6") | ((u.space == "secret") & F.regexp_like(u.value, F.lit("^[0-9a-f]+$")))
        letters = F.when(low, F.lit(HEX)).when((u.space == "secret") & F.regexp_like(u.value, F.lit("^[0-9A-F]+$")), F.lit(HEX.upper())).otherwise(F.lit(_ALL))
        return F.struct(u.space.alias("space"), u.value.alias("value"), kept(_BEFORE, u).alias("front"), kept(_BEHIND, u).alias("end"), letters.alias("letters"))

    def middle(c: Column) -> Column:
        mid = F.substring(c.value, F.char_length(c.front) + 1, F.char_length(c.value) - F.char_length(c.front) - F.char_length(c.end))
        return F.struct(c.alias("c"), mid.alias("old"), _feistel(mid, c.letters, key).alias("new"))

    def joined(m: Column) -> Column:
        country, check = F.substring(m.c.front, 1, 2), F.substring(m.c.front, 3, 2)
        # check digits that hold are worked out anew; a card's last digit keeps its difference from them
        right = F.when(_remainder(F.concat(m.old, m.c.front)) == 1, F.lpad((98 - _remainder(F.concat(m.new, country, F.lit("00")))).cast("string"), 2, "0")).otherwise(check)
        return (
            F.when(m.c.space == "card", F.concat(m.new, F.pmod(_luhn(m.new) + m.c.end.cast("int") - _luhn(m.old), F.lit(10)).cast("string")))
            .when(m.c.space == "iban", F.concat(country, right, m.new))
            .otherwise(F.concat(m.c.front, m.new, m.c.end))
        )

    permuted = lambda u: let(cut(u), lambda c: let(middle(c), joined))
    return let(F.struct(space.alias("space"), value.alias("value")), lambda u: F.when(u.space == "ip", _ip(u.value, key)).when(u.space.isin("given", "alone"), _given(u.value, key)).when(u.space == "", u.value).otherwise(permuted(u)))


def _longer(space: Column, value: Column, key: str) -> Column:
    """A surrogate beyond the unit's own format, for spaces whose values may all be units; null for those of a fixed form."""
    digest = F.sha2(F.concat_ws("|", F.lit(key), F.lit("longer"), space, value), 256)
    word = F.translate(F.substring(digest, 1, 32), HEX, "bdfghklmnprstvwz")
    # 20 decimal digits
    numbers = [F.lpad((F.conv(F.substring(digest, 1 + 12 * i, 12), 16, 10).cast("long") % 10_000).cast("string"), 4, "0") for i in range(5)]
    code = F.regexp_extract(value, rf"^\+(?:{CALLING})", 0)
    return (
        F.when(space == "email", F.concat(word, F.lit("@"), F.substring(word, 1, 8), F.regexp_extract(value, r"\.[^.]*$", 0)))
        .when(space.isin("name", "alone"), F.initcap(word))
        .when(space == "phone", F.concat(F.when(code != "", code).otherwise(F.lit("+1")), *numbers))
        .when(space.isin("secret", "ip6"), F.concat(value, digest))
    )


def resolved(found: DataFrame, key: str) -> DataFrame:
    """space, value, surrogate of distinct units(space, value): no surrogate is a unit of its space or another's surrogate.

    Given names before surnames keep their first one. Rounds go on while they settle any; the few that
    are then left take longer forms, and numbers of a fixed form keep a surrogate that is one-to-one.
    """
    spark = found.sparkSession
    first = materialize(spark, found.select("space", "value", surrogate(F.col("space"), F.col("value"), key).alias("surrogate")), "units")
    free, checked = first.where("space = 'given'"), first.where("space != 'given'")
    taken = checked.select("space", F.explode(F.array("value", "surrogate")).alias("surrogate"))
    left = materialize(spark, checked.join(checked.select("space", F.col("value").alias("surrogate")), ["space", "surrogate"], "left_semi").select("space", "value"), "collisions")
    again, n, most, stalls = None, 0, left.count(), 0
    while most and stalls < MOST_STALLS:
        n += 1
        made = materialize(spark, left.select("space", "value", surrogate(F.col("space"), F.col("value"), f"{key}|{n}").alias("surrogate")), "again")
        settled = materialize(spark, made.join(taken if again is None else taken.union(again.select("space", "surrogate")), ["space", "surrogate"], "left_anti").select("space", "value", "surrogate"), "settled")
        again = settled if again is None else again.union(settled)
        left = materialize(spark, made.join(settled, ["space", "value"], "left_anti").select("space", "value"), "collisions")
        before, most = most, left.count()
        stalls = stalls + 1 if most == before else 0
    if again is None:
        return first
    if most:
        firsts = left.join(checked, ["space", "value"]).select("space", "value", F.coalesce(_longer(F.col("space"), F.col("value"), key), F.col("surrogate")).alias("surrogate"))
        again = again.union(firsts)
    again = materialize(spark, again, "walked")
    return free.union(checked.join(again, ["space", "value"], "left_anti").select("space", "value", "surrogate")).union(again)


def _spelled(entity: Column, new: Column) -> Column:
    """The characters of ``new`` in the places of an entity's digits and letters; what is longer stands by itself."""
    there = F.regexp_replace(entity, "[^0-9A-Za-z]", "")
    chars = characters(entity)
    step = lambda s, c: F.when(F.regexp_like(c, F.lit("[0-9A-Za-z]")), F.struct(F.concat(s.out, F.substring(new, s.at, F.lit(1))).alias("out"), (s.at + 1).alias("at"))).otherwise(F.struct(F.concat(s.out, c).alias("out"), s.at.alias("at")))
    laid = F.aggregate(chars, F.struct(F.lit("").alias("out"), F.lit(1).alias("at")), step, lambda s: s.out)
    return F.when(F.char_length(new) == F.char_length(there), laid).otherwise(new)


#: Rounds without a settled unit after which other forms are taken.
MOST_STALLS = 3


def replacements(entities: DataFrame, key: str) -> DataFrame:
    """entity, type, new, names (struct(value, surrogate) of its parts that are surnames) of distinct entities(entity)."""
    spark = entities.sparkSession
    parsed = materialize(spark, entities.select("entity", kind(F.col("entity")).alias("type"), units(F.col("entity")).alias("units")), "entities")
    each = parsed.select("entity", "type", F.posexplode("units").alias("place", "u")).select("entity", "type", "place", "u.space", "u.value")
    told = resolved(each.where("space != ''").select("space", "value").distinct(), key)
    met = each.join(told, ["space", "value"], "left").groupBy("entity", "type").agg(F.array_sort(F.collect_list(F.struct("place", "space", "value", "surrogate"))).alias("parts"))
    new = F.array_join(F.transform("parts", lambda p: F.coalesce(p.surrogate, p.value)), " ")
    numbers = F.col("type").isin("phone", "card", "ssn", "iban")
    one = F.regexp_replace(new, r"^\+", "")
    spelled = F.when(numbers & (F.startswith(new, F.lit("+")) == F.startswith("entity", F.lit("+"))), _spelled(F.col("entity"), one)).otherwise(new)
    # a longer phone number keeps its plus
    spelled = F.when(numbers & (spelled == one) & F.startswith(new, F.lit("+")) & ~F.startswith(spelled, F.lit("+")), new).otherwise(spelled)
    names = F.transform(F.filter("parts", lambda p: (p.space == "name") & (F.char_length(p.value) > 1)), lambda p: F.struct(p.value.alias("value"), p.surrogate.alias("surrogate")))
    return met.select("entity", "type", spelled.alias("new"), names.alias("names"))


def replace(docs: DataFrame, key: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, text, n_entities, types.

    ``text`` is the text with each entity replaced; null texts stay null and empty ones empty, with
    no entities. Repeated rows and null ids are rows like others; an empty table gives an empty
    result; other columns are not read. The key decides all surrogates and is to be kept secret.
    ``n_entities`` counts what was found, not the further places of a surname.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"), F.monotonically_increasing_id().alias("rid"))
    cut = materialize(spark, rows.select("doc_id", "rid", pieces(F.col("text")).alias("pieces")), "pieces")
    held = cut.where(F.size("pieces") > 1).select("rid", F.explode(F.array_distinct(F.filter("pieces", lambda x, i: i % 2 == 1))).alias("entity"))
    told = materialize(spark, replacements(held.select("entity").distinct(), key), "replacements")
    # what a document needs travels to it once, beside its text
    own = held.join(told, "entity").groupBy("rid").agg(
        F.map_from_entries(F.collect_list(F.struct("entity", "new"))).alias("new"), F.array_sort(F.collect_set("type")).alias("types"), F.array_distinct(F.flatten(F.collect_list("names"))).alias("names"),
    )
    plain = cut.where(F.coalesce(F.size("pieces"), F.lit(0)) <= 1).select("doc_id", F.get("pieces", F.lit(0)).alias("text"), F.lit(0).cast("long").alias("n_entities"), F.array().cast("array<string>").alias("types"))

    def gap(text: Column) -> Column:
        alone = lambda t, n: F.regexp_replace(t, F.concat(F.lit(r"(?<![\p{L}\p{N}])"), n.value, F.lit(r"(?![\p{L}\p{N}])")), n.surrogate)
        return F.when(F.size("names") > 0, F.aggregate("names", text, alone)).otherwise(text)

    text = F.array_join(F.transform("pieces", lambda x, i: F.when(i % 2 == 1, F.element_at(F.col("new"), x)).otherwise(gap(x))), "")
    changed = cut.where(F.size("pieces") > 1).join(own, "rid").select("doc_id", text.alias("text"), F.floor(F.size("pieces") / 2).cast("long").alias("n_entities"), "types")
    return plain.unionByName(changed)
